"""Writers: partitioned books, routed outputs, append-only logs, versioned tables, reports."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str) -> None:
    """Replace a table; the commit protocol makes it all or nothing."""
    df.write.mode("overwrite").parquet(path)


def write_version(df: DataFrame, root: str, version: str) -> str:
    """Write a new version beside the old ones; readers take the newest that has a ``_SUCCESS`` file."""
    df.write.mode("errorifexists").parquet(f"{root}/version={version}")
    return f"{root}/version={version}"


def newest_version(spark: SparkSession, root: str) -> str | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(str(x.getPath().getParent()) for x in (found or []))
    return names[-1] if names else None


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_books(books: DataFrame, path: str, form: str = "json") -> None:
    """Books by root and language."""
    books.write.mode("overwrite").partitionBy("source_root", "language").format(form).save(path)


def routed(books: DataFrame) -> DataFrame:
    """The books with ``route``: empty, covers (one small page) or main."""
    return books.withColumn("route", F.when(F.col("document_type") == "empty", "_empty").when((F.coalesce("total_pages", F.lit(0)) <= 1) & (F.coalesce("size_bytes", F.lit(0)) < 20000), "_covers").otherwise("main"))


def write_routed(books: DataFrame, path: str) -> None:
    routed(books).write.mode("overwrite").partitionBy("route").json(path)


def write_collections(records: DataFrame, path: str) -> None:
    """Records by collection, sorted by number within files."""
    records.repartition("collection").sortWithinPartitions("collection", F.expr("try_cast(number as int)"), "number").write.mode("overwrite").partitionBy("collection").json(path)


def write_report(metrics: DataFrame, per_query: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(f"{path}/summary")
    per_query.write.mode("overwrite").json(f"{path}/queries")


@F.pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified diff of two texts with three lines of context, cut at 9,000 characters."""
    return pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "before", "after", n=3, lineterm=""))[:9000] for a, b in zip(old, new)])
