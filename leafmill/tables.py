"""Reading the engine's tables, and the current state of upserted ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a missing update time: it loses against any real one.
LONG_AGO = "0001-01-01 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir`` (a Parquet file or folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def updated(column: str = "updated_at") -> Column:
    """The update time of a row, with a null as the earliest time of all."""
    return F.coalesce(F.col(column).cast("timestamp_ntz"), F.lit(LONG_AGO).cast("timestamp_ntz"))


def current_rows(df: DataFrame, keys: Sequence[str], time: str = "updated_at") -> DataFrame:
    """The row with the greatest ``time`` of each key; equal copies count once.

    A null time loses; rows of one key and time that differ elsewhere are settled by a hash of
    all their columns, so the result is the same on every run. Null keys form a key of their own.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last(), F.xxhash64(*df.columns))
    return df.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")
