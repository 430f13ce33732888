"""Tables that a query writes on its way, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset, a session that runs in one process gets a temporary folder; on a cluster
    that is an error, as executors would each write to a disk of their own.
    """
    named = spark.conf.get(_FOLDER, None)
    if named:
        return named
    context = spark.sparkContext
    if not (context.master or "").startswith("local") or (context.master or "").startswith("local-cluster"):
        raise RuntimeError(f"set {_FOLDER} to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="leafmill-")
        atexit.register(shutil.rmtree, _own[context.applicationId], ignore_errors=True)
    return _own[context.applicationId]


def stage(df: DataFrame, what: str, partition_by: list[str] | None = None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the whole of what came
    before. The files stay until ``release`` or the driver's end, as frames may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def release() -> None:
    """Remove the tables staged so far; call it when the queries that read them are done."""
    while _written:
        _remove(*_written.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001 - the session may have ended before
        pass


atexit.register(release)
