"""Incremental intake as a stream of book and page rows into chunk tables.

The stream's checkpoint takes the place of a journal: a batch that was cut off is run again, and
writing a batch under its own number makes that harmless. Reference counts are derived, not kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators import chunking
from leafmill.tables import current_rows


def chunk_batch(pages: DataFrame) -> DataFrame:
    """The identified chunks of one batch of whole books."""
    return chunking.identified(chunking.chunk_books(current_rows(pages, ["book_id", "page_num"])))


#: Folders that the pages taken in so far are spread over, by a hash of the book.
BUCKETS = 64


def take_in(batch: DataFrame, number: int, out: str) -> None:
    """Store a batch of pages, and chunk every book it has pages of anew, from all its pages so far.

    A book's pages may arrive in any number of batches. Both writes replace what an earlier try of the same
    batch left; only the folders of the batch's books are read.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("book_id"), F.lit(BUCKETS)).cast("int")
    batch.withColumns({"bucket": bucket}).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/pages/batch={number}")
    books = spark.read.parquet(f"{out}/pages/batch={number}").select("book_id", "bucket").distinct()
    wanted = [r.bucket for r in books.select("bucket").distinct().collect()]  # BUCKETS numbers at most
    if not wanted:
        return
    so_far = spark.read.parquet(f"{out}/pages").where(F.col("batch") <= number).where(F.col("bucket").isin(wanted)).join(books.select("book_id"), "book_id", "left_semi")
    # Of states with the same time the one delivered last counts.
    order = Window.partitionBy("book_id", "page_num").orderBy(F.col("updated_at").desc_nulls_last(), F.desc("batch"), F.xxhash64(*batch.columns))
    latest = so_far.withColumn("__rank", F.row_number().over(order)).where("__rank = 1")
    chunk_batch(latest.select(*batch.columns)).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")


def start(spark: SparkSession, pages_path: str, schema, out: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Chunk all page files that are new since the last run, then stop."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pages_path)
    return stream.writeStream.foreachBatch(lambda batch, number: take_in(batch, number, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def taken_in(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of each book, from the last batch that had pages of it."""
    rows = spark.read.parquet(f"{out}/chunks")
    last = rows.groupBy("book_id").agg(F.max("batch").alias("last"))
    return rows.join(last, "book_id").where("batch = last").drop("last")


def review_counts(actions: DataFrame, delay: str = "30 days", window: str = "7 days") -> DataFrame:
    """Actions by week and kind over a stream of review actions; repeated deliveries count once."""
    events = actions.select("id", F.lower(F.trim("action")).alias("action"), F.col("created_at").cast("timestamp").alias("at"))
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"]).groupBy(F.window("at", window), "action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("week"), "action", "n")
