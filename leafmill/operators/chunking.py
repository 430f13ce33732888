"""Chunks of books for retrieval: long texts in overlapping parts, short pages merged by windows."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import hashing
from leafmill.functions.text import strip

LIMIT, OVERLAP, LEAST = 500, 50, 80
#: Page numbers of a book that are looked at in one task.
RANGE = 10_000


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """The parts of a text: cut after the last line feed in a window's second half; only without any line
    feed after the last space there; else at the limit. Each part repeats ``overlap`` characters."""
    parts, at, half = [], 0, limit // 2
    while at + limit < len(text):
        feed = text.rfind("\n", at, at + limit) - at + 1
        space = text.rfind(" ", at, at + limit) - at + 1
        size = feed if feed > half + 1 else space if feed <= 0 and space > half + 1 else limit
        parts.append(text[at : at + size])
        at += size - overlap
    return [*parts, text[at:]]


@functools.lru_cache(None)
def _cutter(limit: int, overlap: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_text(t, limit, overlap) for t in texts], dtype=object)

    return cut


def split_parts(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """``cut_text`` as a column function, linear in the text; texts within the limit stay in the JVM."""
    return F.coalesce(_cutter(limit, overlap)(F.when(F.length(text) > limit, text)), F.array(text))


def is_metadata(text: Column) -> Column:
    """Pages without running text: very short, a cover, a link, or a year."""
    lines = F.split(text, "\n")
    return (F.length(text) < 30) | ((F.size(lines) <= 3) & F.contains(F.lower(text), F.lit("cover"))) | (text.contains("HYPERLINK") & (F.length(text) < 300)) | text.rlike("^[0-9]{4}\\s*[Hh]\\s*$")


def is_heading(text: Column) -> Column:
    """Headings: numbered, in capitals, or one capitalised line."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    shout = (F.upper(first) == first) & (F.lower(first) != first)
    head = F.left(first, F.lit(1))
    capital = (F.upper(head) == head) & (F.lower(head) != head)
    return (F.length(text) <= 120) & (first != "") & (first.rlike("^\\p{Nd}+[.)](?U)\\s") | first.rlike("^[IVXLCDM]+\\.?(?U)\\s") | ((F.length(first) < 80) & (shout | ((F.size(lines) == 1) & capital))))


def chunk_books(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """book_id, unit, page_start, page_end, chunk_idx, text: the chunks of each book in order.

    Long pages are units of their own. A short heading begins a unit unless the page just before it
    was kept; any other short page, and such a heading, belongs to the unit before it. What comes
    before the first unit is dropped. These are windows over narrow rows (kinds and page numbers) of
    ``RANGE`` page numbers of a book; what one range hands on to the next (its last page, the units so
    far) is a row a range. Only a unit's own texts are put together.
    """
    kept = pages.select("book_id", "page_num", strip(F.coalesce("content", F.lit(""))).alias("text")).where((F.length("text") > 0) & ~is_metadata(F.col("text")))
    kept = kept.withColumn("long", F.length("text") >= least).withColumn("heading", ~F.col("long") & is_heading(F.col("text"))).withColumn("range", F.floor(F.col("page_num") / RANGE))
    narrow = kept.select("book_id", "range", "page_num", "long", "heading")
    first = narrow.where("long OR heading").groupBy("book_id").agg(F.min("page_num").alias("first"))
    live = narrow.join(first, "book_id").where("page_num >= first").drop("first")
    order = Window.partitionBy("book_id", "range").orderBy("page_num")
    ranges = Window.partitionBy("book_id").orderBy("range")
    last = live.groupBy("book_id", "range").agg(F.max("page_num").alias("last")).select("book_id", "range", F.lag("last").over(ranges).alias("carried"))
    rows = live.join(last, ["book_id", "range"]).withColumn("before", F.coalesce(F.lag("page_num").over(order), "carried"))
    rows = rows.withColumn("begins", F.col("long") | (F.col("heading") & ~F.coalesce(F.col("before") == F.col("page_num") - 1, F.lit(False))))
    begun = rows.groupBy("book_id", "range").agg(F.count_if("begins").alias("n")).select("book_id", "range", F.coalesce(F.sum("n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("so_far"))
    within = F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(begun, ["book_id", "range"]).withColumn("unit", F.col("so_far") + within)
    # In a unit that a heading began, short pages up to the next heading are split together with it.
    own = Window.partitionBy("book_id", "unit").orderBy("page_num").rowsBetween(Window.unboundedPreceding, 0)
    closed = F.sum((F.col("heading") & ~F.col("begins")).cast("int")).over(own) > 0
    rows = rows.withColumn("body", F.when(F.first("long").over(own), F.col("begins")).otherwise(~closed))
    texts = rows.select("book_id", "page_num", "unit", "body").join(kept.select("book_id", "page_num", "text"), ["book_id", "page_num"])
    units = texts.groupBy("book_id", "unit").agg(F.array_sort(F.collect_list(F.struct("page_num", "body", "text"))).alias("items"))
    body, tail = F.filter("items", lambda x: x["body"]), F.filter("items", lambda x: ~x["body"])
    joined = lambda x: F.array_join(F.transform(x, lambda i: i["text"]), "\n\n")
    units = units.withColumns({"body": body, "tail": tail}).withColumn("parts", split_parts(joined("body")))
    each = units.select("book_id", "unit", "body", "tail", F.size("parts").alias("n"), F.posexplode("parts").alias("chunk_idx", "part"))
    extended = (F.col("chunk_idx") == F.col("n") - 1) & (F.size("tail") > 0)
    end = F.when(extended, F.element_at("tail", -1)["page_num"]).otherwise(F.element_at("body", -1)["page_num"])
    return each.select("book_id", "unit", F.element_at("body", 1)["page_num"].alias("page_start"), end.alias("page_end"), "chunk_idx", F.when(extended, F.concat("part", F.lit("\n\n"), joined("tail"))).otherwise(F.col("part")).alias("text"))


def identified(chunks: DataFrame) -> DataFrame:
    """The chunks with chunk_hash and point_id."""
    h = hashing.chunk_hash(F.col("book_id"), F.col("page_start"), F.col("page_end"), F.col("chunk_idx"), F.col("text"))
    return chunks.withColumn("chunk_hash", h).withColumn("point_id", hashing.point_id(F.col("chunk_hash")))


def batches(chunks: DataFrame, size: int = 128) -> DataFrame:
    """The chunks with the number of their batch within the book."""
    order = Window.partitionBy("book_id").orderBy("unit", "chunk_idx")
    return chunks.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
