"""The catalog: inferred fields, counts, search pages, merges, reviews and intake state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx

#: Statuses that may be taken in, and those actions that set a status.
APPROVED = ("approved", "approved_auto", "approved_manual", "approved_lease")
ACTIONS = {"approved": "approved_manual", "approved_manual": "approved_manual", "approved_lease": "approved_lease", "rejected": "rejected", "duplicate": "rejected", "pending_review": "pending_review", "edit": "pending_review"}


def _value(c: str) -> Column:
    return F.nullif(F.lower(tx.strip(F.col(c))), F.lit(""))


def inferred(books: DataFrame) -> DataFrame:
    """The books with source_ext, source_type, document_type and conversion_status filled by rules."""
    path = F.coalesce(tx.filled(F.col("source_path")), tx.filled(F.col("filename")), F.lit(""))
    ext = F.coalesce(_value("source_ext"), F.nullif(tx.extension(path), F.lit("")), F.lit(""))
    books = books.withColumn("i_ext", ext)
    by_ext, by_path = tx.source_type(F.col("i_ext")), tx.source_type(tx.extension(path))
    kind = F.coalesce(F.nullif(_value("source_type"), F.lit("unknown")), F.nullif(by_ext, F.lit("unknown")), F.nullif(by_path, F.lit("unknown")), F.lit("unknown"))
    books = books.withColumn("i_type", kind)
    books = books.withColumn("i_document", F.coalesce(_value("document_type"), F.when(F.col("i_type") == "html", "html_document").otherwise("book")))
    quality = _value("quality_status")
    from_quality = F.when(quality == "quarantine", "failed").when(quality == "warn", "degraded").when(quality == "ok", "good")
    known = (F.col("i_type") != "unknown") | (path != "")
    from_type = F.when(F.col("i_document") == "empty", "failed").when(F.col("i_document").isin("book", "html_document"), "good").when(known, "good").otherwise("unknown")
    conversion = F.coalesce(F.nullif(_value("conversion_status"), F.lit("unknown")), from_quality, from_type)
    return books.withColumn("i_conversion", conversion)


def reinferred(books: DataFrame) -> DataFrame:
    """One row: how many rows the rules change, by column."""
    b = inferred(books)
    changed = {"source_ext": "i_ext", "source_type": "i_type", "document_type": "i_document", "conversion_status": "i_conversion"}
    return b.agg(F.count("*").alias("rows"), *[F.count_if(~F.col(a).eqNullSafe(F.col(n))).alias(f"changed_{a}") for a, n in changed.items()])


def index_counts(books: DataFrame) -> DataFrame:
    """dimension, value, n: counts by language and by three inferred columns, in one pass."""
    b = inferred(books)
    dims = {"language": F.coalesce(_value("language"), F.lit("unknown")), "source_type": F.col("i_type"), "document_type": F.col("i_document"), "conversion_status": F.col("i_conversion"), "review_status": F.coalesce(_value("review_status"), F.lit("unknown")), "quality_status": F.coalesce(_value("quality_status"), F.lit("unknown"))}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in dims.items()]))
    return b.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def stats(books: DataFrame) -> DataFrame:
    """One row of totals: books and pages, ready, pending, rejected."""
    status = F.coalesce(_value("review_status"), F.lit(""))
    pages = F.greatest(F.coalesce("total_pages", F.lit(0)), F.lit(0)).cast("long")
    ready = status.isin(*APPROVED) & (F.coalesce(_value("quality_status"), F.lit("")) != "quarantine")
    return books.agg(
        F.count("*").alias("total_books"), F.sum(pages).alias("total_pages"), F.count_if(ready).alias("ready_books"), F.sum(F.when(ready, pages).otherwise(0)).alias("ready_pages"), F.count_if(status == "pending_review").alias("pending_books"),
        F.count_if(status == "rejected").alias("rejected_books"), F.count_if(_value("quality_status") == "quarantine").alias("quarantined_books"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"),
    )


def library(books: DataFrame, query: str = "", language: str = "", status: str = "", page: int = 1, limit: int = 24, most: int = 96) -> DataFrame:
    """A page of the library: substring over nine fields, language, any of three statuses; sorted and cut at ``most`` rows (500 in plain listings)."""
    limit = min(max(limit, 1), most)
    fields = ("book_id", "filename", "title", "language", "source_type", "document_type", "review_status", "quality_status", "source_path")
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in fields]))
    rows = books.where(hay.contains(query.strip().lower())) if query.strip() else books
    rows = rows.where(_value("language") == language.lower()) if language else rows
    if status:
        rows = rows.where(reduce(lambda a, b: a | b, [F.coalesce(_value(c) == status.lower(), F.lit(False)) for c in ("conversion_status", "review_status", "quality_status")]))
    return rows.orderBy(F.lower(F.coalesce("title", F.lit(""))), "book_id").offset((max(page, 1) - 1) * limit).limit(limit)


def approved(books: DataFrame, languages: str = "id", limit: int | None = None) -> DataFrame:
    """Books that may be taken in: approved ones of the listed languages (``all`` for any), a head limit if given."""
    rows = books.where(_value("review_status").isin(*APPROVED))
    wanted = [x.strip().lower() for x in languages.split(",") if x.strip()]
    if not set(wanted) & {"all", "*"}:
        rows = rows.where(_value("language").isin(*wanted))
    return rows.orderBy("book_id").limit(limit) if limit else rows


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``source`` in place of those with the same keys (keys of one null match)."""
    same = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    kept = target.alias("t").join(source.select(*keys).distinct().alias("s"), same, "left_anti")
    return source.unionByName(kept, allowMissingColumns=True)


def upsert_any(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The same where a row is replaced if any one of ``keys`` is equal: one anti join a key."""
    for k in keys:
        target = target.join(source.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti").select(*target.columns)
    return source.unionByName(target, allowMissingColumns=True)


def set_if_missing(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``target`` with empty columns taken from ``source``; ``filled`` counts the cells."""
    s = source.select(F.col(key).alias("__k"), *[F.col(c).alias(f"s_{c}") for c in columns])
    j = target.join(s, target[key] == s["__k"], "left")
    was = {c: tx.filled(F.col(c).cast("string")).isNull() for c in columns}
    cells = reduce(lambda a, b: a + b, [(was[c] & F.col(f"s_{c}").isNotNull()).cast("int") for c in columns])
    values = {c: F.when(was[c], F.col(f"s_{c}")).otherwise(F.col(c)) for c in columns}
    return j.withColumn("filled", cells).select(*[values[c].alias(c) if c in columns else F.col(c) for c in target.columns], "filled")


def overlay(records: DataFrame, books: DataFrame, key: str, book_first: list[str], record_first: list[str]) -> DataFrame:
    """Records with review and quality fields from the book where it has them, source fields from the record."""
    b = books.select(F.col(key).alias("__k"), *[F.col(c).alias(f"b_{c}") for c in book_first + record_first])
    j = records.join(b, records[key] == b["__k"], "left")
    pick = {c: F.coalesce(tx.filled(F.col(f"b_{c}").cast("string")), F.col(c).cast("string")) for c in book_first} | {c: F.coalesce(tx.filled(F.col(c).cast("string")), F.col(f"b_{c}").cast("string")) for c in record_first}
    return j.select(*[pick[c].alias(c) if c in pick else F.col(c) for c in records.columns])


def review_state(actions: DataFrame, books: DataFrame) -> DataFrame:
    """book_id, status, reviewed_by, actions: the last book action of each known book, by time.

    A fold over events as a ``max_by``: deliveries twice or out of order make no difference.
    """
    scoped = actions.where((_value("scope") == "book") & _value("action").isin(*ACTIONS)).dropDuplicates(["id"]).join(books.select("book_id").distinct(), "book_id", "left_semi")
    at = F.struct("created_at", "id")
    folded = scoped.groupBy("book_id").agg(F.max_by(_value("action"), at).alias("action"), F.max_by("reviewed_by", at).alias("reviewed_by"), F.count("*").alias("actions"))
    status = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col("action")]
    return folded.select("book_id", status.alias("status"), "reviewed_by", "actions", (status != "pending_review").alias("settled"))


def page_review_state(actions: DataFrame) -> DataFrame:
    """book_id, page_num, status: the last page action of each page."""
    scoped = actions.where((_value("scope") == "page") & F.col("page_num").isNotNull()).dropDuplicates(["id"])
    at = F.struct("created_at", "id")
    last = scoped.groupBy("book_id", "page_num").agg(F.max_by(_value("action"), at).alias("action"))
    return last.select("book_id", "page_num", F.when(F.col("action") == "page_reviewed", "reviewed").when(F.col("action") == "page_pending", "pending_review").otherwise("").alias("status"))


def delete_books(tables: dict[str, DataFrame], books: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of ``books``."""
    gone = books.select("book_id").distinct()
    return {name: t.join(gone, "book_id", "left_anti") for name, t in tables.items()}


def intake_actions(books: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """book_id, action, next_batch: new, skip, resume or refresh, from the last state of each book."""
    s = state.select("book_id", F.col("source_hash").alias("was"), "complete", "next_batch_index")
    j = books.select("book_id", "source_hash").join(s, "book_id", "left")
    same = F.col("was").eqNullSafe(F.col("source_hash"))
    action = F.when(F.lit(force) & F.col("complete").isNotNull(), "refresh").when(F.col("complete").isNull(), "new").when(same & F.col("complete"), "skip").when(same, "resume").otherwise("refresh")
    return j.select("book_id", action.alias("action"), F.when(action == "resume", F.col("next_batch_index")).otherwise(0).alias("next_batch"))


def release(bridge: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the bridge without ``books``, chunk hashes that no book holds any more)."""
    kept = bridge.join(books.select("book_id").distinct(), "book_id", "left_anti")
    orphans = bridge.select("chunk_hash").distinct().join(kept.select("chunk_hash").distinct(), "chunk_hash", "left_anti")
    return kept, orphans


def ref_counts(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("chunk_hash").agg(F.count_distinct("book_id").alias("ref_count"))


def numbered(df: DataFrame, partition: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
