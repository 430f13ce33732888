"""The import of a folder of files as one plan: list, hash, skip what is known, extract, check, deduplicate, route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import hashing
from leafmill.functions import text as tx
from leafmill.operators import dedupe, quality
from leafmill.sources import readers
from leafmill.work import stage


def import_folder(spark: SparkSession, folder: str, label: str, seen: DataFrame | None = None, known: DataFrame | None = None, extractors: dict | None = None) -> dict[str, DataFrame]:
    """books, pages, skipped (with the kind of skip) and problems of a folder's files.

    ``seen``: source_hash of files imported before; ``known``: book_id, content_hash, text_hash of
    books imported before. A file is skipped if its bytes are known or repeated, if it has no text,
    or if its text is that of a known or an earlier book. Every stage is a join or an aggregation
    over all files; extracted texts are written once.
    """
    files = readers.with_contents(spark, folder)
    rows = files.withColumns({
        "book_id": tx.book_id(F.lit(label), F.col("relpath")), "filename": F.element_at(F.split("relpath", "/"), -1), "source_type": tx.source_type(F.col("ext")), "language": tx.language_from_path(F.col("path")),
        "title": tx.clean_title(F.regexp_replace(F.element_at(F.split("relpath", "/"), -1), "\\.[^.]*$", "")),
    }).withColumnsRenamed({"length": "size_bytes", "ext": "source_ext", "path": "source_path"})
    first = dedupe.first_by_source_hash(rows.drop("content"), seen).select("book_id")
    fresh = rows.join(first, "book_id", "left_semi").withColumnRenamed("source_ext", "ext")
    extracted = stage(readers.extract(fresh, extractors).withColumnRenamed("ext", "source_ext"), "extracted")
    pages = readers.numbered_pages(extracted, "book_id")
    signed = dedupe.signatures(pages, lambda t: tx.normalize_import(t))
    books = extracted.drop("pages", "modified").join(signed, "book_id", "left")
    empty = F.col("content_hash").isNull()
    filled = books.where(~empty)
    # The earliest of equal texts stays: by content hash, then by text hash.
    order = [F.col("size_bytes"), F.col("source_ext"), F.col("source_path")]
    new = dedupe.keep_first(dedupe.keep_first(filled, ["content_hash"], order), ["text_hash"], order)
    if known is not None:
        for h in ("content_hash", "text_hash"):
            new = new.join(known.where(F.col(h).isNotNull()).select(h).distinct(), h, "left_anti")
    q = quality.book_quality(pages.join(new.select("book_id", "language", F.col("source_path").alias("path")), "book_id"), new.select("book_id", "language", F.col("source_path").alias("path"), "extractor", "size_bytes"))
    out = new.join(quality.routing(q).withColumnRenamed("status", "quality_status"), "book_id").join(q.select("book_id", "reasons", "warnings", "script"), "book_id")
    kept = new.select("book_id")
    normal = pages.join(kept, "book_id", "left_semi").select("book_id", tx.normalize_import(F.col("content")).alias("t"))
    simhash = hashing.simhash_by(normal, "book_id", "t").withColumnRenamed("simhash", "text_simhash")
    skipped = (
        rows.select("book_id", "source_hash").join(first, "book_id", "left_anti").select("book_id", F.lit("source_hash_skip").alias("kind"))
        .unionByName(books.where(empty).select("book_id", F.when(F.col("problem").isNotNull(), "problem").otherwise("empty_after_extraction").alias("kind")))
        .unionByName(filled.join(kept, "book_id", "left_anti").select("book_id", F.lit("content_family_skip").alias("kind")))
    )
    return {"books": out.join(simhash, "book_id", "left"), "pages": pages.join(kept, "book_id", "left_semi"), "skipped": skipped, "problems": books.where("problem IS NOT NULL").select("book_id", "problem")}
