"""Index records: their paths, fields carried over from books, states as JSON, and what an edit changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import hashing
from leafmill.functions import text as tx
from leafmill.operators import catalog, dedupe

#: Fixed value: the folder that a relative path of a book file may begin with.
OUTPUT = "json_output"
STATE = "struct<source_hash:string,next_batch_index:int,complete:boolean,chunk_hashes:array<string>,point_count:int,updated_at:double>"
CHUNK = "struct<point_id:string,ref_count:int,first_seen_at:double>"


def normal_path(path: Column) -> Column:
    """A relative path without empty parts, ``.`` and ``..`` where a part before it can go; ``.`` if nothing is left."""

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        return F.when(part.isin("", "."), done).when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.coalesce(F.nullif(F.array_join(parts, "/"), F.lit("")), F.lit("."))


def json_path(path: Column, filename: Column, folder: str) -> Column:
    """Where a record's book file lies: its absolute path, else its relative one below ``folder``, else by the file name."""
    normal = normal_path(path)
    below = F.when(normal == OUTPUT, folder).otherwise(F.concat(F.lit(f"{folder}/"), F.regexp_replace(normal, f"^{OUTPUT}/", "")))
    named = F.concat(F.lit(f"{folder}/"), F.coalesce(filename, F.lit("")), F.lit(".json"))
    return F.when(F.coalesce(path, F.lit("")) == "", named).when(path.startswith("/"), path).otherwise(below)


def source_files(records: DataFrame, files: DataFrame, key: str = "book_id") -> DataFrame:
    """key, path: the first existing file of four that a record may mean; null without one.

    In order: source_path, source_root/source_relpath, source_relpath, filename. ``files``: path of each
    existing file. One equi-join of the candidates with the listing.
    """
    value = {c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in ("source_path", "source_root", "source_relpath", "filename")}
    candidates = [value["source_path"], F.concat(value["source_root"], F.lit("/"), value["source_relpath"]), value["source_relpath"], value["filename"]]
    each = records.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.alias("path")) for i, c in enumerate(candidates)])).alias("c")).select(key, "c.i", "c.path")
    found = each.join(files.select("path").distinct(), "path").groupBy(key).agg(F.min_by("path", "i").alias("path"))
    return records.select(key).join(found, key, "left")


def json_text(values: Column) -> Column:
    """An array of strings as JSON text with a space after each comma; null gives an empty text."""
    one = lambda x: F.regexp_replace(F.to_json(F.array(x)), "^\\[|\\]$", "")
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(values, one), ", "), F.lit("]")), F.lit(""))


def states(raw: DataFrame, column: str = "state") -> tuple[DataFrame, DataFrame]:
    """(book states, chunk states) from JSON texts: ``{"books": ..., "chunks": ...}`` or, as it was once, only the books.

    Broken texts and entries that are no objects give no rows; missing values are 0, false or empty.
    """
    text = F.col(column)
    whole = F.get_json_object(text, "$.books").isNotNull() | F.get_json_object(text, "$.chunks").isNotNull()
    books = F.when(whole, F.get_json_object(text, "$.books")).otherwise(text)
    rows = raw.select(F.from_json(books, "map<string,string>").alias("b"), F.from_json(F.when(whole, F.get_json_object(text, "$.chunks")), "map<string,string>").alias("c"))
    each = lambda column, key, schema: rows.select(F.explode(column).alias(key, "v")).where("v LIKE '{%'").select(key, F.from_json("v", schema).alias("s"))
    b = each("b", "book_id", STATE)
    b = b.select("book_id", F.coalesce("s.source_hash", F.lit("")).alias("source_hash"), F.coalesce("s.next_batch_index", F.lit(0)).alias("next_batch_index"), F.coalesce("s.complete", F.lit(False)).alias("complete"), F.coalesce("s.chunk_hashes", F.array().cast("array<string>")).alias("chunk_hashes"), F.coalesce("s.point_count", F.lit(0)).alias("point_count"), F.coalesce("s.updated_at", F.lit(0.0)).alias("updated_at"))
    return b, each("c", "chunk_hash", CHUNK).select("chunk_hash", F.coalesce("s.point_id", hashing.point_id(F.col("chunk_hash"))).alias("point_id"), F.coalesce("s.ref_count", F.lit(0)).alias("ref_count"), F.coalesce("s.first_seen_at", F.lit(0.0)).alias("first_seen_at"))


#: Fields that content rows take over from the index.
CARRIED = ("source_path", "source_relpath", "source_ext", "source_type", "document_type", "conversion_status")


def carried_over(content: DataFrame, index: DataFrame) -> DataFrame:
    """``content`` with six source fields of the index record of the same normalised json_path, and ``changed``: how many cells differ now."""
    i = catalog.inferred(index)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    values = {"source_path": text("source_path"), "source_relpath": text("source_relpath"), "source_ext": F.col("i_ext"), "source_type": F.col("i_type"), "document_type": F.col("i_document"), "conversion_status": F.col("i_conversion")}
    lookup = i.select(normal_path(text("json_path")).alias("__path"), *[v.alias(f"n_{c}") for c, v in values.items()], F.lit(True).alias("__hit")).dropDuplicates(["__path"])
    j = content.withColumn("__path", normal_path(F.coalesce("json_path", F.lit("")))).join(lookup, "__path", "left")
    differs = reduce(lambda a, b: a + b, [(F.col("__hit").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"n_{c}"))).cast("int") for c in CARRIED])
    new = {c: F.when(F.col("__hit"), F.col(f"n_{c}")).otherwise(F.col(c)) for c in CARRIED}
    return j.withColumn("changed", differs).select(*[new[c].alias(c) if c in new else F.col(c) for c in content.columns], "changed")


def stamped(files: DataFrame, index: DataFrame, root: str) -> DataFrame:
    """What files of empty documents that no index record names are stamped with. ``files``: name (``x.suffix.json``)."""
    source = F.regexp_replace("name", "\\.json$", "")
    ext = F.lower(F.regexp_extract(source, "[^.](\\.[^.]*)$", 1))
    rows = files.join(index.select(F.concat("filename", F.lit(".json")).alias("name")).distinct(), "name", "left_anti")
    kind = F.coalesce(F.nullif(F.regexp_replace(ext, "^\\.", ""), F.lit("")), F.lit("unknown"))
    return rows.select("name", F.lit(root).alias("source_root"), F.concat(F.lit(f"{root}/"), source).alias("source_path"), source.alias("source_relpath"), ext.alias("source_ext"), kind.alias("source_type"), F.lit("empty").alias("document_type"), F.lit("failed").alias("conversion_status"))


def synchronised(edited: DataFrame, pages: DataFrame, index: DataFrame, content: DataFrame, bridge: DataFrame, compat: bool = True) -> dict[str, DataFrame]:
    """What an edit of books changes: ``index`` and ``content`` rows anew, ``released`` chunk hashes, ``summary`` counts.

    ``edited``: book_id and columns that take the place of the index's; content rows are signed again by
    the rules for edits. Tables derived from these follow when they are computed again.
    """
    columns = [c for c in edited.columns if c != "book_id"]
    new = index.drop(*columns).join(edited, "book_id").select(*index.columns)
    index = catalog.upsert(index, new, ["book_id"])
    own = pages.join(edited.select("book_id").distinct(), "book_id", "left_semi")
    signed = dedupe.signatures(own, lambda t: tx.normalize_edit(t, compat=compat), "\n")
    rows = content.drop("content_hash", "text_hash", "page_count").join(edited.select("book_id"), "book_id", "left_semi").join(signed, "book_id", "left").select(*content.columns)
    return {"index": index, "content": catalog.upsert(content, rows, ["book_id"]), "released": catalog.release(bridge, edited)[1], "summary": catalog.index_counts(index)}


def promotions(actions: DataFrame, promote: Column) -> DataFrame:
    """book_id, page_num, review_status and the fields that a page review sets on its book where it promotes it: the last one counts."""
    scope, action = F.lower(F.trim("scope")), F.lower(F.trim("action"))
    rows = actions.where((scope == "page") & F.col("page_num").isNotNull() & action.isin("page_reviewed", "reviewed", "page_pending", "pending_review") & promote)
    last = rows.groupBy("book_id").agg(F.max_by(F.struct("page_num", "reviewed_by", "note"), F.struct("created_at", "id")).alias("m"))
    who = F.coalesce(F.nullif("m.reviewed_by", F.lit("")), F.lit("manual"))
    note = F.coalesce(F.nullif("m.note", F.lit("")), F.lit("page reviewed and promoted"))
    return last.select("book_id", "m.page_num", F.lit("approved_manual").alias("review_status"), F.lit(False).alias("review_required"), who.alias("review_route"), who.alias("reviewed_by"), note.alias("review_note"))


def page_at(pages: Column, number: Column) -> Column:
    """(text, page, total) of a numbered page, the nearest one where the number is out of range; empty without pages."""
    total = F.size(pages)
    at = F.least(F.greatest(F.coalesce(number, F.lit(1)), F.lit(1)), F.greatest(total, F.lit(1)))
    page = F.when(total > 0, at).otherwise(F.greatest(F.coalesce(number, F.lit(1)), F.lit(1)))
    return F.struct(F.coalesce(F.get(pages, at - 1), F.lit("")).alias("text"), page.alias("page"), F.greatest(total, F.lit(0)).alias("total"))
