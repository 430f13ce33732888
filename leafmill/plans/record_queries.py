"""Queries of index records: paths, carried fields, states, edits and promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import dedupe, records
from leafmill.plans import sql
from leafmill.plans.catalog_queries import _BRIDGE, _INFER, _books, _bridge, _pages, _signature
from leafmill.tables import current_rows, load


def index_json_paths(spark: SparkSession, d: str) -> DataFrame:
    """Where each record's book file lies."""
    return _books(spark, d).select("book_id", records.json_path(F.col("json_path"), F.col("filename"), "/rak").alias("path"))


def _files(b: DataFrame) -> DataFrame:
    """A listing: the source paths of some records, and the paths below their roots of others."""
    return b.where("size_bytes % 2 = 0").selectExpr("source_path AS path").unionAll(b.where("size_bytes % 3 = 0").selectExpr("concat(source_root, '/', source_relpath) AS path")).unionAll(b.where("size_bytes % 5 = 0").selectExpr("filename AS path"))


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """The first existing file that each record may mean."""
    b = _books(spark, d)
    return records.source_files(b, _files(b))


def json_texts(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of the query set as JSON text."""
    return load(spark, d, "eval_items").select("item_id", records.json_text(F.col("must_have")).alias("must_have"), records.json_text(F.col("expected_titles")).alias("expected_titles"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """A state as JSON for each book: in the old form, in the present one, or broken."""
    n = F.coalesce("size_bytes", F.lit(0))
    entry = F.concat(F.lit('{"source_hash": "'), F.coalesce("source_hash", F.lit("")), F.lit('", "next_batch_index": '), (n % 7).cast("string"), F.lit(', "complete": '), F.when(n % 2 == 0, "true").otherwise("false"), F.lit("}"))
    flat = F.concat(F.lit('{"'), "book_id", F.lit('": '), entry, F.lit("}"))
    chunks = F.concat(F.lit('{"h'), "book_id", F.lit('": {"ref_count": '), (n % 5).cast("string"), F.lit("}}"))
    whole = F.concat(F.lit('{"books": '), flat, F.lit(', "chunks": '), chunks, F.lit("}"))
    return _books(spark, d).select(F.when(n % 3 == 0, flat).when(n % 3 == 1, whole).otherwise("{broken").alias("state"))


def intake_states(spark: SparkSession, d: str) -> DataFrame:
    """Book states of both forms as rows."""
    return records.states(_raw(spark, d))[0].select("book_id", "source_hash", "next_batch_index", "complete", F.size("chunk_hashes").alias("chunks"), "point_count")


def chunk_states(spark: SparkSession, d: str) -> DataFrame:
    """Chunk states as rows, with point ids where none is stored."""
    return records.states(_raw(spark, d))[1].select("chunk_hash", "point_id", "ref_count")


def carried_fields(spark: SparkSession, d: str) -> DataFrame:
    """Early content rows with the source fields of the current index, and how many cells changed."""
    old = current_rows(load(spark, d, "books").where("updated_at < '2025-01-01'"), ["book_id"]).select("book_id", "json_path", *records.CARRIED)
    return records.carried_over(old, _books(spark, d))


def stamped_empties(spark: SparkSession, d: str) -> DataFrame:
    """Stamps of book files that no current record names."""
    names = load(spark, d, "books").where("filename <> ''").selectExpr("concat(filename, '.json') AS name").distinct()
    index = _books(spark, d).where("coalesce(total_pages, 0) > 5")
    return records.stamped(names, index, "/arsip")


def _edited(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "review_actions").where("lower(trim(action)) = 'pending_review' AND book_id IS NOT NULL").select("book_id", F.lit("pending_review").alias("review_status")).distinct()


def _synchronised(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    b = _books(spark, d)
    content = b.select("book_id", "content_hash", "text_hash", F.col("total_pages").alias("page_count"))
    return records.synchronised(_edited(spark, d), _pages(spark, d, "content"), b, content, _bridge(spark, d), compat=False)


def edit_sync_content(spark: SparkSession, d: str) -> DataFrame:
    """Content rows after an edit: those of edited books are signed again."""
    return _synchronised(spark, d)["content"].withColumn("page_count", F.coalesce(F.col("page_count").cast("long"), F.lit(0)))


def edit_sync_index(spark: SparkSession, d: str) -> DataFrame:
    """Index rows after an edit."""
    return _synchronised(spark, d)["index"].select("book_id", "review_status", "title")


def edit_sync_released(spark: SparkSession, d: str) -> DataFrame:
    """Page texts that no book but the edited ones held."""
    return _synchronised(spark, d)["released"]


def page_promotions(spark: SparkSession, d: str) -> DataFrame:
    """Books that a page review with a note promotes."""
    return records.promotions(load(spark, d, "review_actions"), F.coalesce(F.trim("note") != "", F.lit(False)))


def preview_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of each document, or its nearest."""
    page = records.page_at(tx.split_pages(F.coalesce("text", F.lit(""))), F.lit(3))
    return load(spark, d, "documents").select("doc_id", page.alias("p")).select("doc_id", "p.*")


def stored_points(spark: SparkSession, d: str) -> DataFrame:
    """Of points with the same page text the one that stays."""
    points = _pages(spark, d, "page_text_hash").where("page_text_hash <> ''").select(F.col("page_text_hash").alias("chunk_hash"), F.when(F.col("page_num") % 2 == 0, F.col("page_num").cast("string")).otherwise(F.concat(F.lit("p-"), "book_id")).alias("point_id"))
    return dedupe.stored_points(points)


QUERIES = {f.__name__: f for f in (index_json_paths, source_files, json_texts, intake_states, chunk_states, carried_fields, stamped_empties, edit_sync_content, edit_sync_index, edit_sync_released, page_promotions, preview_page, stored_points)}

_N = "coalesce(size_bytes, 0)"
_NORMAL = lambda c: f"coalesce(nullif(array_to_string(list_filter(string_split(coalesce({c}, ''), '/'), lambda x: x NOT IN ('', '.')), '/'), ''), '.')"  # noqa: E731 - without parent folders, which the tables don't have
_LISTED = f"SELECT source_path AS path FROM {sql.BOOKS} WHERE size_bytes % 2 = 0 UNION SELECT source_root || '/' || source_relpath FROM {sql.BOOKS} WHERE size_bytes % 3 = 0 UNION SELECT filename FROM {sql.BOOKS} WHERE size_bytes % 5 = 0"
_LIST = lambda c: f"coalesce('[' || array_to_string(list_transform({c}, lambda x: to_json(x)::VARCHAR), ', ') || ']', '')"
_EDITED = "(SELECT DISTINCT book_id FROM review_actions WHERE lower(trim(action)) = 'pending_review' AND book_id IS NOT NULL)"
_URL = "'6ba7b8119dad11d180b400c04fd430c8'"


def uuid5(name: str) -> str:
    """SQL of the name-based UUID of a name in the URL namespace."""
    h = f"sha1(unhex({_URL}) || encode({name}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"


ORACLES = {
    "index_json_paths": f"SELECT book_id, CASE WHEN coalesce(json_path, '') = '' THEN '/rak/' || coalesce(filename, '') || '.json' WHEN starts_with(json_path, '/') THEN json_path WHEN {_NORMAL('json_path')} = 'json_output' THEN '/rak' ELSE '/rak/' || regexp_replace({_NORMAL('json_path')}, '^json_output/', '') END AS path FROM {sql.BOOKS}",
    "source_files": f"""WITH f AS ({_LISTED}), c AS (SELECT book_id, i, path FROM (SELECT book_id, unnest([nullif(trim(coalesce(source_path, '')), ''), nullif(trim(coalesce(source_root, '')), '') || '/' || nullif(trim(coalesce(source_relpath, '')), ''), nullif(trim(coalesce(source_relpath, '')), ''), nullif(trim(coalesce(filename, '')), '')]) AS path, unnest([0, 1, 2, 3]) AS i FROM {sql.BOOKS})),
        h AS (SELECT book_id, arg_min(path, i) AS path FROM c WHERE path IN (SELECT path FROM f WHERE path IS NOT NULL) GROUP BY 1) SELECT b.book_id, h.path FROM {sql.BOOKS} b LEFT JOIN h USING (book_id)""",
    "json_texts": f"SELECT item_id, {_LIST('must_have')} AS must_have, {_LIST('expected_titles')} AS expected_titles FROM eval_items",
    "intake_states": f"SELECT book_id, coalesce(source_hash, '') AS source_hash, ({_N} % 7)::INT AS next_batch_index, {_N} % 2 = 0 AS complete, 0 AS chunks, 0 AS point_count FROM {sql.BOOKS} WHERE {_N} % 3 < 2",
    "chunk_states": f"WITH h AS (SELECT 'h' || book_id AS chunk_hash, ({_N} % 5)::INT AS ref_count FROM {sql.BOOKS} WHERE {_N} % 3 = 1) SELECT chunk_hash, {uuid5("'rag-chunk:' || chunk_hash")} AS point_id, ref_count FROM h",
    "carried_fields": _INFER + f""", o AS (SELECT * FROM books WHERE updated_at < '2025-01-01' QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY updated_at DESC) = 1),
        l AS (SELECT {_NORMAL('json_path')} AS path, any_value(coalesce(source_path, '')) AS n1, any_value(coalesce(source_relpath, '')) AS n2, any_value(ie) AS n3, any_value(it) AS n4, any_value(idoc) AS n5, any_value(ic) AS n6 FROM i GROUP BY 1)
        SELECT book_id, json_path, CASE WHEN path IS NULL THEN source_path ELSE n1 END AS source_path, CASE WHEN path IS NULL THEN source_relpath ELSE n2 END AS source_relpath, CASE WHEN path IS NULL THEN source_ext ELSE n3 END AS source_ext, CASE WHEN path IS NULL THEN source_type ELSE n4 END AS source_type, CASE WHEN path IS NULL THEN document_type ELSE n5 END AS document_type, CASE WHEN path IS NULL THEN conversion_status ELSE n6 END AS conversion_status,
        CASE WHEN path IS NULL THEN 0 ELSE (source_path IS DISTINCT FROM n1)::INT + (source_relpath IS DISTINCT FROM n2)::INT + (source_ext IS DISTINCT FROM n3)::INT + (source_type IS DISTINCT FROM n4)::INT + (document_type IS DISTINCT FROM n5)::INT + (conversion_status IS DISTINCT FROM n6)::INT END AS changed FROM o LEFT JOIN l ON l.path = {_NORMAL('o.json_path')}""",
    "stamped_empties": rf"""WITH n AS (SELECT DISTINCT filename AS f FROM books WHERE filename <> ''), e AS (SELECT f, lower(regexp_extract(f, '[^.](\.[^.]*)$', 1)) AS ext FROM n WHERE f NOT IN (SELECT filename FROM {sql.BOOKS} WHERE coalesce(total_pages, 0) > 5 AND filename IS NOT NULL))
        SELECT f || '.json' AS name, '/arsip' AS source_root, '/arsip/' || f AS source_path, f AS source_relpath, ext AS source_ext, coalesce(nullif(regexp_replace(ext, '^\.', ''), ''), 'unknown') AS source_type, 'empty' AS document_type, 'failed' AS conversion_status FROM e""",
    "edit_sync_content": f"""WITH s AS ({_signature(sql.collapse(sql.low(r"regexp_replace(coalesce(content, ''), '[\f\x{a0}]', ' ', 'g')")), 'chr(10)')})
        SELECT b.book_id, CASE WHEN e.book_id IS NULL THEN b.content_hash ELSE s.content_hash END AS content_hash, CASE WHEN e.book_id IS NULL THEN b.text_hash ELSE s.text_hash END AS text_hash, coalesce(CASE WHEN e.book_id IS NULL THEN b.total_pages ELSE s.page_count END, 0)::BIGINT AS page_count FROM {sql.BOOKS} b LEFT JOIN {_EDITED} e USING (book_id) LEFT JOIN s ON s.book_id = b.book_id""",
    "edit_sync_index": f"SELECT b.book_id, CASE WHEN e.book_id IS NULL THEN review_status ELSE 'pending_review' END AS review_status, title FROM {sql.BOOKS} b LEFT JOIN {_EDITED} e USING (book_id)",
    "edit_sync_released": f"SELECT DISTINCT chunk_hash FROM {_BRIDGE} WHERE chunk_hash NOT IN (SELECT chunk_hash FROM {_BRIDGE} WHERE book_id NOT IN (SELECT book_id FROM {_EDITED}))",
    "page_promotions": """SELECT book_id, page_num, 'approved_manual' AS review_status, false AS review_required, coalesce(nullif(reviewed_by, ''), 'manual') AS review_route, coalesce(nullif(reviewed_by, ''), 'manual') AS reviewed_by, note AS review_note FROM review_actions
        WHERE lower(trim(scope)) = 'page' AND page_num IS NOT NULL AND lower(trim(action)) IN ('page_reviewed', 'reviewed', 'page_pending', 'pending_review') AND trim(note) <> '' QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY created_at DESC, id DESC) = 1""",
    "preview_page": rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\f+'), lambda x: {sql.strip('x')}), lambda x: x <> '') AS ps FROM documents)
        SELECT doc_id, coalesce(ps[least(3, greatest(len(ps), 1))], '') AS text, CASE WHEN len(ps) > 0 THEN least(3, len(ps)) ELSE 3 END::INT AS page, len(ps)::INT AS total FROM p""",
    "stored_points": f"""WITH p AS (SELECT page_text_hash AS chunk_hash, CASE WHEN page_num % 2 = 0 THEN page_num::VARCHAR ELSE 'p-' || book_id END AS point_id FROM {sql.PAGES} WHERE page_text_hash <> '')
        SELECT chunk_hash, coalesce(min(CASE WHEN NOT regexp_matches(point_id, '^[0-9]+$') THEN point_id END), min(point_id)) AS point_id, count(*) AS points FROM p GROUP BY 1""",
}
