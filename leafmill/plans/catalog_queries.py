"""Queries of signatures, duplicates, families and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import work
from leafmill.functions import text as tx
from leafmill.operators import catalog, chunking, dedupe
from leafmill.plans import sql
from leafmill.plans.quality_queries import _PARTS
from leafmill.tables import current_rows, load


def _books(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(load(spark, d, "books"), ["book_id"])


def _pages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_rows(load(spark, d, "pages").select("book_id", "page_num", *columns, "updated_at"), ["book_id", "page_num"])


def _families(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(load(spark, d, "book_families"), ["family_key"])


def content_signature(spark: SparkSession, d: str) -> DataFrame:
    """Content and text hashes of every book, as for import."""
    s = dedupe.signatures(_pages(spark, d, "content"), lambda t: tx.normalize_import(t, compat=False))
    return s.select("book_id", "content_hash", "text_hash", "page_count")


def edit_signature(spark: SparkSession, d: str) -> DataFrame:
    """The same as for edited books, which keep punctuation and join pages by line feeds."""
    s = dedupe.signatures(_pages(spark, d, "content"), lambda t: tx.normalize_edit(t, compat=False), "\n")
    return s.select("book_id", "content_hash", "text_hash", "page_count")


def source_hash_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first file of each source hash that no family has seen."""
    return dedupe.first_by_source_hash(_books(spark, d), _families(spark, d)).select("source_hash", "book_id")


def family_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each book's family by exact hashes."""
    return dedupe.family_lookup(_books(spark, d), _families(spark, d))


def page_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Books that share pages, by the stored page hashes; equal sets of pages are named by their first book."""
    return dedupe.page_jaccard(_pages(spark, d, "page_hash").select("book_id", "page_hash"))


def page_jaccard_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every book, of no page too, with the first book that has the same pages."""
    pages = _pages(spark, d, "page_hash").select("book_id", "page_hash")
    return dedupe.page_classes(pages.unionByName(_books(spark, d).select("book_id", F.lit(None).cast("string").alias("page_hash"))))


def page_jaccard_near(spark: SparkSession, d: str) -> DataFrame:
    """Books whose sets of pages have a Jaccard similarity of 0.8 or more; equal sets are named by their first book."""
    return dedupe.page_jaccard_near(_pages(spark, d, "page_hash").select("book_id", "page_hash"))


def near_duplicate_best(spark: SparkSession, d: str) -> DataFrame:
    """Each book's best earlier duplicate by stored signatures."""
    hashed = work.stage(_pages(spark, d, "page_hash").where("page_hash <> ''").select("book_id", "page_hash"), "page-hashes")
    counts = hashed.groupBy("book_id").agg(F.count("*").alias("page_count"))
    language = F.coalesce(F.nullif(F.lower(tx.strip(F.col("language"))), F.lit("")), F.lit("unknown")).alias("language")
    rows = _books(spark, d).join(counts, "book_id").select("book_id", F.col("book_id").alias("pos"), language, "title", "page_count", "content_hash", "text_hash", F.coalesce("text_simhash", F.lit(0)).alias("simhash"))
    return dedupe.near_duplicates(rows, hashed.select(F.col("book_id").alias("pos"), F.col("page_hash").alias("h")))


def canonical_per_family(spark: SparkSession, d: str) -> DataFrame:
    """The record that each family keeps, by the eight-part rank."""
    return dedupe.ranked_families(_books(spark, d)).where("rank = 1").select("family_key", "book_id")


def archived_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The records that a better one of their family replaces."""
    return dedupe.ranked_families(_books(spark, d)).where("rank > 1").select("family_key", "book_id", "rank")


def kept_semi(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the books that are kept."""
    keep = dedupe.ranked_families(_books(spark, d)).where("rank = 1").select("book_id")
    return _pages(spark, d).join(keep, "book_id", "left_semi").groupBy("book_id").agg(F.count("*").alias("pages"))


def removed_anti(spark: SparkSession, d: str) -> DataFrame:
    """Books that are not kept."""
    b = _books(spark, d)
    return b.join(dedupe.ranked_families(b).where("rank = 1").select("book_id"), "book_id", "left_anti").select("book_id")


def family_members(spark: SparkSession, d: str) -> DataFrame:
    """Families by content hash, with sizes and members."""
    return dedupe.family_upsert(_books(spark, d)).select("content_hash", "total_pages", "size_bytes", "members", "first_book")


def index_counts(spark: SparkSession, d: str) -> DataFrame:
    """Books by six dimensions."""
    return catalog.index_counts(_books(spark, d))


def infer_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Inferred types and statuses of every book."""
    b = catalog.inferred(_books(spark, d))
    return b.select("book_id", F.col("i_ext").alias("source_ext"), F.col("i_type").alias("source_type"), F.col("i_document").alias("document_type"), F.col("i_conversion").alias("conversion_status"))


def reinferred_changes(spark: SparkSession, d: str) -> DataFrame:
    """How many rows the rules of inference change."""
    return catalog.reinferred(_books(spark, d))


def stats_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the catalog."""
    return catalog.stats(_books(spark, d))


def library_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of approved books whose record mentions pdf."""
    return catalog.library(_books(spark, d), "pdf", status="approved_auto", page=2, limit=10).select("book_id", "title")


def approved_books(spark: SparkSession, d: str) -> DataFrame:
    """Books that may be taken in in two languages."""
    return catalog.approved(_books(spark, d), "id,ar").select("book_id")


def inventory_join(spark: SparkSession, d: str) -> DataFrame:
    """Known hashes of the files below a folder: a join of paths and files with filters."""
    b = _books(spark, d)
    paths = b.where(F.col("source_path").startswith("/arsip/")).select("book_id", "source_path")
    files = b.where("source_hash IS NOT NULL AND source_hash <> '' AND conversion_status = 'good'").select("book_id", "source_hash", "size_bytes")
    return paths.join(files, "book_id").select("source_path", "source_hash", "size_bytes", "book_id")


def set_if_missing(spark: SparkSession, d: str) -> DataFrame:
    """Books with missing hashes filled from their family's canonical row."""
    b, f = _books(spark, d).select("book_id", "content_hash", "text_hash"), _families(spark, d)
    canonical = f.where("canonical_book_id IS NOT NULL").groupBy(F.col("canonical_book_id").alias("book_id")).agg(F.max("content_hash").alias("content_hash"), F.max("text_hash").alias("text_hash"))
    return catalog.set_if_missing(b, canonical, "book_id", ["content_hash", "text_hash"])


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Early states of books, then the later ones merged over them by key."""
    b = load(spark, d, "books").select("book_id", "review_status", "size_bytes", "updated_at")
    old, new = b.where("updated_at < '2025-01-01'"), b.where("updated_at >= '2025-01-01'")
    return catalog.upsert(current_rows(old, ["book_id"]), current_rows(new, ["book_id"]), ["book_id"]).select("book_id", "size_bytes", "updated_at")


def upsert_any_key(spark: SparkSession, d: str) -> DataFrame:
    """Content rows merged where the book or the path is equal."""
    b = load(spark, d, "books").select("book_id", "json_path", "updated_at")
    old, new = current_rows(b.where("updated_at < '2025-01-01'"), ["book_id"]), current_rows(b.where("updated_at >= '2025-01-01'"), ["book_id"])
    return catalog.upsert_any(old, new, ["book_id", "json_path"]).select("book_id", "json_path")


def record_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Early records with the review of the current book and their own source fields."""
    old = current_rows(load(spark, d, "books").where("updated_at < '2025-01-01'"), ["book_id"]).select("book_id", "review_status", "source_path")
    return catalog.overlay(old, _books(spark, d), "book_id", ["review_status"], ["source_path"])


def review_fold(spark: SparkSession, d: str) -> DataFrame:
    """The state of each reviewed book after all actions."""
    return catalog.review_state(load(spark, d, "review_actions"), _books(spark, d)).select("book_id", "status", "actions", "settled")


def page_review_fold(spark: SparkSession, d: str) -> DataFrame:
    """The state of each reviewed page."""
    return catalog.page_review_state(load(spark, d, "review_actions"))


def _state(b: DataFrame) -> DataFrame:
    n = F.conv(F.substr(F.md5("book_id"), F.lit(1), F.lit(4)), 16, 10).cast("int") % 4
    return b.where(n > 0).select("book_id", F.when(n == 1, F.lit("changed")).otherwise(F.col("source_hash")).alias("source_hash"), (n != 2).alias("complete"), F.lit(3).alias("next_batch_index"))


def intake_actions(spark: SparkSession, d: str) -> DataFrame:
    """What the next intake does with each book."""
    b = _books(spark, d)
    return catalog.intake_actions(b, _state(b))


def _bridge(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d, "page_text_hash").where("page_text_hash <> ''").select("book_id", F.col("page_text_hash").alias("chunk_hash"))


def chunk_refcounts(spark: SparkSession, d: str) -> DataFrame:
    """How many books hold each page text."""
    return catalog.ref_counts(_bridge(spark, d))


def release_book(spark: SparkSession, d: str) -> DataFrame:
    """Page texts that no book holds once rejected books are gone."""
    gone = _books(spark, d).where("lower(trim(review_status)) = 'rejected'").select("book_id")
    return catalog.release(_bridge(spark, d), gone)[1]


def delete_books(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are left of three tables without the rejected books."""
    b = _books(spark, d)
    gone = b.where("lower(trim(review_status)) = 'rejected'")
    left = catalog.delete_books({"books": b, "pages": _pages(spark, d), "review_actions": load(spark, d, "review_actions").dropDuplicates(["id"])}, gone)
    return F.broadcast(left["books"].agg(F.count("*").alias("books"))).crossJoin(left["pages"].agg(F.count("*").alias("pages"))).crossJoin(left["review_actions"].agg(F.count("*").alias("actions")))


def chunk_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Parts of pages that occur first, without those of quarantined books."""
    b = _books(spark, d).where("lower(trim(quality_status)) = 'quarantine'").select("book_id")
    parts = _pages(spark, d, "content").where("content <> ''").select("book_id", F.col("page_num").alias("unit"), F.posexplode(chunking.split_parts(F.col("content"))).alias("chunk_idx", "text")).withColumn("chunk_hash", F.sha2("text", 256))
    return dedupe.new_chunks(parts, parts.join(b, "book_id", "left_semi")).select("chunk_hash", "book_id", "unit", "chunk_idx")


def citations(spark: SparkSession, d: str) -> DataFrame:
    """The first review of each cited page, repeats dropped."""
    a = load(spark, d, "review_actions").where("page_num IS NOT NULL")
    return dedupe.keep_first(a, ["book_id", "page_num"], [F.col("created_at"), F.col("id")]).select("book_id", "page_num", "id")


QUERIES = {f.__name__: f for f in (
    content_signature, edit_signature, source_hash_dedupe, family_lookup, page_jaccard_pairs, page_jaccard_near, page_jaccard_classes, near_duplicate_best, canonical_per_family, archived_duplicates, kept_semi, removed_anti, family_members, index_counts, infer_metadata, reinferred_changes, stats_snapshot, library_page, approved_books,
    inventory_join, set_if_missing, upsert_merge, upsert_any_key, record_overlay, review_fold, page_review_fold, intake_actions, chunk_refcounts, release_book, delete_books, chunk_dedupe, citations,
)}

_C = "coalesce(content, '')"


def _signature(normal: str, joiner: str) -> str:
    return f"""WITH n AS (SELECT book_id, page_num, {normal} AS t FROM {sql.PAGES})
        SELECT book_id, sha256(string_agg(sha256(t), chr(10) ORDER BY page_num)) AS content_hash, sha256(string_agg(t, {joiner} ORDER BY page_num)) AS text_hash, count(*) AS page_count FROM n WHERE t <> '' GROUP BY 1"""


_V = lambda c: f"nullif(lower({sql.strip(c)}), '')"
_CASE = lambda c, m: "CASE lower(trim(" + c + ")) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + " ELSE 0 END"
_STEM = r"trim(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(filename, ''), '\.[^.]*$', ''), '[_.-]', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_RANKED = f"""WITH k AS (SELECT *, coalesce(nullif(lower(trim(language)), ''), 'unknown') || '||' || coalesce(nullif(lower(trim(document_type)), ''), 'book') || '||' || coalesce(nullif({_STEM}, ''), '#' || book_id) AS family_key FROM {sql.BOOKS}),
    r AS (SELECT *, row_number() OVER (PARTITION BY family_key ORDER BY {_CASE('quality_status', dedupe.QUALITY)} DESC, {_CASE('conversion_status', dedupe.CONVERSION)} DESC, {_CASE('review_status', dedupe.REVIEW)} DESC, coalesce(total_pages, 0) DESC, {_CASE('source_type', dedupe.SOURCE)} DESC, coalesce(size_bytes, 0) DESC, coalesce(json_path, '') DESC, book_id DESC) AS rank FROM k)"""
_TYPE = lambda e: f"CASE {e} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.SOURCE_TYPES.items()) + " END"
_PATH = f"coalesce({sql.filled('source_path')}, {sql.filled('filename')}, '')"
_EXT = rf"nullif(lower(regexp_extract({_PATH}, '[^/](\.[^./]+)$', 1)), '')"
_INFER = f"""WITH e AS (SELECT *, coalesce({_V('source_ext')}, {_EXT}, '') AS ie, {_EXT} AS pe, {_PATH} AS ip FROM {sql.BOOKS}),
    t AS (SELECT *, coalesce(nullif({_V('source_type')}, 'unknown'), {_TYPE('ie')}, {_TYPE('pe')}, 'unknown') AS it FROM e),
    u AS (SELECT *, coalesce({_V('document_type')}, CASE WHEN it = 'html' THEN 'html_document' ELSE 'book' END) AS idoc FROM t),
    i AS (SELECT *, coalesce(nullif({_V('conversion_status')}, 'unknown'), CASE {_V('quality_status')} WHEN 'quarantine' THEN 'failed' WHEN 'warn' THEN 'degraded' WHEN 'ok' THEN 'good' END,
        CASE WHEN idoc = 'empty' THEN 'failed' WHEN idoc IN ('book', 'html_document') THEN 'good' WHEN it <> 'unknown' OR ip <> '' THEN 'good' ELSE 'unknown' END) AS ic FROM u)"""
_APPROVED = "('approved', 'approved_auto', 'approved_manual', 'approved_lease')"
_STATUS = "CASE a WHEN 'approved' THEN 'approved_manual' WHEN 'approved_manual' THEN 'approved_manual' WHEN 'approved_lease' THEN 'approved_lease' WHEN 'rejected' THEN 'rejected' WHEN 'duplicate' THEN 'rejected' ELSE 'pending_review' END"
_EARLY = lambda cols, test: f"(SELECT {cols} FROM books WHERE updated_at {test} '2025-01-01' QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY updated_at DESC) = 1)"
_BRIDGE = f"(SELECT book_id, page_text_hash AS chunk_hash FROM {sql.PAGES} WHERE page_text_hash <> '')"
_GONE = f"(SELECT book_id FROM {sql.BOOKS} WHERE lower(trim(review_status)) = 'rejected')"
ORACLES = {
    "content_signature": _signature(sql.normalize_import(_C), "' '"),
    "edit_signature": _signature(sql.collapse(sql.low(rf"regexp_replace({_C}, '[\f\x{{a0}}]', ' ', 'g')")), "chr(10)"),
    "source_hash_dedupe": f"SELECT source_hash, book_id FROM {sql.BOOKS} WHERE source_hash <> '' AND source_hash NOT IN (SELECT source_hash FROM {sql.FAMILIES} WHERE source_hash IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY source_hash ORDER BY size_bytes NULLS FIRST, source_ext NULLS FIRST, source_path NULLS FIRST, book_id) = 1",
    "family_lookup": f"""WITH f AS {sql.FAMILIES}, c AS (SELECT content_hash, min(family_key) AS k FROM f WHERE content_hash <> '' GROUP BY 1), t AS (SELECT text_hash, min(family_key) AS k FROM f WHERE text_hash <> '' GROUP BY 1)
        SELECT b.book_id, coalesce(c.k, t.k) AS family_key, CASE WHEN c.k IS NOT NULL THEN 'content_hash' WHEN t.k IS NOT NULL THEN 'text_hash' ELSE 'none' END AS matched FROM {sql.BOOKS} b LEFT JOIN c ON c.content_hash = b.content_hash LEFT JOIN t ON t.text_hash = b.text_hash""",
    "page_jaccard_pairs": f"""WITH p AS (SELECT DISTINCT book_id, page_hash FROM {sql.PAGES} WHERE page_hash <> ''), s AS (SELECT book_id, count(*) AS n, string_agg(page_hash, ',' ORDER BY page_hash) AS k FROM p GROUP BY 1), r AS (SELECT min(book_id) AS book_id, any_value(n) AS n FROM s GROUP BY k),
        q AS (SELECT p.*, n FROM p JOIN r USING (book_id))
        SELECT a.book_id AS book_a, b.book_id AS book_b, count(*) AS shared, {sql.round4('count(*) / (any_value(a.n) + any_value(b.n) - count(*))')} AS jaccard FROM q a JOIN q b ON a.page_hash = b.page_hash AND a.book_id < b.book_id GROUP BY 1, 2""",
    "page_jaccard_near": f"""WITH p AS (SELECT DISTINCT book_id, page_hash FROM {sql.PAGES} WHERE page_hash <> ''), s AS (SELECT book_id, count(*) AS n, string_agg(page_hash, ',' ORDER BY page_hash) AS k FROM p GROUP BY 1), r AS (SELECT min(book_id) AS book_id, any_value(n) AS n FROM s GROUP BY k),
        q AS (SELECT p.*, n FROM p JOIN r USING (book_id))
        SELECT a.book_id AS book_a, b.book_id AS book_b, count(*) AS shared, {sql.round4('count(*) / (any_value(a.n) + any_value(b.n) - count(*))')} AS jaccard FROM q a JOIN q b ON a.page_hash = b.page_hash AND a.book_id < b.book_id GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8""",
    "page_jaccard_classes": f"""WITH p AS (SELECT book_id, page_hash FROM {sql.PAGES} UNION SELECT book_id, NULL FROM {sql.BOOKS}), s AS (SELECT book_id, count(DISTINCT nullif(page_hash, '')) AS n, coalesce(string_agg(DISTINCT nullif(page_hash, ''), ',' ORDER BY nullif(page_hash, '')), '#' || book_id) AS k FROM p GROUP BY 1)
        SELECT book_id, min(book_id) OVER (PARTITION BY k) AS class_book, n AS pages, count(*) OVER (PARTITION BY k) AS books FROM s""",
    "near_duplicate_best": f"""WITH h AS (SELECT book_id, list_distinct(list(page_hash)) AS ph, count(*) AS pc FROM {sql.PAGES} WHERE page_hash <> '' GROUP BY 1),
        c AS (SELECT row_number() OVER (ORDER BY b.book_id) AS pos, b.book_id, coalesce({_V('language')}, 'unknown') AS language, list_distinct(list_filter(string_split({sql.normalize_import("coalesce(title, '')")}, ' '), lambda w: w <> '')) AS tw, pc, ph, content_hash, text_hash, coalesce(text_simhash, 0) AS sh FROM {sql.BOOKS} b LEFT JOIN h USING (book_id)),
        p AS (SELECT x.book_id, y.book_id AS dup, y.pos, coalesce(x.content_hash = y.content_hash, false) AS ec, coalesce(x.text_hash = y.text_hash, false) AS et, len(list_intersect(x.ph, y.ph)) / len(list_distinct(x.ph || y.ph)) AS j, CASE WHEN x.sh <> 0 AND y.sh <> 0 THEN 1.0::DOUBLE - bit_count(xor(x.sh, y.sh)) / 64.0::DOUBLE ELSE 0 END AS s,
            CASE WHEN len(x.tw || y.tw) > 0 THEN len(list_intersect(x.tw, y.tw)) / len(list_distinct(x.tw || y.tw)) ELSE 0 END AS t
            FROM c x JOIN c y ON x.pos > y.pos AND x.ph IS NOT NULL AND y.ph IS NOT NULL AND (x.language = 'unknown' OR y.language = 'unknown' OR x.language = y.language) AND least(x.pc, y.pc) / greatest(x.pc, y.pc) >= 0.45),
        q AS (SELECT *, greatest(j, s) AS base, greatest(j, s) >= 0.8 AND t >= 0.4 AS bonus FROM p),
        r AS (SELECT *, CASE WHEN ec OR et THEN 1.0::DOUBLE WHEN bonus THEN least(1.0::DOUBLE, base + least(0.08::DOUBLE, t * 0.08::DOUBLE)) ELSE base END AS score FROM q)
        SELECT book_id, dup AS duplicate_of, {sql.round4('score')} AS score, CASE WHEN ec THEN 'exact' WHEN et THEN 'text_exact' ELSE (CASE WHEN s > j THEN 'text_similarity' ELSE 'page_overlap' END) || (CASE WHEN bonus THEN '+title' ELSE '' END) END AS reason
        FROM r WHERE ec OR et OR score >= 0.92 QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY (ec OR et) DESC, CASE WHEN ec OR et THEN 0 ELSE score END DESC, pos) = 1""",
    "canonical_per_family": _RANKED + " SELECT family_key, book_id FROM r WHERE rank = 1",
    "archived_duplicates": _RANKED + " SELECT family_key, book_id, rank::INT AS rank FROM r WHERE rank > 1",
    "kept_semi": _RANKED + f" SELECT book_id, count(*) AS pages FROM {sql.PAGES} WHERE book_id IN (SELECT book_id FROM r WHERE rank = 1) GROUP BY 1",
    "removed_anti": _RANKED + " SELECT book_id FROM r WHERE rank > 1",
    "family_members": f"SELECT content_hash, max(total_pages) AS total_pages, max(size_bytes) AS size_bytes, count(DISTINCT coalesce(nullif(source_hash, ''), book_id)) AS members, min(book_id) AS first_book FROM {sql.BOOKS} WHERE content_hash <> '' GROUP BY 1",
    "index_counts": _INFER + " SELECT dimension, value, count(*) AS n FROM (SELECT unnest([{'d': 'language', 'v': coalesce(" + _V("language") + ", 'unknown')}, {'d': 'source_type', 'v': it}, {'d': 'document_type', 'v': idoc}, {'d': 'conversion_status', 'v': ic}, {'d': 'review_status', 'v': coalesce(" + _V("review_status") + ", 'unknown')}, {'d': 'quality_status', 'v': coalesce(" + _V("quality_status") + ", 'unknown')}], recursive := true) FROM i) x(dimension, value) GROUP BY 1, 2",
    "infer_metadata": _INFER + " SELECT book_id, ie AS source_ext, it AS source_type, idoc AS document_type, ic AS conversion_status FROM i",
    "reinferred_changes": _INFER + " SELECT count(*) AS rows, count_if(source_ext IS DISTINCT FROM ie) AS changed_source_ext, count_if(source_type IS DISTINCT FROM it) AS changed_source_type, count_if(document_type IS DISTINCT FROM idoc) AS changed_document_type, count_if(conversion_status IS DISTINCT FROM ic) AS changed_conversion_status FROM i",
    "stats_snapshot": f"""WITH s AS (SELECT *, coalesce({_V('review_status')}, '') AS st, coalesce({_V('quality_status')}, '') AS q, greatest(coalesce(total_pages, 0), 0) AS pg FROM {sql.BOOKS})
        SELECT count(*) AS total_books, sum(pg)::BIGINT AS total_pages, count_if(st IN {_APPROVED} AND q <> 'quarantine') AS ready_books, sum(CASE WHEN st IN {_APPROVED} AND q <> 'quarantine' THEN pg ELSE 0 END)::BIGINT AS ready_pages, count_if(st = 'pending_review') AS pending_books, count_if(st = 'rejected') AS rejected_books, count_if(q = 'quarantine') AS quarantined_books, sum(coalesce(size_bytes, 0))::BIGINT AS bytes FROM s""",
    "library_page": f"""SELECT book_id, title FROM {sql.BOOKS} WHERE contains(lower(concat_ws(' ', book_id, coalesce(filename, ''), coalesce(title, ''), coalesce(language, ''), coalesce(source_type, ''), coalesce(document_type, ''), coalesce(review_status, ''), coalesce(quality_status, ''), coalesce(source_path, ''))), 'pdf')
        AND (coalesce({_V('conversion_status')} = 'approved_auto', false) OR coalesce({_V('review_status')} = 'approved_auto', false) OR coalesce({_V('quality_status')} = 'approved_auto', false)) ORDER BY {sql.low("coalesce(title, '')")}, book_id LIMIT 10 OFFSET 10""",
    "approved_books": f"SELECT book_id FROM {sql.BOOKS} WHERE {_V('review_status')} IN {_APPROVED} AND {_V('language')} IN ('id', 'ar')",
    "inventory_join": f"SELECT source_path, source_hash, size_bytes, book_id FROM {sql.BOOKS} WHERE starts_with(source_path, '/arsip/') AND source_hash <> '' AND conversion_status = 'good'",
    "set_if_missing": f"""WITH c AS (SELECT canonical_book_id AS book_id, max(content_hash) AS sc, max(text_hash) AS st FROM {sql.FAMILIES} WHERE canonical_book_id IS NOT NULL GROUP BY 1)
        SELECT b.book_id, CASE WHEN {sql.filled('content_hash')} IS NULL THEN sc ELSE content_hash END AS content_hash, CASE WHEN {sql.filled('text_hash')} IS NULL THEN st ELSE text_hash END AS text_hash, ({sql.filled('content_hash')} IS NULL AND sc IS NOT NULL)::INT + ({sql.filled('text_hash')} IS NULL AND st IS NOT NULL)::INT AS filled FROM {sql.BOOKS} b LEFT JOIN c USING (book_id)""",
    "upsert_merge": f"SELECT book_id, size_bytes, updated_at FROM {sql.BOOKS}",
    "upsert_any_key": f"""WITH o AS {_EARLY('book_id, json_path, updated_at', '<')}, n AS {_EARLY('book_id, json_path, updated_at', '>=')}
        SELECT book_id, json_path FROM n UNION ALL SELECT book_id, json_path FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.book_id = o.book_id) AND NOT EXISTS (SELECT 1 FROM n WHERE n.json_path = o.json_path)""",
    "record_overlay": f"""WITH o AS {_EARLY('*', '<')} SELECT o.book_id, coalesce({sql.filled('b.review_status')}, o.review_status) AS review_status, coalesce({sql.filled('o.source_path')}, b.source_path) AS source_path FROM o LEFT JOIN {sql.BOOKS} b USING (book_id)""",
    "review_fold": f"""WITH e AS (SELECT DISTINCT id, book_id, {_V('action')} AS a, created_at FROM review_actions WHERE {_V('scope')} = 'book' AND {_V('action')} IN ('approved', 'approved_manual', 'approved_lease', 'rejected', 'duplicate', 'pending_review', 'edit') AND book_id IN (SELECT book_id FROM books)),
        l AS (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM e QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY created_at DESC, id DESC) = 1)
        SELECT book_id, {_STATUS} AS status, n AS actions, {_STATUS} <> 'pending_review' AS settled FROM l""",
    "page_review_fold": f"""SELECT book_id, page_num, CASE WHEN a = 'page_reviewed' THEN 'reviewed' WHEN a = 'page_pending' THEN 'pending_review' ELSE '' END AS status FROM (SELECT book_id, page_num, {_V('action')} AS a FROM review_actions WHERE {_V('scope')} = 'page' AND page_num IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, page_num ORDER BY created_at DESC, id DESC) = 1)""",
    "intake_actions": f"""WITH b AS (SELECT book_id, source_hash, ('0x' || substr(md5(book_id), 1, 4))::INT % 4 AS n FROM {sql.BOOKS}), s AS (SELECT *, CASE WHEN n = 1 THEN 'changed' ELSE source_hash END IS NOT DISTINCT FROM source_hash AS same FROM b)
        SELECT book_id, CASE WHEN n = 0 THEN 'new' WHEN same AND n <> 2 THEN 'skip' WHEN same THEN 'resume' ELSE 'refresh' END AS action, CASE WHEN n <> 0 AND same AND n = 2 THEN 3 ELSE 0 END AS next_batch FROM s""",
    "chunk_dedupe": _PARTS + f", q AS (SELECT book_id, page_num AS unit, chunk_idx, sha256(part) AS chunk_hash FROM p) SELECT chunk_hash, book_id, unit, chunk_idx FROM q WHERE chunk_hash NOT IN (SELECT chunk_hash FROM q WHERE book_id IN (SELECT book_id FROM {sql.BOOKS} WHERE lower(trim(quality_status)) = 'quarantine')) QUALIFY row_number() OVER (PARTITION BY chunk_hash ORDER BY book_id, unit, chunk_idx) = 1",
    "chunk_refcounts": f"SELECT chunk_hash, count(DISTINCT book_id) AS ref_count FROM {_BRIDGE} GROUP BY 1",
    "release_book": f"SELECT DISTINCT chunk_hash FROM {_BRIDGE} WHERE chunk_hash NOT IN (SELECT chunk_hash FROM {_BRIDGE} WHERE book_id NOT IN {_GONE})",
    "delete_books": f"SELECT (SELECT count(*) FROM {sql.BOOKS} WHERE book_id NOT IN {_GONE}) AS books, (SELECT count(*) FROM {sql.PAGES} WHERE book_id NOT IN {_GONE}) AS pages, (SELECT count(DISTINCT id) FROM review_actions WHERE book_id NOT IN {_GONE}) AS actions",
    "citations": "SELECT book_id, page_num, id FROM review_actions WHERE page_num IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, page_num ORDER BY created_at, id) = 1",
}
