"""Queries of the quality gate and of chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import char_profile
from leafmill.operators import chunking, quality
from leafmill.plans import sql
from leafmill.tables import current_rows, load


def inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    books = current_rows(load(spark, d, "books").select("book_id", "language", "source_path", "extractor", "size_bytes", "updated_at"), ["book_id"])
    books = books.select("book_id", "language", F.col("source_path").alias("path"), "extractor", "size_bytes")
    pages = current_rows(load(spark, d, "pages").select("book_id", "page_num", "content", "updated_at"), ["book_id", "page_num"]).drop("updated_at")
    return pages.join(books.select("book_id", "language", "path", "extractor"), "book_id"), books


def _page_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.page_quality(inputs(spark, d)[0], compat=False)


def _book_quality(spark: SparkSession, d: str) -> DataFrame:
    pages, books = inputs(spark, d)
    return quality.book_quality(pages.drop("extractor"), books, compat=False)


def page_quality(spark: SparkSession, d: str) -> DataFrame:
    """Status, score and reasons of every page."""
    q = _page_quality(spark, d)
    return q.select("book_id", "page_num", "status", "score", F.array_join("reasons", ",").alias("reasons"), F.array_join("warnings", ",").alias("warnings"), "ocr_needed", "unique_word_ratio", "symbol_ratio", "unique_char_ratio")


def page_quality_compat(spark: SparkSession, d: str) -> DataFrame:
    """The same with NFKC and entities."""
    q = quality.page_quality(inputs(spark, d)[0])
    return q.select("book_id", "page_num", "status", "score", F.array_join("reasons", ",").alias("reasons"), F.array_join("warnings", ",").alias("warnings"), "ocr_needed")


def book_quality(spark: SparkSession, d: str) -> DataFrame:
    """Status, reasons and figures of every book."""
    q = _book_quality(spark, d)
    return q.select("book_id", "status", F.array_join("reasons", ",").alias("reasons"), F.array_join("warnings", ",").alias("warnings"), "script", "page_count", "token_count", "avg_page_chars", "unique_word_ratio", "short_page_ratio", "duplicate_page_ratio", "symbol_ratio", "arabic_ratio", "unique_char_ratio")


def quality_routing(spark: SparkSession, d: str) -> DataFrame:
    """How every book goes on after the gate."""
    return quality.routing(_book_quality(spark, d))


def page_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    """Pages by status and OCR candidates of every book."""
    return quality.page_summary(_page_quality(spark, d))


def pdf_text_suspicion(spark: SparkSession, d: str) -> DataFrame:
    """Books whose text layer looks lost for their size; books without pages have none."""
    pages, books = inputs(spark, d)
    kinds = ("total", "nonspace", "letters", "replacement")
    profile = pages.select("book_id", "content", char_profile(F.col("content")).alias("p")).groupBy("book_id").agg(*[F.sum(f"p.{k}").alias(k) for k in kinds], F.count("*").alias("pages"), F.bool_or(F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit("cid:"))).alias("cid"))
    rows = books.join(profile, "book_id", "left").na.fill(0, [*kinds, "pages"]).withColumn("p", F.struct(*kinds))
    return rows.select("book_id", quality.suspicious_text_layer(F.col("p"), F.col("cid"), F.col("pages"), F.col("size_bytes"), F.col("extractor")).alias("suspicious"))


def chunk_page_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every page's text in overlapping parts."""
    pages = current_rows(load(spark, d, "pages").select("book_id", "page_num", "content", "updated_at"), ["book_id", "page_num"])
    return pages.where(F.length("content") > 0).select("book_id", "page_num", F.posexplode(chunking.split_parts(F.col("content"))).alias("chunk_idx", "part"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    pages = current_rows(load(spark, d, "pages").select("book_id", "page_num", "content", "updated_at"), ["book_id", "page_num"])
    return chunking.chunk_books(pages)


def chunk_book(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of every book."""
    return _chunks(spark, d)


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Chunk hashes of every page's parts."""
    from leafmill.functions import hashing

    parts = chunk_page_parts(spark, d)
    return parts.select("book_id", "page_num", "chunk_idx", hashing.chunk_hash(F.col("book_id"), F.col("page_num"), F.col("page_num"), F.col("chunk_idx"), F.col("part")).alias("chunk_hash"))


def point_uuid(spark: SparkSession, d: str) -> DataFrame:
    """Hashes, point ids and batches of every book's chunks."""
    return chunking.batches(chunking.identified(_chunks(spark, d))).select("book_id", "page_start", "page_end", "chunk_idx", "chunk_hash", "point_id", "batch")


QUERIES = {f.__name__: f for f in (page_quality, page_quality_compat, book_quality, quality_routing, page_quality_summary, pdf_text_suspicion, chunk_page_parts, chunk_book, chunk_ids, point_uuid)}

_C = "coalesce(content, '')"
_CLEAN = rf"regexp_replace({_C}, '[\f\x{{a0}}]', ' ', 'g')"
_LANG = r"""coalesce(nullif(lower(regexp_extract(string_split(path, '/')[-1], '(?i)^([a-z]{2})(?:[_-]|$)', 1)), ''), list_filter(list_reverse(string_split(lower(path), '/')), lambda x: x IN ('ar', 'en', 'id', 'ru'))[1], 'unknown')"""
_MEASURES = rf"""
    b AS (SELECT book_id, language, source_path AS path, extractor, size_bytes, (coalesce(language = 'ar', false) OR coalesce({_LANG} = 'ar', false) OR coalesce(list_contains(string_split(lower(path), '/'), 'ar'), false)) AS expected FROM (SELECT *, source_path AS path FROM {sql.BOOKS})),
    m AS (SELECT p.book_id, page_num, content, expected, length({_C}) AS total, length({_CLEAN}) - {sql.hits(_CLEAN, f'[{sql.SPACE}]')} AS ns, {sql.hits(_CLEAN, r'\p{L}')} AS letters, {sql.hits(_CLEAN, r'\p{N}')} AS digits,
        {sql.hits(_CLEAN, r'\p{P}')} AS punct, {sql.hits(_CLEAN, r'\p{S}')} AS symbols, {sql.hits(_CLEAN, r'\x{fffd}')} AS repl, {sql.hits(_CLEAN, sql.ARABIC)} AS a_all, {sql.hits(_CLEAN, r'\p{Latin}')} AS l_all,
        len(list_filter(regexp_extract_all({_CLEAN}, '{sql.ARABIC}'), lambda x: regexp_matches(x, '\p{{L}}'))) AS arabic, len(list_filter(regexp_extract_all({_CLEAN}, '\p{{Latin}}'), lambda x: regexp_matches(x, '\p{{L}}') AND x NOT IN ('ª', 'º'))) AS latin,
        {sql.normalize_import(_C, 'language')} AS normal, regexp_extract_all({sql.normalize_import(_C, 'language')}, '[A-Za-z0-9\x{{600}}-\x{{6ff}}]+') AS tokens, string_split({_CLEAN}, '') AS chars, length({sql.strip(_C)}) AS raw
        FROM {sql.PAGES} p JOIN b USING (book_id))"""
_SCRIPT = "CASE WHEN a_all = 0 AND l_all = 0 THEN 'unknown' WHEN a_all >= greatest(20, 2 * l_all) THEN 'arabic' WHEN l_all >= greatest(20, 2 * a_all) THEN 'latin' ELSE 'mixed' END"


def _list(*pairs: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + "], lambda x: x IS NOT NULL), ',')"


_PAGE_QUALITY = rf"""WITH {_MEASURES},
    q AS (SELECT *, len(tokens) AS tc, CASE WHEN len(tokens) > 0 THEN len(list_distinct(tokens)) / len(tokens) ELSE 0 END AS uwr, len(list_distinct(list_filter(chars, lambda c: c <> ''))) / greatest(ns, 1) AS ucr,
        repl / greatest(total, 1) AS rr, (punct + symbols) / greatest(letters + digits + punct + symbols, 1) AS sr, {_SCRIPT} AS script FROM m),
    r AS (SELECT *, {_list(("ns < 25 OR tc < 5", "too_short_or_empty"), ("ns >= 80 AND ucr < 0.05", "low_character_diversity"), ("rr >= 0.01", "encoding_replacement_chars"), ("expected AND arabic = 0 AND latin >= 10 AND ns >= 30", "arabic_script_mismatch"), ("expected AND NOT (arabic = 0 AND latin >= 10 AND ns >= 30) AND arabic < 8 AND ns >= 50", "arabic_missing"), ("expected AND NOT (arabic = 0 AND latin >= 10 AND ns >= 30) AND NOT (arabic < 8 AND ns >= 50) AND script = 'latin' AND ns >= 30", "arabic_script_mismatch"))} AS reasons,
        {_list(("tc >= 60 AND uwr < 0.2", "low_vocab_diversity"), ("sr >= 0.45 AND ns >= 80", "high_symbol_density"), ("arabic >= 20 AND latin >= 20 AND ns >= 150", "mixed_script_content"))} AS warnings FROM q),
    s AS (SELECT *, CASE WHEN reasons <> '' THEN 'ocr_needed' WHEN warnings <> '' THEN 'warn' ELSE 'ok' END AS status FROM r)"""
def _parts(source: str, keys: str) -> str:
    """A recursive table p(keys, chunk_idx, part) of the overlapping parts of column t of ``source``."""
    return rf"""c AS (SELECT {keys}, t, 1 AS pos, 0 AS chunk_idx FROM {source}
      UNION ALL SELECT {keys}, t, pos + size - 50, chunk_idx + 1 FROM (
        SELECT *, CASE WHEN feed > 251 THEN feed WHEN feed = 0 AND space > 251 THEN space ELSE 500 END AS size FROM (
          SELECT *, 500 - length(regexp_extract(w, '[^\n]*$')) AS feed, 500 - length(regexp_extract(w, '[^ ]*$')) AS space
          FROM (SELECT *, substr(t, pos, 500) AS w FROM c WHERE length(t) > 500 AND pos + 499 < length(t))))),
    p AS (SELECT {keys}, chunk_idx, CASE WHEN length(t) <= 500 THEN t WHEN pos + 499 >= length(t) THEN substr(t, pos) ELSE substr(t, pos, lead(pos) OVER (PARTITION BY {keys} ORDER BY chunk_idx) + 50 - pos) END AS part FROM c)"""


_PARTS = f"WITH RECURSIVE t AS (SELECT book_id, page_num, content AS t FROM {sql.PAGES} WHERE length(content) > 0), {_parts('t', 'book_id, page_num')}"
_CHUNKS = rf"""WITH RECURSIVE k AS (SELECT book_id, page_num, {sql.strip(_C)} AS t FROM {sql.PAGES}),
    h AS (SELECT *, length(t) >= 80 AS long, list_filter(list_transform(string_split(t, chr(10)), lambda x: {sql.strip('x')}), lambda x: x <> '') AS ls FROM k WHERE t <> ''
        AND NOT (length(t) < 30 OR (len(string_split(t, chr(10))) <= 3 AND contains(lower(t), 'cover')) OR (contains(t, 'HYPERLINK') AND length(t) < 300) OR regexp_matches(t, '^[0-9]{{4}}\s*[Hh]\s*$'))),
    g AS (SELECT *, NOT long AND (regexp_matches(ls[1], '^\p{{Nd}}+[.)][{sql.SPACE}]') OR regexp_matches(ls[1], '^[IVXLCDM]+\.?[{sql.SPACE}]') OR (length(ls[1]) < 80 AND ((upper(ls[1]) = ls[1] AND lower(ls[1]) <> ls[1]) OR (len(ls) = 1 AND upper(left(ls[1], 1)) = left(ls[1], 1) AND lower(left(ls[1], 1)) <> left(ls[1], 1))))) AS heading FROM h),
    l AS (SELECT book_id, page_num, t, long, heading FROM g QUALIFY bool_or(long OR heading) OVER (PARTITION BY book_id ORDER BY page_num ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT *, long OR (heading AND NOT coalesce(lag(page_num) OVER (PARTITION BY book_id ORDER BY page_num) = page_num - 1, false)) AS begins FROM l),
    n AS (SELECT *, sum(begins::INT) OVER (PARTITION BY book_id ORDER BY page_num ROWS UNBOUNDED PRECEDING) AS unit FROM b),
    o AS (SELECT *, CASE WHEN first_value(long) OVER own THEN begins ELSE sum((heading AND NOT begins)::INT) OVER own = 0 END AS body FROM n WINDOW own AS (PARTITION BY book_id, unit ORDER BY page_num ROWS UNBOUNDED PRECEDING)),
    u AS (SELECT book_id, unit, string_agg(t, chr(10) || chr(10) ORDER BY page_num) FILTER (body) AS t, string_agg(t, chr(10) || chr(10) ORDER BY page_num) FILTER (NOT body) AS tail, min(page_num) AS page_start, max(page_num) FILTER (body) AS body_end, max(page_num) AS unit_end FROM o GROUP BY 1, 2),
    {_parts('u', 'book_id, unit')},
    z AS (SELECT book_id, unit, page_start, chunk_idx, CASE WHEN tail IS NOT NULL AND chunk_idx = max(chunk_idx) OVER (PARTITION BY book_id, unit) THEN unit_end ELSE body_end END AS page_end,
        CASE WHEN tail IS NOT NULL AND chunk_idx = max(chunk_idx) OVER (PARTITION BY book_id, unit) THEN part || chr(10) || chr(10) || tail ELSE part END AS text FROM p JOIN u USING (book_id, unit))"""
_BOOK_QUALITY = rf"""WITH {_MEASURES},
    g AS (SELECT book_id, {", ".join(f"sum({k}) AS {k}" for k in ("total", "ns", "letters", "arabic", "latin", "digits", "punct", "symbols", "repl", "raw", "a_all", "l_all"))}, count(*) AS page_count, sum(len(tokens)) AS tc, sum((raw < 40)::INT) AS short,
        count(nullif(normal, '')) AS hashes, count(DISTINCT nullif(normal, '')) AS uh, len(list_distinct(flatten(list(tokens)))) AS uw, list_distinct(list_filter(flatten(list(chars)), lambda c: c <> '')) AS uc FROM m GROUP BY 1),
    q AS (SELECT b.book_id, expected, extractor, size_bytes, {", ".join(f"coalesce({k}, 0) AS {k}" for k in ("total", "ns", "letters", "arabic", "latin", "digits", "punct", "symbols", "repl", "raw", "a_all", "l_all", "page_count", "tc", "short", "hashes", "uh", "uw"))}, coalesce(len(uc), 0) + CASE WHEN page_count > 1 AND NOT list_contains(uc, chr(10)) THEN 1 ELSE 0 END AS ucn FROM b LEFT JOIN g USING (book_id)),
    r AS (SELECT *, CASE WHEN tc > 0 THEN uw / tc ELSE 0 END AS uwr, short / greatest(page_count, 1) AS spr, (hashes - uh) / greatest(hashes, 1) AS dpr, (punct + symbols) / greatest(letters + digits + punct + symbols, 1) AS sr, arabic / greatest(letters, 1) AS ar, ucn / greatest(ns, 1) AS ucr, {_SCRIPT} AS script FROM q),
    s AS (SELECT *, {_list(("ns < 40 OR tc < 8", "too_short_or_empty"), ("ns >= 120 AND ucr < 0.04", "low_character_diversity"), ("repl / greatest(total, 1) >= 0.01", "encoding_replacement_chars"), ("dpr >= 0.67 AND hashes >= 3", "repeated_pages"), ("expected AND arabic = 0 AND latin >= 20 AND ns >= 40", "arabic_script_mismatch"), ("expected AND NOT (arabic = 0 AND latin >= 20 AND ns >= 40) AND arabic < 10 AND ns >= 60", "arabic_missing"), ("expected AND NOT (arabic = 0 AND latin >= 20 AND ns >= 40) AND NOT (arabic < 10 AND ns >= 60) AND ar < 0.12 AND ns >= 200", "arabic_low_density"), ("expected AND NOT (arabic = 0 AND latin >= 20 AND ns >= 40) AND NOT (arabic < 10 AND ns >= 60) AND NOT (ar < 0.12 AND ns >= 200) AND script = 'latin' AND ns >= 40", "arabic_script_mismatch"), ("(coalesce(extractor, '') LIKE 'pdf%' OR coalesce(extractor, '') = 'libreoffice-html') AND size_bytes >= 1048576 AND ns < 400", "conversion_loss_suspected"))} AS reasons,
        {_list(("tc >= 120 AND uwr < 0.18", "low_vocab_diversity"), ("spr >= 0.6 AND page_count >= 2", "many_short_pages"), ("sr >= 0.45 AND ns >= 120", "high_symbol_density"), ("NOT expected AND arabic >= 20 AND latin >= 20 AND ns >= 300", "mixed_script_content"))} AS warnings FROM r),
    z AS (SELECT *, CASE WHEN reasons <> '' THEN 'quarantine' WHEN warnings <> '' THEN 'warn' ELSE 'ok' END AS status FROM s)"""
ORACLES = {
    "page_quality": _PAGE_QUALITY + rf""" SELECT book_id, page_num, status, greatest(0, {sql.round4("1.0::DOUBLE - CASE WHEN ns < 25 THEN least(0.35::DOUBLE, (25 - ns) / 100.0::DOUBLE) ELSE 0 END - CASE WHEN ucr < 0.05 THEN least(0.2::DOUBLE, (0.05::DOUBLE - ucr) * 2) ELSE 0 END - least(0.2::DOUBLE, rr * 8) - least(0.2::DOUBLE, CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, ',')) END * 0.05::DOUBLE)")}) AS score,
        reasons, warnings, status <> 'ok' AS ocr_needed, {sql.round4('uwr')} AS unique_word_ratio, {sql.round4('sr')} AS symbol_ratio, {sql.round4('ucr')} AS unique_char_ratio FROM s""",
    "page_quality_summary": _PAGE_QUALITY + " SELECT book_id, count(*) AS pages, count_if(status = 'ok') AS ok, count_if(status = 'warn') AS warn, count_if(status = 'ocr_needed') AS ocr_needed, coalesce(array_to_string(list_sort(list(page_num) FILTER (status <> 'ok')), ','), '') AS ocr_candidates FROM s GROUP BY 1",
    "book_quality": _BOOK_QUALITY + f" SELECT book_id, status, reasons, warnings, script, page_count, tc AS token_count, floor(raw / greatest(page_count, 1) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS avg_page_chars, {sql.round4('uwr')} AS unique_word_ratio, {sql.round4('spr')} AS short_page_ratio, {sql.round4('dpr')} AS duplicate_page_ratio, {sql.round4('sr')} AS symbol_ratio, {sql.round4('ar')} AS arabic_ratio, {sql.round4('ucr')} AS unique_char_ratio FROM z",
    "quality_routing": _BOOK_QUALITY + " SELECT book_id, status, CASE status WHEN 'quarantine' THEN 'failed' WHEN 'warn' THEN 'degraded' ELSE 'good' END AS conversion_status, CASE WHEN status = 'quarantine' THEN 'pending_review' ELSE 'approved_auto' END AS review_status, status = 'quarantine' AS review_required, status <> 'quarantine' AS intake_ready FROM z",
    "pdf_text_suspicion": rf"""WITH p AS (SELECT book_id, sum(length({_C})) AS total, sum(length({_C}) - {sql.hits(_C, f'[{sql.SPACE}]')}) AS ns, sum({sql.hits(_C, r'\p{L}')}) AS letters, sum({sql.hits(_C, r'\x{fffd}')}) AS repl, count(*) AS pages, bool_or(contains(lower({_C}), 'cid:')) AS cid FROM {sql.PAGES} GROUP BY 1),
        j AS (SELECT b.book_id, coalesce(size_bytes, 0) AS size, coalesce(extractor, '') AS extractor, coalesce(total, 0) AS total, coalesce(ns, 0) AS ns, coalesce(letters, 0) AS letters, coalesce(repl, 0) AS repl, coalesce(pages, 0) AS pages, coalesce(cid, false) AS cid FROM {sql.BOOKS} b LEFT JOIN p USING (book_id))
        SELECT book_id, CASE WHEN ns = 0 THEN true WHEN size >= 200000 AND ns < 120 THEN true WHEN size >= 1000000 AND ns < 350 THEN true WHEN pages <= 1 AND size >= 100000 AND ns < 200 THEN true
            WHEN repl > 0 AND repl / greatest(total, 1) > 0.01 THEN true WHEN extractor = 'pdftotext' AND cid THEN true WHEN letters > 0 AND letters / greatest(ns, 1) < 0.18 AND size >= 100000 THEN true ELSE false END AS suspicious FROM j""",
    "chunk_book": _CHUNKS + " SELECT book_id, unit::BIGINT AS unit, page_start, page_end, chunk_idx, text FROM z",
    "point_uuid": _CHUNKS + """, hashed AS (SELECT *, sha256(concat_ws('|', book_id, page_start::VARCHAR, page_end::VARCHAR, chunk_idx::VARCHAR, text)) AS chunk_hash FROM z), named AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('rag-chunk:' || chunk_hash)) AS h FROM hashed)
        SELECT book_id, page_start, page_end, chunk_idx, chunk_hash, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id, ((row_number() OVER (PARTITION BY book_id ORDER BY unit, chunk_idx) - 1) // 128)::INT AS batch FROM named""",
    "chunk_page_parts": _PARTS + " SELECT book_id, page_num, chunk_idx, part FROM p",
    "chunk_ids": _PARTS + " SELECT book_id, page_num, chunk_idx, sha256(concat_ws('|', book_id, page_num::VARCHAR, page_num::VARCHAR, chunk_idx::VARCHAR, part)) AS chunk_hash FROM p",
}
