"""Queries of markers, records, recognised words, markup, sinks and streams over the engine's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import ocr, references
from leafmill.plans import sql
from leafmill.plans.quality_queries import _CHUNKS
from leafmill.sources import readers, sinks
from leafmill.streaming import intake
from leafmill.tables import current_rows, load
from leafmill.work import shared_folder


def _items(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "eval_items")


def _verses(spark: SparkSession, d: str) -> DataFrame:
    """Test passages as verses of chapter 2."""
    rows = _items(spark, d).where("passage <> ''").select((F.col("item_id") % 1000).alias("n"), "passage", "language")
    pick = lambda lang: F.max(F.when(F.col("language") == lang, F.col("passage")))
    return rows.groupBy(F.concat(F.lit("2:"), F.col("n").cast("string")).alias("key")).agg(F.coalesce(pick("ar"), F.max("passage")).alias("arabic"), pick("id").alias("translation_id"), pick("en").alias("translation_en"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Test passages as records of two collections."""
    coll = F.when(F.col("item_id") % 2 == 0, "bukhari").otherwise("muslim")
    return _items(spark, d).select(coll.alias("collection"), F.col("item_id").cast("string").alias("number"), F.concat_ws(":", coll, "item_id").alias("key"), F.when(F.col("language") == "ar", F.col("passage")).alias("arabic"), F.when(F.col("language") != "ar", F.col("passage")).alias("translation_id"), F.lit(None).cast("string").alias("translation_en"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("item_id").cast("string")
    short = (F.col("item_id") % 1000).cast("string")
    text = F.concat(F.lit("[[DELETE_START]]x[[DELETE_END]]a [[QS 002:"), short, F.lit(" id+ar]] b [[HADITH Bukhari:"), n, F.lit(" id]] c [[QS 9:999]] d [[ARABIC_BLOCK p001_b001]] [[DORAR_SEARCH "), F.coalesce("query", F.lit("x")), F.lit("::ar+id]]."))
    return _items(spark, d).select(F.col("item_id").alias("doc_id"), text.alias("text"))


def _blocks(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("P001_B001").alias("block_id"), F.lit(" recognised ").alias("text"))


def verse_markers(spark: SparkSession, d: str) -> DataFrame:
    """Texts with all kinds of markers resolved."""
    return references.resolve(_marked(spark, d), _verses(spark, d), _records(spark, d), _blocks(spark), policy="first")[0].select("doc_id", "text")


def unresolved_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers that nothing answers."""
    return references.resolve(_marked(spark, d), _verses(spark, d), _records(spark, d), _blocks(spark))[1]


def hadith_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best records of each query, with the score's reason."""
    q = _items(spark, d).select(F.col("item_id").alias("query_id"), "query")
    return references.search_records(q, _records(spark, d)).select("query_id", "rank", "score", "collection", "number", "exact", "reason")


def verse_formats(spark: SparkSession, d: str) -> DataFrame:
    """Every verse in five modes."""
    modes = F.explode(F.array(*[F.lit(m) for m in ("ar", "id", "en+ar", "id+en+ar", "odd")]))
    v = _verses(spark, d).withColumn("mode", modes)
    return v.select("key", "mode", references.format_verse(F.col("mode"), F.col("arabic"), F.col("translation_id"), F.col("translation_en")).alias("text"))


def ocr_words(spark: SparkSession, d: str) -> DataFrame:
    pages = current_rows(load(spark, d, "pages").select("book_id", "page_num", "content", "updated_at"), ["book_id", "page_num"])
    lines = pages.select("book_id", F.col("page_num").alias("page"), F.posexplode(F.split("content", "\n")).alias("line_num", "line"))
    words = lines.select("book_id", "page", "line_num", F.posexplode(F.split(F.trim(F.regexp_replace("line", "[\\r\\t ]+", " ")), " ")).alias("word_num", "text"))
    return words.select("*", F.lit(5).alias("level"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), (F.col("word_num") * 60).alias("left"), (F.col("line_num") * 20).alias("top"), (F.length("text") * 9).alias("width"), F.lit(18).alias("height"), (F.length("text") * 7 % 100 - 1).cast("double").alias("conf"))


def ocr_line_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of words with boxes, confidence and script."""
    return ocr.line_blocks(ocr_words(spark, d), ["book_id", "page"])


def ocr_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Lines that need Arabic recognition, by page."""
    return ocr.candidates(ocr_line_blocks(spark, d)).groupBy("book_id", "page").agg(F.count("*").alias("blocks"))


def html_to_pages(spark: SparkSession, d: str) -> DataFrame:
    """The visible text of every document, with markup or without, by the parser."""
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(tx.split_pages(readers.visible_text("text"))).alias("pos", "page")).select("doc_id", (F.col("pos") + 1).alias("page_num"), "page")


def html_to_text_native(spark: SparkSession, d: str) -> DataFrame:
    """The visible text of all documents, by expressions only."""
    return load(spark, d, "documents").select("doc_id", readers.visible_text_native(F.col("text")).alias("text"))


def routed_books(spark: SparkSession, d: str) -> DataFrame:
    """Where each book is written."""
    return sinks.routed(current_rows(load(spark, d, "books"), ["book_id"])).select("book_id", "route")


def page_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Unified diffs between an older and the current state of pages that changed."""
    p = load(spark, d, "pages").select("book_id", "page_num", "content", "updated_at")
    now = current_rows(p, ["book_id", "page_num"]).withColumnsRenamed({"content": "new", "updated_at": "at"})
    return p.join(now, ["book_id", "page_num"]).where("updated_at < at AND NOT content <=> new").select("book_id", "page_num", "updated_at", sinks.unified_diff("content", "new").alias("diff"))


def _stream_source(spark: SparkSession, d: str, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(load(spark, d, name).schema)
    return reader.parquet(f"{d}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def stream_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all books, taken in as a stream that ends when all files are read."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = _stream_source(spark, d, "pages").select("book_id", "page_num", "content", "updated_at")
    source.writeStream.foreachBatch(lambda batch, number: intake.take_in(batch, number, out)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return intake.taken_in(spark, out).groupBy("book_id").agg(F.count("*").alias("chunks"))


def stream_review_counts(spark: SparkSession, d: str) -> DataFrame:
    """Review actions by week and kind, counted over a stream; repeated deliveries count once."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    # Only counts that changed are written; the state holds what the watermark may still let in.
    counts = intake.review_counts(_stream_source(spark, d, "review_actions"))
    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/counts").groupBy("week", "action").agg(F.max_by("n", "batch").alias("n"))


QUERIES = {f.__name__: f for f in (verse_markers, unresolved_markers, hadith_search, verse_formats, ocr_line_blocks, ocr_candidates, html_to_pages, html_to_text_native, routed_books, page_diffs, stream_chunks, stream_review_counts)}

_WORDS = rf"""WITH l AS (SELECT book_id, page_num AS page, line_num - 1 AS line_num, line FROM (SELECT book_id, page_num, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_num FROM {sql.PAGES})),
    s AS (SELECT *, string_split(trim(regexp_replace(line, '[\r\t ]+', ' ', 'g')), ' ') AS ws FROM l),
    w AS (SELECT book_id, page, line_num, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS word_num FROM s),
    g AS (SELECT book_id, page, line_num, string_agg(trim(text), ' ' ORDER BY word_num) AS text, min(word_num * 60)::INT AS "left", (line_num * 20)::INT AS top, max(word_num * 60 + length(text) * 9)::INT AS "right", (line_num * 20 + 18)::INT AS bottom, avg(CASE WHEN length(text) * 7 % 100 - 1 >= 0 THEN length(text) * 7 % 100 - 1 END) AS c FROM w WHERE trim(text) <> '' GROUP BY 1, 2, 3),
    r AS (SELECT *, {sql.hits('text', r'[\x{600}-\x{6ff}]')} AS a, {sql.hits('text', r'[\p{L}\x{600}-\x{6ff}]')} AS b FROM g),
    q AS (SELECT *, floor(CASE WHEN b > 0 THEN a / b ELSE 0 END * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE AS ratio FROM r),
    o AS (SELECT *, CASE WHEN ratio >= 0.25 THEN 'arabic' WHEN ratio >= 0.12 THEN 'mixed' ELSE 'latin' END AS script FROM q)"""
_BARE = r"regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', '', 'g'), '<[^>]*>', chr(10), 'g')"
_SHOWN = f"replace(replace(replace(replace(replace(replace({_BARE}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_NORM = lambda x: sql.collapse(f"regexp_replace({sql.low(x)}, '[\\x{{640}}\\x{{64b}}-\\x{{65f}}\\x{{670}}]', '', 'g')")
_VERSES = "v AS (SELECT '2:' || (item_id % 1000) AS key, coalesce(max(passage) FILTER (language = 'ar'), max(passage)) AS ar, max(passage) FILTER (language = 'id') AS id FROM eval_items WHERE passage <> '' GROUP BY 1)"
# The query set holds no query of the form collection:number.
_FOUND = rf"""r AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'bukhari' ELSE 'muslim' END AS collection, item_id::VARCHAR AS number, CASE WHEN language = 'ar' THEN passage END AS arabic, CASE WHEN language <> 'ar' THEN passage END AS tr FROM eval_items),
    h AS (SELECT *, collection || ':' || number AS key, {_NORM("concat_ws(' ' || chr(10) || ' ', nullif(arabic, ''), nullif(tr, ''))")} AS hay FROM r),
    q AS (SELECT item_id AS query_id, trim(query) AS query, {_NORM('trim(query)')} AS nq FROM eval_items WHERE trim(query) <> ''),
    t AS (SELECT *, list_filter(regexp_extract_all(nq, '[\p{{L}}\p{{N}}_\x{{600}}-\x{{6ff}}]+'), lambda x: length(x) >= 2) AS toks FROM q),
    j AS (SELECT *, len(list_filter(toks, lambda x: contains(hay, x))) AS hits FROM t CROSS JOIN (SELECT * FROM h WHERE hay <> '')),
    s AS (SELECT *, CASE WHEN nq = hay THEN 1000 ELSE 0 END + CASE WHEN nq <> '' AND contains(hay, nq) THEN 500 ELSE 0 END + hits * 40 + hits / greatest(len(toks), 1)::DOUBLE * 30::DOUBLE + CASE WHEN regexp_matches(query, '[\x{{600}}-\x{{6ff}}]') AND regexp_matches(coalesce(arabic, ''), '[\x{{600}}-\x{{6ff}}]') THEN 20 ELSE 0 END
        + CASE WHEN regexp_matches(query, '^\d+$') AND number = query THEN 140 ELSE 0 END + CASE WHEN nq = {_NORM('key')} THEN 150 ELSE 0 END + CASE WHEN nq <> '' AND contains({_NORM('key')}, nq) THEN 40 ELSE 0 END AS score,
        CASE WHEN nq = hay THEN 'teks' WHEN regexp_matches(query, '^\d+$') AND number = query THEN 'nomor' WHEN nq = {_NORM('key')} THEN 'kode' ELSE '' END AS reason FROM j),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE collection WHEN 'bukhari' THEN 0 ELSE 1 END, collection, number, key) AS rank FROM s WHERE score > 0)"""
_TWO = "chr(10) || chr(10)"
ORACLES = {
    "hadith_search": f"WITH {_FOUND} SELECT query_id, rank::INT AS rank, score::DOUBLE AS score, collection, number, reason <> '' AS exact, reason FROM k WHERE rank <= 10",
    "verse_markers": f"""WITH {_VERSES}, {_FOUND}, m AS (SELECT e.item_id, '2:' || (e.item_id % 1000) AS key, 'bukhari' AS c, coalesce(e.query, 'x') AS query FROM eval_items e)
        SELECT m.item_id AS doc_id, 'a ' || CASE WHEN v.key IS NULL THEN '[[ERROR_QS_NOT_FOUND ' || m.key || ']]' ELSE concat_ws({_TWO}, nullif(trim(v.ar), ''), nullif(trim(v.id), '')) END || ' b '
            || CASE WHEN b.number IS NULL THEN '[[HADITH Bukhari:' || m.item_id || ' id]]' ELSE coalesce(trim(b.tr), '') END || ' c [[ERROR_QS_NOT_FOUND 9:999]] d recognised '
            || CASE WHEN k.query_id IS NULL THEN '[[DORAR_SEARCH ' || m.query || '::ar+id]]' ELSE concat_ws({_TWO}, nullif(trim(k.arabic), ''), nullif(trim(k.tr), '')) END || '.' AS text
        FROM m LEFT JOIN v ON v.key = m.key LEFT JOIN h b ON b.collection = m.c AND b.number = m.item_id::VARCHAR LEFT JOIN k ON k.rank = 1 AND k.query_id = (SELECT min(query_id) FROM q WHERE q.query = trim(m.query))""",
    "unresolved_markers": f"""WITH {_VERSES} SELECT item_id AS doc_id, 'verse' AS type, 1 AS place, '[[QS 9:999]]' AS marker FROM eval_items
        UNION ALL SELECT item_id, 'verse', 0, '[[QS 002:' || (item_id % 1000) || ' id+ar]]' FROM eval_items WHERE '2:' || (item_id % 1000) NOT IN (SELECT key FROM v)
        UNION ALL SELECT item_id, 'hadith', 0, '[[HADITH Bukhari:' || item_id || ' id]]' FROM eval_items WHERE item_id % 2 <> 0
        UNION ALL SELECT item_id, 'search', 0, '[[DORAR_SEARCH ' || coalesce(query, 'x') || '::ar+id]]' FROM eval_items""",
    "ocr_line_blocks": _WORDS + """ SELECT book_id, page, printf('p%03d_b%03d', page, row_number() OVER (PARTITION BY book_id, page ORDER BY top, "left")) AS block_id, text, "left", top, "right", bottom, floor(coalesce(c, 0) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS conf, ratio AS arabic_ratio, script AS script_guess FROM o""",
    "ocr_candidates": _WORDS + " SELECT book_id, page, count(*) AS blocks FROM o WHERE script <> 'latin' GROUP BY 1, 2",
    "html_to_text_native": rf"SELECT doc_id, {sql.strip(rf'''regexp_replace({_SHOWN}, '[\t\n\x0b\f\r ]*\n[\t\n\x0b\f\r ]*', chr(10), 'g')''')} AS text FROM documents",
    "stream_chunks": _CHUNKS + " SELECT book_id, count(*) AS chunks FROM z GROUP BY 1",
    "verse_formats": """WITH v AS (SELECT '2:' || (item_id % 1000) AS key, coalesce(max(passage) FILTER (language = 'ar'), max(passage)) AS ar, max(passage) FILTER (language = 'id') AS id, max(passage) FILTER (language = 'en') AS en FROM eval_items WHERE passage <> '' GROUP BY 1)
        SELECT key, mode, CASE mode WHEN 'id' THEN coalesce(trim(id), '') WHEN 'en+ar' THEN concat_ws(chr(10) || chr(10), nullif(trim(ar), ''), nullif(trim(en), '')) WHEN 'id+en+ar' THEN concat_ws(chr(10) || chr(10), nullif(trim(ar), ''), nullif(trim(id), ''), nullif(trim(en), '')) ELSE trim(ar) END AS text FROM v, (SELECT unnest(['ar', 'id', 'en+ar', 'id+en+ar', 'odd']) AS mode)""",
    "routed_books": f"SELECT book_id, CASE WHEN document_type = 'empty' THEN '_empty' WHEN coalesce(total_pages, 0) <= 1 AND coalesce(size_bytes, 0) < 20000 THEN '_covers' ELSE 'main' END AS route FROM {sql.BOOKS}",
    "stream_review_counts": "SELECT to_timestamp(floor(epoch(created_at) / 604800) * 604800)::TIMESTAMP AS week, lower(trim(action)) AS action, count(DISTINCT id) AS n FROM review_actions GROUP BY 1, 2",
}
