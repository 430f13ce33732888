"""Queries of the text functions: normalisers, profiles, names and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import hashing, text
from leafmill.plans import sql
from leafmill.tables import current_rows, load

BOOK, PAGE = ["book_id"], ["book_id", "page_num"]


def _pages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_rows(load(spark, d, "pages").select(*PAGE, *columns, "updated_at"), PAGE).drop("updated_at")


def _books(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_rows(load(spark, d, "books").select(*BOOK, *columns, "updated_at"), BOOK).drop("updated_at")


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    """The two main normal forms of every document, without NFKC and entities."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "text")
    return docs.select("doc_id", text.normalize_import(F.col("text"), F.col("lang"), compat=False).alias("import_form"), text.normalize_search(F.col("text"), compat=False).alias("search_form"))


def text_normalize_compat(spark: SparkSession, d: str) -> DataFrame:
    """All five normal forms of every document, with NFKC and entities where they belong."""
    t = F.col("text")
    return load(spark, d, "documents").select(
        "doc_id", text.normalize_import(t, F.col("lang")).alias("import_form"), text.normalize_search(t).alias("search_form"), text.normalize_edit(t).alias("edit_form"), text.normalize_reference(t).alias("reference_form"), text.normalize_eval(t).alias("eval_form")
    )


def tokenize_tf(spark: SparkSession, d: str) -> DataFrame:
    """Search terms of every document with their frequency."""
    tokens = text.search_tokens(text.normalize_search(F.col("text"), compat=False))
    return load(spark, d, "documents").select("doc_id", F.explode(tokens).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def char_profile(spark: SparkSession, d: str) -> DataFrame:
    """Characters by kind of every page."""
    return _pages(spark, d, "content").select(*PAGE, text.char_profile(F.col("content")).alias("p")).select(*PAGE, "p.*")


def detect_script(spark: SparkSession, d: str) -> DataFrame:
    """The script of every page and its share of Arabic letters."""
    c = F.col("content")
    return _pages(spark, d, "content").select(*PAGE, text.detect_script(c).alias("script"), text.round4(F.coalesce(text.arabic_ratio(c), F.lit(0.0))).alias("arabic_ratio"))


def clean_title(spark: SparkSession, d: str) -> DataFrame:
    """Titles made from every book's file stem, as for import and for conversion."""
    stem = F.regexp_replace("source_relpath", "^.*/|\\.[^./]*$", "")
    return _books(spark, d, "source_relpath").select("book_id", text.clean_title(stem).alias("title"), text.clean_title(stem, convert=True).alias("converted"))


def book_id_slug(spark: SparkSession, d: str) -> DataFrame:
    """The identifier made from every book's root and path."""
    return _books(spark, d, "source_root", "source_relpath").select("book_id", text.book_id(F.col("source_root"), F.col("source_relpath")).alias("slug"))


def language_from_path(spark: SparkSession, d: str) -> DataFrame:
    """Languages read from every book's path, as for import and for conversion."""
    path = F.col("source_path")
    return _books(spark, d, "source_path").select("book_id", text.language_from_path(path).alias("language"), text.language_from_path(path, known_only=True).alias("known"), text.language_of_converted(F.element_at(F.split(path, "/"), -1)).alias("converted"))


def page_split(spark: SparkSession, d: str) -> DataFrame:
    """Every document cut into pages at form feeds, numbered."""
    docs = load(spark, d, "documents").select("doc_id", F.posexplode(text.split_pages(F.col("text"))).alias("pos", "page"))
    return docs.select("doc_id", (F.col("pos") + 1).alias("page_num"), F.length("page").alias("chars"))


def page_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Length and hashes of every page's content."""
    c = F.coalesce("content", F.lit(""))
    return _pages(spark, d, "content").select(*PAGE, F.length(c).alias("content_len"), hashing.sha256(text.collapse(c)).alias("page_hash"), hashing.sha256(text.strip(c)).alias("page_text_hash"))


def snippet_highlight(spark: SparkSession, d: str) -> DataFrame:
    """A snippet of each test passage with the words of its query marked."""
    return load(spark, d, "eval_items").select("item_id", text.snippet(F.col("passage")).alias("snippet"), text.highlight(F.col("passage"), F.col("query")).alias("marked"))


def page_navigation(spark: SparkSession, d: str) -> DataFrame:
    """The pages that each page of a book links to."""
    pages = _pages(spark, d)
    total = pages.groupBy("book_id").agg(F.max("page_num").alias("total"))
    linked = text.page_window(F.col("page_num"), F.col("total"))
    return pages.join(total, "book_id").select(*PAGE, F.array_join(F.transform(linked, lambda x: x.cast("string")), ",").alias("links"))


def simhash_native(spark: SparkSession, d: str) -> DataFrame:
    """SimHash of every document from SHA-256 words: an aggregate over distinct words."""
    words = F.filter(F.split(text.normalize_import(F.col("text"), compat=False), " "), lambda w: w != "")
    each = load(spark, d, "documents").select("doc_id", F.explode(words).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    hashed = each.withColumn("h", hashing.signed64(F.substr(F.sha2("w", 256), F.lit(1), F.lit(16))))
    return hashed.groupBy("doc_id").agg(*hashing.simhash_bits()).select("doc_id", F.lower(F.hex(hashing.simhash_of_bits())).alias("simhash"))


def simhash_compat(spark: SparkSession, d: str) -> DataFrame:
    """SimHash of every document, bit for bit as stored ones are made."""
    return load(spark, d, "documents").select("doc_id", hashing.simhash_compat(text.normalize_import(F.col("text"))).alias("simhash"))


def simhash_hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different stored SimHashes that differ in five bits at most.

    Values meet by the bits of three of eight blocks (pigeonhole), so the equi-join loses nothing and
    few others meet. Equal hashes are one class, joined once and named by its first book;
    ``simhash_classes`` has the class of every book, so that joined to it on both sides these are
    all pairs of books at distances 1 to 5, and its classes those at distance 0.
    """
    books = _books(spark, d, "text_simhash").where("text_simhash <> 0")
    classes = books.groupBy(F.col("text_simhash").alias("h")).agg(F.min("book_id").alias("book"))
    pairs = hashing.near_values(classes.select("h"), 5).where("h < o")
    named = pairs.join(classes.withColumnRenamed("book", "book_a"), "h").join(classes.withColumnsRenamed({"h": "o", "book": "book_b"}), "o")
    return named.select("book_a", "book_b", hashing.hamming(F.col("h"), F.col("o")).alias("distance"))


def simhash_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every book with the first book of its stored SimHash and the number of books that have it.

    A book without a hash (null or 0) equals no other: it is a class of its own.
    """
    books = _books(spark, d, "text_simhash")
    classes = books.where("text_simhash <> 0").groupBy("text_simhash").agg(F.min("book_id").alias("first"), F.count("*").alias("n"))
    return books.join(classes, "text_simhash", "left").select("book_id", "text_simhash", F.coalesce("first", "book_id").alias("class_book"), F.coalesce("n", F.lit(1)).alias("books"))


QUERIES = {f.__name__: f for f in (text_normalize, text_normalize_compat, tokenize_tf, char_profile, detect_script, clean_title, book_id_slug, language_from_path, page_split, page_metrics, snippet_highlight, page_navigation, simhash_native, simhash_compat, simhash_hamming_pairs, simhash_classes)}

_C = "coalesce(content, '')"
_STEM = r"regexp_replace(source_relpath, '^.*/|\.[^./]*$', '', 'g')"


def _title(prefix: str, stops: tuple[str, ...]) -> str:
    bare = f"regexp_replace({_STEM}, '{prefix}', '')"
    words = f"list_filter(string_split(trim(regexp_replace(regexp_replace({bare}, '[_-]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: w <> '')"
    listed = ", ".join(f"'{x}'" for x in stops)
    return f"array_to_string(list_transform({words}, lambda w, i: CASE WHEN upper(w) = w AND lower(w) <> w AND length(w) > 1 THEN w WHEN lower(w) IN ({listed}) AND i > 1 THEN lower(w) ELSE upper(left(w, 1)) || lower(substr(w, 2)) END), ' ')"


_BITS = ", ".join(f"CASE WHEN sum(CASE WHEN (h >> {i}) & 1 = 1 THEN n ELSE -n END) > 0 THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64))
ORACLES = {
    "text_normalize": f"SELECT doc_id, {sql.normalize_import('text', 'lang')} AS import_form, {sql.normalize_search('text')} AS search_form FROM documents",
    "tokenize_tf": rf"""SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all({sql.normalize_search('text')}, '[A-Za-z0-9\x{{600}}-\x{{6ff}}'']+')) AS term FROM documents) WHERE length(term) >= 2 GROUP BY 1, 2""",
    "char_profile": rf"""SELECT book_id, page_num, total, nonspace, letters, arabic, latin, digits, punct, symbols, replacement, nonspace - letters - digits - punct - symbols AS other FROM (
        SELECT book_id, page_num, length({_C})::INT AS total, (length({_C}) - {sql.hits(_C, f'[{sql.SPACE}]')})::INT AS nonspace, {sql.hits(_C, r'\p{L}')}::INT AS letters,
        len(list_filter(regexp_extract_all({_C}, '{sql.ARABIC}'), lambda x: regexp_matches(x, '\p{{L}}')))::INT AS arabic,
        len(list_filter(regexp_extract_all({_C}, '\p{{Latin}}'), lambda x: regexp_matches(x, '\p{{L}}') AND x NOT IN ('ª', 'º')))::INT AS latin,
        {sql.hits(_C, r'\p{N}')}::INT AS digits, {sql.hits(_C, r'\p{P}')}::INT AS punct, {sql.hits(_C, r'\p{S}')}::INT AS symbols, {sql.hits(_C, r'\x{fffd}')}::INT AS replacement FROM {sql.PAGES})""",
    "detect_script": rf"""SELECT book_id, page_num, CASE WHEN a = 0 AND l = 0 THEN 'unknown' WHEN a >= greatest(20, 2 * l) THEN 'arabic' WHEN l >= greatest(20, 2 * a) THEN 'latin' ELSE 'mixed' END AS script,
        CASE WHEN b > 0 THEN {sql.round4('n / b')} ELSE 0 END AS arabic_ratio FROM (
        SELECT book_id, page_num, {sql.hits(_C, sql.ARABIC)} AS a, {sql.hits(_C, r'\p{Latin}')} AS l, {sql.hits(_C, r'[\x{600}-\x{6ff}]')} AS n, {sql.hits(_C, r'[\p{L}\x{600}-\x{6ff}]')} AS b FROM {sql.PAGES})""",
    "clean_title": f"SELECT book_id, CASE WHEN t = '' THEN stem ELSE t END AS title, converted FROM (SELECT book_id, {_STEM} AS stem, {_title('^(?i)[a-z]{2}[_-]+', text.TITLE_STOPS)} AS t, {_title('^(en|id|ru)[_-]+', text.CONVERT_STOPS)} AS converted FROM {sql.BOOKS})",
    "book_id_slug": rf"SELECT book_id, source_root || '__' || trim(regexp_replace(regexp_replace(regexp_replace(source_relpath, '[/\\]', '__', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '_') AS slug FROM {sql.BOOKS}",
    "language_from_path": rf"""SELECT book_id, coalesce(nullif(lower(p), ''), f, 'unknown') AS language, coalesce(CASE WHEN lower(p) IN ('ar', 'en', 'id', 'ru') THEN lower(p) END, f, 'unknown') AS known,
        coalesce(nullif(regexp_extract(name, '^(en|id|ru)[_-]', 1), ''), 'unknown') AS converted FROM (
        SELECT book_id, name, regexp_extract(name, '(?i)^([a-z]{{2}})(?:[_-]|$)', 1) AS p, list_filter(list_reverse(string_split(lower(source_path), '/')), lambda x: x IN ('ar', 'en', 'id', 'ru'))[1] AS f
        FROM (SELECT book_id, source_path, string_split(source_path, '/')[-1] AS name FROM {sql.BOOKS}))""",
    "page_split": rf"""SELECT doc_id, i AS page_num, length(pages[i]) AS chars FROM (SELECT doc_id, pages, unnest(range(1, len(pages) + 1)) AS i FROM (
        SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\f+'), lambda x: {sql.strip('x')}), lambda x: x <> '') AS pages FROM documents))""",
    "page_metrics": f"SELECT book_id, page_num, length({_C}) AS content_len, sha256({sql.collapse(_C)}) AS page_hash, sha256({sql.strip(_C)}) AS page_text_hash FROM {sql.PAGES}",
    "snippet_highlight": rf"""WITH t AS (SELECT *, trim(regexp_replace(passage, '[{sql.SPACE}]+', ' ', 'g')) AS flat, list_distinct(regexp_extract_all({sql.low('query')}, '[\p{{L}}\p{{N}}_\x{{600}}-\x{{6ff}}]{{3,}}')) AS ts FROM eval_items),
        o AS (SELECT item_id, string_agg(w, '|' ORDER BY length(w) DESC, w) AS p FROM (SELECT item_id, unnest(ts) AS w FROM t) GROUP BY 1)
        SELECT item_id, CASE WHEN length(flat) > 360 THEN left(flat, 360) || '...' ELSE flat END AS snippet, CASE WHEN len(ts) > 0 THEN regexp_replace(passage, '(?i)(' || p || ')', '<mark>\1</mark>', 'g') ELSE passage END AS marked FROM t LEFT JOIN o USING (item_id)""",
    "page_navigation": f"""WITH p AS {sql.PAGES}, t AS (SELECT book_id, max(page_num) AS total FROM p GROUP BY 1)
        SELECT book_id, page_num, array_to_string(list_sort(list_distinct(list_filter([1, 2, 3] || range(page_num - 4, page_num + 5) || range(total - 2, total + 1), lambda x: x >= 1 AND x <= total))), ',') AS links FROM p JOIN t USING (book_id)""",
    "simhash_native": f"""WITH w AS (SELECT doc_id, w, count(*) AS n, ('0x' || substr(sha256(w), 1, 16))::UBIGINT AS h FROM (SELECT doc_id, unnest(string_split({sql.normalize_import('text')}, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2)
        SELECT doc_id, lower(to_hex(list_sum([{_BITS}])::UBIGINT)) AS simhash FROM w GROUP BY 1""",
    "simhash_hamming_pairs": f"""WITH c AS (SELECT text_simhash AS h, min(book_id) AS book FROM {sql.BOOKS} WHERE text_simhash <> 0 GROUP BY 1)
        SELECT a.book AS book_a, b.book AS book_b, bit_count(xor(a.h, b.h))::INT AS distance FROM c a JOIN c b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 5""",
    "simhash_classes": f"""WITH b AS {sql.BOOKS} SELECT book_id, text_simhash, CASE WHEN text_simhash <> 0 THEN min(book_id) OVER (PARTITION BY text_simhash) ELSE book_id END AS class_book, CASE WHEN text_simhash <> 0 THEN count(*) OVER (PARTITION BY text_simhash) ELSE 1 END AS books FROM b""",
}
