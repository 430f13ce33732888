"""Signatures of books, exact and near duplicates, families and their canonical records."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill import work
from leafmill.functions import hashing
from leafmill.functions import text as tx
from leafmill.operators import matching

#: Ranks that choose a family's canonical record; anything else ranks 0.
QUALITY = {"ok": 3, "warn": 2}
CONVERSION = {"good": 3, "degraded": 2}
REVIEW = {"approved_manual": 4, "approved_lease": 4, "approved_auto": 3, "pending_review": 1}
SOURCE = {"docx": 6, "pdf": 5, "doc": 4, "txt": 3, "html": 2, "ibooks": 1}
SIMILAR, PAGE_RATIO = 0.92, 0.45
#: What equal titles add to a score, and the similarity of titles from which they do.
BONUS, TITLES = 0.08, 0.4
TILE = 4096


def page_hashes(pages: DataFrame, normalize: Callable[[Column], Column]) -> DataFrame:
    """book_id, page_num, page_hash of the pages that are not blank when normalised."""
    rows = pages.select("book_id", "page_num", normalize(F.coalesce("content", F.lit(""))).alias("t")).where("t <> ''")
    return rows.select("book_id", "page_num", hashing.sha256(F.col("t")).alias("page_hash"))


def signatures(pages: DataFrame, normalize: Callable[[Column], Column], joiner: str = " ") -> DataFrame:
    """book_id, content_hash, text_hash, page_count of the non-blank normalised pages.

    ``joiner`` joins the pages for the text hash: a space for imports, a line feed for edits; the
    two kinds of signatures are not comparable. The hashes run over a book's pages in order, as a
    stream over sorted partitions: no book's text is ever held as a whole.
    """
    rows = pages.where("book_id IS NOT NULL").select("book_id", "page_num", normalize(F.coalesce("content", F.lit(""))).alias("t")).where("t <> ''")
    ordered = rows.repartition("book_id").sortWithinPartitions("book_id", "page_num")
    glue = joiner.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, pages_hash, text_hash, n = None, hashlib.sha256(), hashlib.sha256(), 0

        def result(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], ["book_id", "content_hash", "text_hash", "page_count"])

        for batch in batches:
            done = []
            for b, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if b != book:
                    if n:
                        done.append((book, pages_hash.hexdigest(), text_hash.hexdigest(), n))
                    book, pages_hash, text_hash, n = b, hashlib.sha256(), hashlib.sha256(), 0
                data = t.encode()
                pages_hash.update((b"\n" if n else b"") + hashlib.sha256(data).hexdigest().encode())
                if n:
                    text_hash.update(glue)
                text_hash.update(data)
                n += 1
            yield result(done)
        yield result([(book, pages_hash.hexdigest(), text_hash.hexdigest(), n)] if n else [])

    return ordered.mapInArrow(run, "book_id string, content_hash string, text_hash string, page_count int")


def first_by_source_hash(books: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The first file of each source hash (by size, extension, path) that ``seen`` doesn't have."""
    new = books.where("source_hash IS NOT NULL AND source_hash <> ''")
    if seen is not None:
        new = new.join(seen.select("source_hash").distinct(), "source_hash", "left_anti")
    order = Window.partitionBy("source_hash").orderBy("size_bytes", "source_ext", "source_path", "book_id")
    return new.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def family_lookup(books: DataFrame, families: DataFrame) -> DataFrame:
    """book_id, family_key, matched: the family with the book's content hash, else with its text hash."""
    by = lambda column: families.where(f"{column} IS NOT NULL AND {column} <> ''").groupBy(F.col(column).alias("__h")).agg(F.min("family_key").alias("k"))
    c, t = by("content_hash").withColumnsRenamed({"__h": "hc", "k": "kc"}), by("text_hash").withColumnsRenamed({"__h": "ht", "k": "kt"})
    found = books.select("book_id", "content_hash", "text_hash").join(c, F.col("content_hash") == F.col("hc"), "left").join(t, F.col("text_hash") == F.col("ht"), "left")
    return found.select("book_id", F.coalesce("kc", "kt").alias("family_key"), F.when(F.col("kc").isNotNull(), "content_hash").when(F.col("kt").isNotNull(), "text_hash").otherwise("none").alias("matched"))


def _page_sets(pages: DataFrame) -> DataFrame:
    """book_id, n, s, s2: each book's number of different pages, and two sums of their hashes that stand for the set."""
    known = "page_hash IS NOT NULL AND page_hash <> ''"
    own = pages.select("book_id", F.when(F.expr(known), F.col("page_hash")).alias("page_hash")).distinct()
    total = lambda *seed: F.coalesce(F.sum(F.when(F.col("page_hash").isNotNull(), F.xxhash64("page_hash", *seed)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return own.groupBy("book_id").agg(F.count("page_hash").alias("n"), total().alias("s"), total(F.lit(7)).alias("s2"))


def page_jaccard(pages: DataFrame) -> DataFrame:
    """book_a, book_b, shared, jaccard of the books that share a page: an equi-join on page hashes.

    ``pages``: book_id, page_hash. Books with the same set of pages form one class (by the hash of
    their sorted pages) and are represented by the first of them, so copies don't multiply the join;
    ``page_classes`` has the members.
    """
    own = pages.where("page_hash IS NOT NULL AND page_hash <> ''").distinct()
    reps = _page_sets(own).groupBy("n", "s", "s2").agg(F.min("book_id").alias("book_id")).select("book_id", "n")
    rows = own.join(reps, "book_id")
    a, b = (rows.select("page_hash", F.col("book_id").alias(f"book_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = a.join(b, "page_hash").where("book_a < book_b").groupBy("book_a", "book_b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    return pairs.select("book_a", "book_b", "shared", tx.round4(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))


def page_classes(pages: DataFrame) -> DataFrame:
    """book_id, class_book, pages, books: every book with the first book of its set of pages, which ``page_jaccard`` names.

    ``pages``: book_id, page_hash. Books of one class have Jaccard 1. A book without any page hash
    shares nothing: it is a class of its own.
    """
    sets = _page_sets(pages)
    classes = sets.where("n > 0").groupBy("n", "s", "s2").agg(F.min("book_id").alias("first"), F.count("*").alias("books"))
    return sets.join(classes, ["n", "s", "s2"], "left").select("book_id", F.coalesce("first", "book_id").alias("class_book"), F.col("n").alias("pages"), F.coalesce("books", F.lit(1)).alias("books"))


def page_jaccard_near(pages: DataFrame, least: float = 0.8) -> DataFrame:
    """book_a, book_b, shared, jaccard of the books whose sets of pages have at least that Jaccard similarity.

    Like ``page_jaccard``, but books meet only by their rarest pages (prefix filtering): of n pages as many
    as two similar sets can't both leave out. Pages that very many books have make no pairs.
    """
    own = pages.where("page_hash IS NOT NULL AND page_hash <> ''").distinct()
    reps = _page_sets(own).groupBy("n", "s", "s2").agg(F.min("book_id").alias("book_id")).select("book_id", "n")
    rows = own.join(reps, "book_id").select(F.col("book_id").alias("pos"), F.col("page_hash").alias("h"), "n")
    rare = _rarest(rows, least)
    pairs = _earlier(rare.select("pos", "h"), rare.select("pos", "h"), ["h"]).distinct()
    both = _shared(pairs, rows.select("pos", "h")).join(reps.selectExpr("book_id as pos", "n as x"), "pos").join(reps.selectExpr("book_id as at", "n as y"), "at")
    jaccard = F.col("shared") / (F.col("x") + F.col("y") - F.col("shared"))
    return both.where(jaccard >= least).select(F.col("at").alias("book_a"), F.col("pos").alias("book_b"), "shared", tx.round4(jaccard).alias("jaccard"))


def _rarest(pages: DataFrame, least: float) -> DataFrame:
    """Of each set (pos, h, n) the rarest members by which sets of that similarity must meet."""
    order = Window.partitionBy("pos").orderBy("uses", "h")
    ranked = pages.join(pages.groupBy("h").agg(F.count("*").alias("uses")), "h").withColumn("i", F.row_number().over(order))
    return ranked.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1)


def _shared(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """pos, at, shared: how many pages two sets have in common, counted on rows."""
    both = pairs.join(pages, "pos").join(pages.withColumnRenamed("pos", "at"), ["at", "h"])
    return both.groupBy("pos", "at").agg(F.count("*").alias("shared"))


def near_duplicates(catalog: DataFrame, pages: DataFrame, threshold: float = SIMILAR, new: DataFrame | None = None) -> DataFrame:
    """The best earlier record for each record: exact hashes first, then page overlap or SimHash with a title bonus.

    ``catalog``: pos (a total order), book_id, language, title, page_count, content_hash, text_hash,
    simhash; ``pages``: pos, h (page hashes; records without any have no duplicate). A record's best is the best
    of what four searches find. The first three keep one row a record (the first one for each hash), so that what
    they shuffle grows with the records and not with the pairs that are alike:

    * equal hashes or SimHashes: the earliest record of each that fits in language and page count;
    * SimHashes within five bits, whatever the titles: the nearest, by three of eight blocks;
    * SimHashes within ten bits and titles that earn the bonus: the best that shares one of the title's rarest words;
    * page overlap of the threshold less the bonus: all pairs with a shared page among each record's rarest pages
      (prefix filtering) and sizes that allow it, so pages that many books have, such as empty ones, make no pairs.

    The SimHash searches rank by SimHash and title, which give a pair's score or less; a pair whose pages give
    more is among those of the last. Pages, title words and languages are compared as 64-bit hashes, exact hashes
    as 128-bit ones. As the catalog grows, ``new`` (pos) names the records to look up: those that come after the others.
    """
    if threshold <= 1 - 6 / 64:
        raise ValueError("the blocks are derived for thresholds over 0.90625")
    c, pages = _numbered(catalog, pages)
    overlapping = _page_pairs(c, pages, threshold - BONUS)
    pairs = _equal_pairs(c).unionByName(overlapping).unionByName(_simhash_pairs(c)).unionByName(_title_pairs(c, threshold)).distinct()
    if new is not None:
        pairs = pairs.join(c.join(new.select(F.col("pos").alias("key")).distinct(), "key", "left_semi").select("pos"), "pos", "left_semi")
    c = c.drop("key", "kind")
    old = c.select(*[F.col(k).alias(f"o_{k}") for k in c.columns])
    p = pairs.join(_shared(overlapping, pages.select("pos", "h")), ["pos", "at"], "left").join(c, "pos").join(old, F.col("at") == F.col("o_pos"))
    exact = F.coalesce(F.col("content") == F.col("o_content"), F.lit(False)) | F.coalesce(F.col("text") == F.col("o_text"), F.lit(False))
    shared = F.coalesce("shared", F.lit(0))
    jaccard = shared / (F.col("n") + F.col("o_n") - shared)
    alike = F.when((F.col("simhash") != 0) & (F.col("o_simhash") != 0), 1.0 - hashing.hamming(F.col("simhash"), F.col("o_simhash")) / 64.0).otherwise(0.0)
    title = F.coalesce(F.try_divide(F.size(F.array_intersect("words", "o_words")), F.size(F.array_union("words", "o_words"))), F.lit(0.0))
    p = p.where(_fits()).withColumns({"exact": exact, "base": F.greatest(jaccard, alike), "by_text": alike > jaccard, "titles": title})
    bonus = (F.col("base") >= 0.80) & (F.col("titles") >= TITLES)
    score = F.when(F.col("exact"), 1.0).when(bonus, F.least(F.lit(1.0), F.col("base") + F.least(F.lit(BONUS), F.col("titles") * BONUS))).otherwise(F.col("base"))
    kind = F.when(F.col("content") == F.col("o_content"), "exact").when(F.col("text") == F.col("o_text"), "text_exact")
    reason = F.coalesce(kind, F.concat(F.when(F.col("by_text"), "text_similarity").otherwise("page_overlap"), F.when(bonus, "+title").otherwise("")))
    p = p.withColumns({"score": score, "reason": reason}).where(F.col("exact") | (F.col("score") >= threshold))
    # An exact match ends the search at the first in order; else the greatest score, the earliest of equals.
    rank = F.struct(-F.col("exact").cast("int"), -F.when(F.col("exact"), 0.0).otherwise(F.col("score")), "at")
    return p.groupBy("book_id").agg(F.min_by(F.struct(F.col("o_book_id").alias("duplicate_of"), tx.round4(F.col("score")).alias("score"), "reason"), rank).alias("m")).select("book_id", "m.*")


def _numbered(catalog: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records with a number in their order as ``pos`` (and it as ``key``), and pos, h, n of their pages; both staged.

    ``lang`` is 0 for unknown; a missing language fits no other, a missing page count any.
    """
    own = pages.where("h IS NOT NULL").select(F.col("pos").alias("key"), F.xxhash64("h").alias("h")).distinct()
    sets = own.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("h").alias("s1"), F.bit_xor(F.xxhash64("h", F.lit(7))).alias("s2"))
    words = F.filter(F.split(tx.normalize_import(F.coalesce("title", F.lit("")), compat=False), " "), lambda w: w != "")
    lang = F.when(F.col("language") == "unknown", F.lit(0).cast("bigint")).when(F.col("language").isNull(), F.xxhash64("pos", F.lit(1))).otherwise(F.xxhash64("language"))
    short = lambda k: F.unhex(F.md5(F.col(k)))
    c = catalog.select(F.col("pos").alias("key"), "book_id", lang.alias("lang"), F.coalesce(F.col("page_count").cast("bigint"), F.lit(0)).alias("page_count"), short("content_hash").alias("content"), short("text_hash").alias("text"), F.coalesce("simhash", F.lit(0).cast("bigint")).alias("simhash"), F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))).alias("words"))
    c = c.join(sets, "key").withColumn("kind", F.xxhash64("n", "s1", "s2", "simhash", "lang", "page_count", "words")).drop("s1", "s2")
    # Partitions come in the order of the keys, and ids within and over partitions in theirs.
    c = work.stage(c.repartitionByRange("key").sortWithinPartitions("key").withColumn("pos", F.monotonically_increasing_id()), "records")
    return c, work.stage(own.join(c.select("key", "pos", "n"), "key").select("pos", "h", "n"), "record-pages")


def _fits() -> Column:
    """Whether a record and an earlier one (o_) fit in language and page count."""
    language = (F.col("lang") == 0) | (F.col("o_lang") == 0) | (F.col("lang") == F.col("o_lang"))
    ratio = F.try_divide(F.least("page_count", "o_page_count"), F.greatest("page_count", "o_page_count"))
    return language & ((F.col("page_count") <= 0) | (F.col("o_page_count") <= 0) | (ratio >= PAGE_RATIO))


def _earlier(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
    """pos, at: rows of ``x`` with earlier rows of ``y``."""
    return x.join(y.withColumnRenamed("pos", "at"), on).where("at < pos").select("pos", "at")


def _equal_pairs(c: DataFrame) -> DataFrame:
    """The earliest record that fits, by each of a record's hashes: records of a hash that are alike in what fits have the same."""
    key = lambda k, there: F.when(there, F.xxhash64(F.lit(k), k))
    keys = F.array_compact(F.array(*[key(k, F.col(k).isNotNull()) for k in ("content", "text")], key("simhash", F.col("simhash") != 0)))
    keyed = c.select("pos", "lang", "page_count", F.explode(keys).alias("key"))
    kinds = keyed.groupBy("key", "lang", "page_count").agg(F.min("pos").alias("pos"))
    fitting = kinds.drop("pos").join(kinds.select("key", F.col("lang").alias("o_lang"), F.col("page_count").alias("o_page_count"), F.col("pos").alias("at")), "key").where(_fits())
    first = fitting.groupBy("key", "lang", "page_count").agg(F.min("at").alias("at"))
    return keyed.join(first, ["key", "lang", "page_count"]).where("at < pos").select("pos", "at")


def _page_pairs(c: DataFrame, pages: DataFrame, least: float) -> DataFrame:
    prefix = _rarest(pages, least).select("pos", "h", "n")
    # Books with the same pages that are alike in all that counts stand for one another.
    first = prefix.join(c.select("pos", "kind"), "pos").groupBy("h", "kind", F.col("n").alias("m")).agg(F.min("pos").alias("at"))
    both = prefix.join(first, "h").where((F.col("at") < F.col("pos")) & (F.least("n", "m") >= F.greatest("n", "m") * F.lit(least) - 1e-9))
    return both.select("pos", "at").distinct()


def _best(rows: DataFrame, search: Callable) -> DataFrame:
    """pos, at: the best of what the search finds in a record's buckets."""
    found = rows.repartition("bucket").sortWithinPartitions("bucket", "pos").mapInArrow(search, "pos long, at long, score double")
    return found.groupBy("pos").agg(F.min_by("at", F.struct(-F.col("score"), "at")).alias("at"))


def _simhash_pairs(c: DataFrame) -> DataFrame:
    """The nearest within five bits, of the first record of each kind: the others have it as their equal."""
    kinds = c.where("simhash <> 0").groupBy("simhash", "lang", "page_count").agg(F.min("pos").alias("pos"))
    keyed = kinds.withColumn("b", F.explode(hashing.shared_blocks(F.col("simhash"), 5)))
    return _best(keyed.select(F.xxhash64("b.i", "b.part").alias("bucket"), "pos", "simhash", "lang", "page_count"), matching.best_earlier(5, PAGE_RATIO))


def _title_pairs(c: DataFrame, threshold: float) -> DataFrame:
    """The best by SimHash and title for the records of each kind, which is the same for all, or their first.

    The records that share a word are compared in tiles of about TILE.
    """
    kind = ["simhash", "lang", "page_count", "words"]
    known = c.where("simhash <> 0 AND size(words) > 0").select("pos", *kind)
    kinds = known.groupBy(*kind).agg(F.min("pos").alias("pos"))
    rare = _rarest(kinds.select("pos", F.explode("words").alias("h"), F.size("words").alias("n")), TITLES).where("uses > 1")
    tiles = F.ceil(F.col("uses") / TILE)
    rows = rare.withColumn("k", F.pmod(F.xxhash64("pos"), tiles)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1)))
    rows = rows.select(F.xxhash64("h", F.least("k", "o"), F.greatest("k", "o")).alias("bucket"), "pos", F.when(F.col("k") == F.col("o"), F.lit(-1).cast("bigint")).otherwise(F.col("k")).alias("side"))
    bits = int((1 - threshold + BONUS) * 64 + 1e-9)
    found = _best(rows.join(kinds, "pos"), matching.best_earlier(bits, PAGE_RATIO, threshold, BONUS, TITLES))
    return known.join(found.join(kinds, "pos").select("at", *kind), kind).select("pos", "at")


def family_key(books: DataFrame, strict: bool = False) -> Column:
    """``language||type||stem``; a blank stem (another script) stands for the book alone unless ``strict``."""
    part = lambda c, d: F.coalesce(F.nullif(F.lower(F.trim(F.col(c))), F.lit("")), F.lit(d))
    stem = tx.stem_key(F.regexp_replace(F.coalesce("filename", F.lit("")), "\\.[^.]*$", ""))
    if not strict:
        stem = F.coalesce(F.nullif(stem, F.lit("")), F.concat(F.lit("#"), "book_id"))
    return F.concat_ws("||", part("language", "unknown"), part("document_type", "book"), stem)


def _rank(column: str, order: dict[str, int]) -> Column:
    value = F.lower(F.trim(F.col(column)))
    out = F.lit(0)
    for k, n in order.items():
        out = F.when(value == k, n).otherwise(out)
    return out


def ranked_families(books: DataFrame, strict: bool = False) -> DataFrame:
    """The books with family_key and rank within the family, the canonical record first.

    A family's rank is a window over narrow keys; the order is total as json_path and book_id end it.
    """
    ready = F.coalesce(F.col("intake_ready").cast("int"), F.lit(0)) if "intake_ready" in books.columns else F.lit(0)
    keys = [_rank("quality_status", QUALITY), _rank("conversion_status", CONVERSION), _rank("review_status", REVIEW), ready, F.coalesce("total_pages", F.lit(0)), _rank("source_type", SOURCE), F.coalesce("size_bytes", F.lit(0)), F.coalesce("json_path", F.lit("")), F.col("book_id")]
    order = Window.partitionBy("family_key").orderBy(*[k.desc() for k in keys])
    return books.withColumn("family_key", family_key(books, strict)).withColumn("rank", F.row_number().over(order))


def family_upsert(books: DataFrame) -> DataFrame:
    """Families by content hash: sizes, latest hashes, members distinct by source hash."""
    keyed = books.where("content_hash IS NOT NULL AND content_hash <> ''")
    latest = F.struct("updated_at", "book_id")
    return keyed.groupBy("content_hash").agg(F.max("total_pages").alias("total_pages"), F.max("size_bytes").alias("size_bytes"), F.max_by("text_hash", latest).alias("text_hash"), F.count_distinct(F.coalesce(F.nullif("source_hash", F.lit("")), "book_id")).alias("members"), F.min("book_id").alias("first_book"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def new_chunks(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks that are neither repeated nor known."""
    return keep_first(chunks, ["chunk_hash"], [F.col("book_id"), F.col("unit"), F.col("chunk_idx")]).join(known.select("chunk_hash").distinct(), "chunk_hash", "left_anti")


def stored_points(points: DataFrame) -> DataFrame:
    """chunk_hash, point_id, points: of stored points with the same chunk the one that stays: an id that is no number, else the least.

    ``points``: chunk_hash, point_id (numbers as text).
    """
    number = F.col("point_id").rlike("^[0-9]+$")
    return points.where("chunk_hash IS NOT NULL").groupBy("chunk_hash").agg(F.min_by("point_id", F.struct(number, "point_id")).alias("point_id"), F.count("*").alias("points"))


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_hash, ref_count, kept: how many books hold each chunk text, and the id that stays."""
    return chunks.groupBy("chunk_hash").agg(F.count_distinct("book_id").alias("ref_count"), F.count("*").alias("points"), F.min("point_id").alias("kept"))
