"""Reference markers in texts, verse and hadith records, and search over them.

A stage of markers is resolved set-wise: each text is split into literals and markers, the markers
are joined with their records, and the answers are put between the literals again by position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx

#: The patterns of markers.
DELETED = "(?is)\\[\\[DELETE_START\\]\\].*?\\[\\[DELETE_END\\]\\]"
VERSE = "(?i)\\[\\[(?:FIX_)?QS\\s+(\\d{1,3}):(\\d{1,3})(?:\\s+([a-z0-9+_-]+))?\\]\\]"
BLOCK = "(?is)\\[\\[(?:ARABIC_BLOCK|FIX_ARABIC_BLOCK)\\s+([a-z0-9_.-]+)\\]\\]"
HADITH = "(?is)\\[\\[(?:FIX_HADITH|FIX_HADITH_LOCAL|HADITH)\\s+([a-z0-9_.-]+)\\s*:\\s*([0-9a-zA-Z_.-]+)(?:\\s+([a-z0-9+_-]+))?\\]\\]"
SEARCH = "(?is)\\[\\[(?:DORAR_SEARCH|FIX_HADITH_DORAR|CANDIDATE_HADITH_DORAR)\\s+(.+?)\\]\\]"

#: Names of collections by their usual name.
ALIASES = {
    "bukhari": ("sahih_bukhari", "sahih_al_bukhari", "bukhari",),
    "muslim": ("sahih_muslim", "sahih_al_muslim", "muslim",),
    "abudawud": ("sunan_abi_dawud", "sunan_abu_dawud", "abu_dawud", "abudawud", "abu_daud",),
    "tirmidhi": ("sunan_at_tirmidhi", "jami_at_tirmidhi", "jami_tirmidhi", "tirmidhi", "at_tirmidhi",),
    "nasai": ("sunan_an_nasai", "sunan_an_nasa_i", "sunan_an_nasa", "nasai", "an_nasai", "an_nasa_i",),
    "ibnmajah": ("sunan_ibn_majah", "ibn_majah", "ibnmajah",),
    "malik": ("muwatta_malik", "al_muwatta", "muwatta", "malik",),
    "ahmed": ("musnad_ahmad", "musnad_ahmed", "ahmad", "ahmed",),
    "darimi": ("darimi", "sunan_darimi",),
    "riyad_assalihin": ("riyad_as_salihin", "riyadh_as_salihin", "riyad_assalihin", "riyadussalihin",),
    "shamail_muhammadiyah": ("shamail_muhammadiyah",),
    "bulugh_almaram": ("bulugh_al_maram", "bulugh_almaram",),
    "aladab_almufrad": ("al_adab_al_mufrad", "aladab_al_mufrad", "aladab_almufrad",),
    "mishkat_almasabih": ("mishkat_al_masabih", "mishkat_almasabih",),
    "nawawi40": ("forty_hadith_nawawi", "nawawi40",),
    "qudsi40": ("forty_hadith_qudsi", "qudsi40",),
    "shahwaliullah40": ("forty_hadith_shah_waliullah", "shahwaliullah40",),
}
#: The order of collections in results; others come after with 100.
PRIORITY = {
    "bukhari": 0, "muslim": 1, "abudawud": 2, "tirmidhi": 3, "nasai": 4, "ibnmajah": 5, "malik": 6, "ahmed": 7, "darimi": 8,
    "riyad_assalihin": 20, "mishkat_almasabih": 21, "bulugh_almaram": 22, "aladab_almufrad": 23, "shamail_muhammadiyah": 24, "nawawi40": 30, "qudsi40": 31, "shahwaliullah40": 32,
}
#: Queries that are broadcast at once against all records.
QUERY_BLOCK = 10_000
#: The text fields of a hadith record, in order.
FIELDS = ("arabic", "translation_id", "translation_en", "english_text", "text", "narrator", "english_narrator", "chapter_title_ar", "chapter_title_en")


def flat_name(name: Column) -> Column:
    """A collection's name in lower case, with underscores between its words."""
    low = F.regexp_replace(F.lower(tx.nfkc(F.trim(name))), "['`]", "")
    return F.btrim(F.regexp_replace(low, "[^a-z0-9]+", "_"), F.lit("_"))


def collection(name: Column) -> Column:
    """The usual name of a collection."""
    flat = flat_name(name)
    table = F.create_map(*[F.lit(x) for usual, names in ALIASES.items() for n in names for x in (n, usual)])
    return F.coalesce(table[flat], flat)


def with_collection(rows: DataFrame, name: str, known: DataFrame) -> DataFrame:
    """``rows`` with ``coll``: of the collections in ``known`` the one that column ``name`` means, else its usual name.

    By its usual name, then as it is written, then without underscores. ``known``: collection; a dimension of few rows.
    """
    names = known.select("collection").where("collection IS NOT NULL").distinct()
    plain = lambda c: F.regexp_replace(c, "_", "")
    compact = names.groupBy(plain(F.col("collection")).alias("short")).agg(F.min("collection").alias("long"))
    j = rows.withColumns({"__usual": collection(F.col(name)), "__flat": flat_name(F.col(name))})
    for i, c in enumerate(("__usual", "__flat")):
        j = j.join(names.select(F.col("collection").alias(f"__n{i}")), F.col(c) == F.col(f"__n{i}"), "left")
        j = j.join(compact.select(F.col("short").alias(f"__s{i}"), F.col("long").alias(f"__l{i}")), plain(F.col(c)) == F.col(f"__s{i}"), "left")
    return j.withColumn("coll", F.coalesce("__n0", "__n1", "__l0", "__l1", "__usual")).select(*rows.columns, "coll")


def verse_key(surah: Column, ayah: Column) -> Column:
    return F.concat_ws(":", surah.cast("int").cast("string"), ayah.cast("int").cast("string"))


def parse_verses(lines: DataFrame) -> DataFrame:
    """key, surah, ayah, text from lines ``surah|ayah|text``; comments and broken lines are skipped."""
    parts = F.split("value", "\\|", 3)
    rows = lines.where(~F.trim("value").startswith("#") & (F.size(parts) == 3)).select(parts[0].alias("s"), parts[1].alias("a"), F.trim(parts[2]).alias("text"))
    rows = rows.where(F.col("s").rlike("^\\s*\\d+\\s*$") & F.col("a").rlike("^\\s*\\d+\\s*$"))
    rows = rows.select(F.trim("s").cast("int").alias("surah"), F.trim("a").cast("int").alias("ayah"), "text")
    return rows.select(verse_key(F.col("surah"), F.col("ayah")).alias("key"), "surah", "ayah", "text")


def merge_verses(sources: list[DataFrame], columns: tuple[str, ...] = ("arabic", "translation_id", "translation_en")) -> DataFrame:
    """One row a verse; a column's value is that of the first source that has it."""
    union = None
    for i, s in enumerate(sources):
        own = s.select("key", F.lit(i).alias("p"), *[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) if c in s.columns else F.lit(None).cast("string").alias(c) for c in columns])
        union = own if union is None else union.unionByName(own)
    return union.groupBy("key").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("p"))).alias(c) for c in columns])


def hadith_records(items: DataFrame, chapters: DataFrame) -> DataFrame:
    """Records from nested items: number, narrator and text joined, chapter titles by a left join.

    items: collection, idInBook, numberInBook, number, id, chapterId, arabic, narrator, text;
    chapters: collection, id, arabic, english. Items without a whole number are skipped.
    """
    number = F.coalesce(*[F.col(c).cast("string") for c in ("idInBook", "numberInBook", "number", "id")])
    rows = items.withColumn("n", F.expr("try_cast(" + "coalesce(cast(idInBook as string), cast(numberInBook as string), cast(number as string), cast(id as string)) as int)")).where("n IS NOT NULL").drop("number").withColumn("number", number)
    ch = chapters.select(F.col("collection").alias("cc"), F.col("id").alias("ci"), F.col("arabic").alias("chapter_title_ar"), F.col("english").alias("chapter_title_en"))
    j = rows.join(ch, (F.col("collection") == F.col("cc")) & (F.col("chapterId") == F.col("ci")), "left")
    english = F.concat_ws("\n\n", F.nullif(F.trim("narrator"), F.lit("")), F.nullif(F.trim("text"), F.lit("")))
    return j.select("collection", F.col("n").cast("string").alias("number"), F.concat_ws(":", "collection", F.col("n").cast("string")).alias("key"), "arabic", english.alias("translation_id"), english.alias("translation_en"), F.col("text").alias("english_text"), "text", "narrator", F.col("narrator").alias("english_narrator"), "chapter_title_ar", "chapter_title_en")


def collection_totals(records: DataFrame) -> DataFrame:
    return records.groupBy("collection").agg(F.count("*").alias("hadith_count"), F.count_distinct("chapter_title_en").alias("chapter_count"))


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def format_verse(mode: Column, arabic: Column, indonesian: Column, english: Column) -> Column:
    """The parts a mode names, always in the order ar, id, en; an unknown mode gives the Arabic."""
    m = F.array_sort(F.array_distinct(F.split(F.lower(F.coalesce(mode, F.lit("ar"))), "\\+")))
    known = F.forall(m, lambda x: x.isin("ar", "id", "en")) & (F.size(F.split(F.coalesce(mode, F.lit("ar")), "\\+")) == F.size(m))
    part = lambda k, v: F.when(F.array_contains(m, k), v)
    return F.when(known, _joined(part("ar", arabic), part("id", indonesian), part("en", english))).otherwise(F.coalesce(F.trim(arabic), F.lit("")))


def format_hadith(mode: Column, arabic: Column, translation: Column, grade: Column) -> Column:
    """Arabic, translation or both, with the grade after a translation; other modes give the Arabic."""
    m = F.lower(F.coalesce(mode, F.lit("ar")))
    rated = F.when(F.nullif(F.trim(grade), F.lit("")).isNotNull(), F.concat(F.lit("Derajat: "), F.trim(grade)))
    return F.when(m == "id", _joined(translation, rated)).when(m.isin("ar+id", "id+ar"), _joined(arabic, translation, rated)).otherwise(F.coalesce(F.trim(arabic), F.lit("")))


def source_label(collection_name: Column, number: Column) -> Column:
    """Where a record comes from: its collection and number, those that are known."""
    return F.concat_ws(" ", F.nullif(F.trim(collection_name), F.lit("")), F.concat(F.lit("no. "), F.nullif(F.trim(number), F.lit(""))))


def preview(*fields: Column) -> Column:
    """The first two fields that are filled."""
    filled = F.filter(F.array(*[F.nullif(F.trim(f), F.lit("")) for f in fields]), lambda x: x.isNotNull())
    return F.array_join(F.slice(filled, 1, 2), "\n\n")


def replace_markers(texts: DataFrame, pattern: str, groups: int, answers, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(texts with markers replaced, one row a marker).

    ``answers`` takes a frame (key, place, marker, g1, g2, ...) and returns it with ``answer`` (what
    stands instead) and ``found``.
    """
    marks = texts.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(f"({pattern})" if not pattern.startswith("(?") else pattern[: pattern.index(")") + 1] + "(" + pattern[pattern.index(")") + 1 :] + ")"), 1)).alias("place", "marker"))
    marks = marks.select("*", *[F.regexp_extract("marker", pattern, i).alias(f"g{i}") for i in range(1, groups + 1)])
    answered = answers(marks)
    per = answered.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "answer"))).alias("answers"))
    literals = F.split("text", pattern, -1)
    whole = F.array_join(F.transform(F.arrays_zip(literals.alias("l"), F.concat("answers", F.array(F.struct(F.lit(0).alias("place"), F.lit("").alias("answer")))).alias("a")), lambda z: F.concat(z["l"], z["a"]["answer"])), "")
    out = texts.join(per, key, "left").withColumn("text", F.when(F.col("answers").isNull(), F.col("text")).otherwise(whole)).drop("answers")
    return out, answered


def resolve(texts: DataFrame, verses: DataFrame, hadith: DataFrame, blocks: DataFrame, choices: DataFrame | None = None, policy: str = "preserve") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) with all markers resolved in their fixed order, and the unresolved markers.

    texts: doc_id, text; verses: key, arabic, translation_id, translation_en; hadith: records;
    blocks: block_id, text. Later stages see what earlier ones put in.
    """
    t = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("deleted", F.regexp_count("text", F.lit(DELETED)))
    t = t.withColumn("text", F.regexp_replace("text", DELETED, ""))
    unresolved = []

    def verse(m: DataFrame) -> DataFrame:
        m = m.withColumn("k", verse_key(F.col("g1"), F.col("g2")))
        v = verses.select(F.col("key").alias("k"), "arabic", "translation_id", "translation_en", F.lit(True).alias("hit"))
        said = format_verse(F.nullif("g3", F.lit("")), F.col("arabic"), F.col("translation_id"), F.col("translation_en"))
        return m.join(v, "k", "left").select("doc_id", "place", "marker", F.when(F.col("hit"), said).otherwise(F.concat(F.lit("[[ERROR_QS_NOT_FOUND "), "k", F.lit("]]"))).alias("answer"), F.coalesce("hit", F.lit(False)).alias("found"))

    def record(m: DataFrame) -> DataFrame:
        m = with_collection(m, "g1", hadith)
        whole = F.when(F.col("g2").rlike("^[0-9]+$"), F.expr("cast(cast(g2 as decimal(38)) as string)"))
        keys = [F.concat_ws(":", "coll", "g2"), whole, F.concat_ws("_", "coll", "g2"), F.concat_ws("-", "coll", "g2"), F.col("g2")]
        # A record is looked up by its key, in five forms, then by its number.
        tries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(by).alias("by"), k.alias("k")) for by, own in (("key", keys), ("number", [keys[1], keys[4]])) for i, k in enumerate(own, 0 if by == "key" else 5)])
        each = m.select("doc_id", "place", "coll", F.explode(tries).alias("t")).select("doc_id", "place", "coll", "t.*")
        h = hadith.select(F.col("collection").alias("coll"), F.explode(F.array(F.struct(F.lit("key").alias("by"), F.col("key").alias("k")), F.struct(F.lit("number").alias("by"), F.col("number").alias("k")))).alias("t"), "key", "arabic", F.coalesce("translation_id", "translation_en").alias("tr")).select("coll", "t.*", F.struct("key", "arabic", "tr").alias("r"))
        hit = each.join(h, ["coll", "by", "k"]).groupBy("doc_id", "place").agg(F.min_by("r", F.struct("i", "r.key")).alias("r"))
        j = m.join(hit, ["doc_id", "place"], "left")
        said = format_hadith(F.nullif("g3", F.lit("")), F.col("r.arabic"), F.col("r.tr"), F.lit(None).cast("string"))
        return j.select("doc_id", "place", "marker", F.when(F.col("r").isNotNull(), said).otherwise(F.col("marker")).alias("answer"), F.col("r").isNotNull().alias("found"))

    def block(m: DataFrame) -> DataFrame:
        b = blocks.select(F.lower("block_id").alias("bid"), F.trim("text").alias("btext")).dropDuplicates(["bid"])
        j = m.withColumn("bid", F.lower("g1")).join(b, "bid", "left")
        ok = F.coalesce(F.col("btext") != "", F.lit(False))
        return j.select("doc_id", "place", "marker", F.when(ok, F.col("btext")).otherwise(F.col("marker")).alias("answer"), ok.alias("found"))

    def searched(m: DataFrame) -> DataFrame:
        parts = F.split(F.trim("g1"), "\\s*::\\s*", 2)
        m = m.withColumns({"query": parts[0], "mode": F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("ar"))})
        wanted = m.select("query").distinct()
        best = search_records(wanted.withColumn("query_id", F.xxhash64("query")), hadith, 50)
        pick = best.select("query", (F.col("rank") - 1).alias("i"), "arabic", F.coalesce("translation_id", "translation_en").alias("tr"))
        chosen = choices if choices is not None else m.sparkSession.createDataFrame([], "query string, choice int")
        m = m.join(chosen, "query", "left").withColumn("i", F.coalesce("choice", F.lit(0) if policy in ("first", "auto", "replace_first") else F.lit(None).cast("int")))
        j = m.join(pick, ["query", "i"], "left")
        ok = F.col("arabic").isNotNull() | F.col("tr").isNotNull()
        return j.select("doc_id", "place", "marker", F.when(ok, format_hadith(F.col("mode"), F.col("arabic"), F.col("tr"), F.lit(None).cast("string"))).otherwise(F.col("marker")).alias("answer"), ok.alias("found"))

    for kind, pattern, n, answers in (("verse", VERSE, 3, verse), ("hadith", HADITH, 3, record), ("block", BLOCK, 1, block), ("search", SEARCH, 1, searched)):
        t, marks = replace_markers(t, pattern, n, answers)
        unresolved.append(marks.where("NOT found").select("doc_id", F.lit(kind).alias("type"), "place", "marker"))
    rest = unresolved[0]
    for u in unresolved[1:]:
        rest = rest.unionByName(u)
    return t, rest


def search_records(queries: DataFrame, records: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, query, rank, score, exact, reason and the record: the additive search over records.

    A stated set of queries goes against all records in blocks of ``QUERY_BLOCK``: each block is broadcast,
    and the records are scanned once a block.
    """
    limit = min(max(limit, 1), 50)
    n = tx.normalize_reference
    hay = F.concat_ws(" \n ", *[F.nullif(F.col(c), F.lit("")) if c in records.columns else F.lit(None).cast("string") for c in FIELDS])
    r = records.select("*", n(hay).alias("hay"), n(F.coalesce("key", "number")).alias("nkey")).where("hay <> '' AND NOT startswith(coalesce(key, ''), '_')")
    q = queries.select("query_id", F.trim("query").alias("query")).where("query <> ''").withColumns({"nq": n(F.col("query")), "tokens": tx.reference_tokens(n(F.col("query")))})
    parts = F.regexp_extract("query", "(?i)^([a-z0-9_]+)\\s*:\\s*([0-9a-zA-Z_.-]+)$", 1), F.regexp_extract("query", "(?i)^([a-z0-9_]+)\\s*:\\s*([0-9a-zA-Z_.-]+)$", 2)
    q = q.withColumns({"pc": F.nullif(collection(parts[0]), F.lit("")), "pn": F.nullif(parts[1], F.lit(""))})
    hits = F.size(F.filter("tokens", lambda t: F.contains(F.col("hay"), t)))
    number = max(1, -(-q.count() // QUERY_BLOCK))
    blocks = [F.broadcast(q.where(F.pmod(F.xxhash64("query_id"), F.lit(number)) == i) if number > 1 else q) for i in range(number)]
    parts = [r.join(b, F.col("pc").isNull() | (F.col("pc") == F.col("collection"))) for b in blocks]
    j = reduce(DataFrame.unionByName, parts).withColumn("hits", hits)
    yes = lambda c, w: F.when(F.coalesce(c, F.lit(False)), float(w)).otherwise(0.0)
    same, number, key = F.col("nq") == F.col("hay"), F.col("pn") == F.col("number"), F.col("nq") == F.col("nkey")
    digits = F.col("query").rlike("^\\d+$") & (F.col("number") == F.col("query"))
    arabic = F.col("query").rlike("[\\u0600-\\u06ff]") & F.coalesce("arabic", F.lit("")).rlike("[\\u0600-\\u06ff]")
    score = yes(same, 1000) + yes((F.col("nq") != "") & F.contains("hay", "nq"), 500) + F.col("hits") * 40.0 + F.col("hits") / F.greatest(F.size("tokens"), F.lit(1)) * 30.0 + yes(arabic, 20) + yes(number, 160)
    score = score + yes(F.col("pc") == F.col("collection"), 25) + yes(digits, 140) + yes(key, 150) + yes((F.col("nq") != "") & F.contains("nkey", "nq"), 40)
    reason = F.when(same, "teks").when(number | digits, "nomor").when(key, "kode")
    j = j.withColumns({"score": score, "reason": F.coalesce(reason, F.lit("")), "exact": reason.isNotNull()}).where("score > 0")
    place = F.lit(100)
    for name, p in PRIORITY.items():
        place = F.when(F.col("collection") == name, p).otherwise(place)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), place, "collection", "number", "key")
    return j.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("hay", "nkey", "nq", "tokens", "pc", "pn", "hits")
