"""Lexical and dense retrieval, their fusion and reranking, and evaluation; every step is keyed by query.

The lexical index has a row a document: its terms with their frequencies. It is built in one narrow pass
over the texts and kept in a folder. A search reads the index, not the texts: each Arrow batch of it
scores its documents for a block of queries and keeps only its best rows, as each batch of vectors does
by matrix products; the best of all is a window with a group limit. What is shuffled grows with
queries and batches, not with the documents that hold a term.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.work import shared_folder, stage

K1, B = 1.5, 0.75
#: Queries compared at once; embedding width of the offline embedder.
BLOCK, WIDTH = 4_096, 64

#: Words that are no keywords; groups of words with one meaning, by word.
STOPWORDS = (
    "apa", "bagaimana", "bagi", "dalam", "dengan", "dan", "dari", "di", "ke", "kepada", "oleh", "pada", "para", "sebagai", "sebab", "sesuai", "untuk", "yang", "atau", "itu", "ini", "cara",
    "tentang", "agar", "maka", "serta", "karena", "adalah", "ada", "berapa", "siapa", "what", "how", "the", "and", "of", "to", "in", "for", "is", "are",
)
_PRAYER, _PROPHET, _REPORT = ["salat", "shalat", "sholat"], ["hadis", "hadits", "muhammad", "nabi", "rasul", "sunnah"], ["hadis", "hadits"]
_WASHING, _NOVELTY = ["wudhu", "wudlu"], ["bid'ah", "bidaah", "bidah"]
EXPANSIONS = {
    "sholat": _PRAYER, "shalat": _PRAYER, "salat": _PRAYER, "nabi": _PROPHET, "rasul": _PROPHET, "muhammad": _PROPHET,
    "hadis": _REPORT, "hadits": _REPORT, "wudhu": _WASHING, "wudlu": _WASHING, "bidah": _NOVELTY, "bid'ah": _NOVELTY,
}


def plan_queries(queries: DataFrame, expansions: dict[str, list[str]] | None = None, compat: bool = True) -> DataFrame:
    """query_id, query, keywords, groups (of words with one meaning), terms, variants of each query."""
    table = EXPANSIONS if expansions is None else expansions
    mapping = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in sorted(v)]))])
    keywords = F.filter(tx.search_tokens(tx.normalize_search(F.coalesce("query", F.lit("")), compat=compat)), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))
    rows = queries.withColumn("keywords", keywords)
    groups = F.array_distinct(F.transform("keywords", lambda w: F.coalesce(mapping[w], F.array(w))))
    rows = rows.withColumn("groups", groups)
    merged = F.array_distinct(F.flatten("groups"))
    rows = rows.withColumn("terms", F.when(F.size(merged) > 0, merged).otherwise(F.array("query")))
    second = F.concat_ws(" ", "query", F.array_join(merged, " "))
    return rows.withColumn("variants", F.when(F.size(merged) > 0, F.array("query", second)).otherwise(F.array("query")))


def steady(x: Column) -> Column:
    """A score to nine places, by which rows are ranked: equal in every order of summation."""
    return F.floor(x * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)


def _steady(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e9 + 0.5) / 1e9


class Index(NamedTuple):
    """docs: doc_id, lang, length, terms, tfs of each document with a term; terms: term, df; totals: docs, mean_length."""

    docs: DataFrame
    terms: DataFrame
    totals: DataFrame


def tallied(docs: DataFrame, compat: bool = True) -> DataFrame:
    """doc_id, lang, length, terms, tfs: each document's terms (of title and text), sorted, with their frequencies."""
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select("doc_id", lang.cast("string").alias("lang"), tx.search_tokens(tx.normalize_search(body, compat=compat)).alias("tokens")).where(F.size("tokens") > 0)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_tally, f"doc_id {kind}, lang string, length int, terms array<string>, tfs array<int>")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = pa.concat_arrays([batch.column(2)])
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        kinds = pc.unique(flat)
        kinds = kinds.take(pc.sort_indices(kinds))
        key = np.repeat(np.arange(len(size)), size) * len(kinds) + pc.index_in(flat, kinds).to_numpy()
        pairs, tf = np.unique(key, return_counts=True)
        offsets = pa.array(np.searchsorted(pairs, np.arange(len(size) + 1) * len(kinds)).astype(np.int32))
        terms = kinds.take(pa.array(pairs % max(1, len(kinds))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], ["doc_id", "lang", "length", "terms", "tfs"])


def build_index(docs: DataFrame, folder: str, compat: bool = True) -> Index:
    """The index of ``docs`` (doc_id, title, text, lang), written into ``folder``; the totals come last, so that they mark it whole."""
    spark = docs.sparkSession
    tallied(docs, compat).write.mode("overwrite").parquet(f"{folder}/docs")
    rows = spark.read.parquet(f"{folder}/docs")
    rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")
    rows.agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")
    return load_index(spark, folder)


def load_index(spark: SparkSession, folder: str) -> Index:
    return Index(*[spark.read.parquet(f"{folder}/{name}") for name in Index._fields])


def kept_index(docs: DataFrame, path: str, compat: bool = True) -> Index:
    """The index of ``docs``, which are the table at ``path``: built unless the shared folder has that of the same state of the table."""
    spark = docs.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = hadoop(path).getFileSystem(conf)
    state = files.getContentSummary(hadoop(path))
    print_ = hashlib.sha256(f"{path}|{files.getFileStatus(hadoop(path)).getModificationTime()}|{state.getLength()}|{state.getFileCount()}|{compat}".encode()).hexdigest()[:24]
    folder = f"{shared_folder(spark)}/lexical-{print_}"
    done = hadoop(f"{folder}/totals/_SUCCESS")
    return load_index(spark, folder) if done.getFileSystem(conf).exists(done) else build_index(docs, folder, compat)


def postings(docs: DataFrame, compat: bool = True) -> DataFrame:
    """term, doc_id, tf, length: the inverted index."""
    return tallied(docs, compat).select("doc_id", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("x.terms", "doc_id", "x.tfs", "length").toDF("term", "doc_id", "tf", "length")


def _weight(tf, length, mean, idf):
    """BM25 of a term in a document; the same for columns and arrays."""
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / mean))


def _idf(index: Index) -> DataFrame:
    """term, idf, mean_length."""
    return index.terms.crossJoin(F.broadcast(index.totals)).select("term", F.log(1.0 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean_length")


def lexical(index: Index, plan: DataFrame, top_k: int = 5, by_language: bool = False, block: int = BLOCK) -> DataFrame:
    """query_id, doc_id, bm25, matched, lex_rank: the lexical candidates of each query, max(80, 8 top_k) at most.

    Queries are read in blocks, each broadcast with the weights of its terms. ``by_language``: a query with
    a language takes documents of that language only.
    """
    n = max(80, 8 * top_k, 50)
    spark = index.docs.sparkSession
    parts, held = [], []

    def flush() -> None:
        wanted = sorted({t for _, _, terms in held for t in terms})
        if wanted:
            rows = _idf(index).join(F.broadcast(spark.createDataFrame([(t,) for t in wanted], "term string")), "term").collect()  # the block's terms at most
            idf = {r.term: r.idf for r in rows}
            shared = spark.sparkContext.broadcast(([q for q, _, _ in held], [x for _, x, _ in held] if by_language else None, {t: [i for i, (_, _, own) in enumerate(held) if t in own] for t in wanted if t in idf}, idf, rows[0].mean_length if rows else 1.0))
            parts.append(index.docs.mapInArrow(functools.partial(_score, shared, n), f"query_id {plan.schema['query_id'].dataType.simpleString()}, doc_id {index.docs.schema['doc_id'].dataType.simpleString()}, bm25 double, matched string"))
        held.clear()

    language = F.col("language") if "language" in plan.columns else F.lit(None)
    for row in plan.select("query_id", language.cast("string").alias("language"), "terms").toLocalIterator():
        held.append((row.query_id, row.language, set(row.terms)))
        if len(held) == block:
            flush()
    flush()
    if not parts:
        return spark.createDataFrame([], "query_id long, doc_id long, bm25 double, matched string, lex_rank int")
    found = functools.reduce(DataFrame.unionAll, parts)
    return top(found, n, [F.desc("bm25"), F.col("doc_id")], name="lex_rank")


def _score(shared, n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, languages, queries_of, idf, mean = shared.value
    wanted = pa.array(sorted(queries_of), pa.string())
    names = wanted.to_pylist()
    for whole in batches:
        for a in range(0, whole.num_rows, 2_000):
            batch = whole.slice(a, 2_000)
            lists, tfs = (pa.concat_arrays([batch.column(i)]) for i in (3, 4))
            term = pc.fill_null(pc.index_in(lists.flatten(), wanted), -1).to_numpy()
            at = np.flatnonzero(term >= 0)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))[at]
            tf, term, length = tfs.flatten().to_numpy()[at], term[at], batch.column(2).to_numpy()[doc]
            order = np.argsort(term, kind="stable")
            scores = np.zeros((len(ids), batch.num_rows))
            begin = np.flatnonzero(np.diff(term[order], prepend=-1)) if len(order) else order
            for own in np.split(order, begin[1:]) if len(order) else ():  # the terms in their order
                t = names[term[own[0]]]
                scores[np.ix_(queries_of[t], doc[own])] += _weight(tf[own], length[own], mean, idf[t])
            if languages is not None:
                lang = np.array(batch.column(1).to_pylist(), dtype=object)
                scores *= np.stack([np.ones(len(lang), bool) if x is None else lang == x for x in languages])
            scores = _steady(scores)
            least = np.partition(scores, -n, axis=1)[:, -n, None] if scores.shape[1] > n else 0
            q, d = np.nonzero((scores > 0) & (scores >= least))
            have: dict[int, set[int]] = {}
            for i, t in zip(doc.tolist(), term.tolist()):
                have.setdefault(i, set()).add(t)
            own_terms = [{k for k, t in enumerate(names) if i in queries_of[t]} for i in range(len(ids))] if len(q) else []
            matched = [",".join(names[k] for k in sorted(own_terms[i] & have[j])) for i, j in zip(q.tolist(), d.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()], pa.int64()), batch.column(0).take(pa.array(d)), pa.array(scores[q, d]), pa.array(matched, pa.string())], ["query_id", "doc_id", "bm25", "matched"])


def pair_scores(index: Index, plan: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, doc_id, bm25 of given pairs that share a term."""
    each = pairs.join(plan.select("query_id", F.array_distinct("terms").alias("wanted")), "query_id").join(index.docs.select("doc_id", "length", "terms", "tfs"), "doc_id")
    hits = F.filter(F.arrays_zip("terms", "tfs"), lambda x: F.array_contains("wanted", x["terms"]))
    hits = each.select("query_id", "doc_id", "length", F.explode(hits).alias("x")).join(_idf(index), F.col("x.terms") == F.col("term"))
    w = _weight(F.col("x.tfs"), F.col("length"), F.col("mean_length"), F.col("idf"))
    return hits.groupBy("query_id", "doc_id").agg(steady(F.sum(w)).alias("bm25"))


def top(df: DataFrame, k: int, order: list[Column], by: str = "query_id", name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each query in a total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= k)


def embed(texts: list[str | None], width: int = WIDTH) -> np.ndarray:
    """The offline embedder: counts of words hashed into ``width`` places. A service can take its place."""
    out = np.zeros((len(texts), width))
    known: dict[str, int] = {}
    for i, text in enumerate(texts):
        for w in (text or "").split():
            if w not in known:
                known[w] = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % width
            out[i, known[w]] += 1
    return out


Embedder = Callable[[list[str | None]], np.ndarray]


def batched(call: Embedder, size: int = 64, tries: int = 3) -> Embedder:
    """An embedder that asks a service for ``size`` texts at a time, and again where a call fails."""

    def run(texts: list[str | None]) -> np.ndarray:
        parts = []
        for a in range(0, len(texts), size):
            for left in reversed(range(tries)):
                try:
                    parts.append(np.asarray(call(texts[a : a + size]), dtype=np.float64))
                    break
                except Exception:  # noqa: BLE001 - the last failure is raised
                    if not left:
                        raise
        return np.concatenate(parts) if parts else np.zeros((0, 1))

    return run


def embedded(df: DataFrame, key: str, text: Column, extra: list[str] = (), embedder: Embedder = embed) -> DataFrame:
    """key, extra columns, vector: embeddings of normalised texts, Arrow batch by batch."""
    rows = df.select(key, *extra, text.alias("__t"))
    names = [key, *extra, "vector"]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, *extra)) + ", vector array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            flat = embedder(batch.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * (flat.shape[1] if len(flat) else 0), pa.int32()), pa.array(flat.ravel()))], names)

    return rows.mapInArrow(run, schema)


def nearest(points: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, id, score, rank: the exact ``k`` best points of each query by cosine.

    ``points``: id, vector, tag; ``queries``: query_id, vector, tag. A query with a tag only takes
    points of the same tag. Queries are read in blocks of ``block``; each block is broadcast (its
    size is block x width), and every Arrow batch of points keeps its own ``k`` best a query.
    """
    parts = []
    held: list = []

    def flush() -> None:
        if held:
            ids, tags = [r.query_id for r in held], [r.tag for r in held]
            matrix = np.array([r.vector for r in held], dtype=np.float64)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            shared = points.sparkSession.sparkContext.broadcast((ids, tags, np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)))
            parts.append(points.select(F.col("id").cast("long"), F.col("vector").cast("array<double>"), F.col("tag").cast("string")).mapInArrow(lambda b, s=shared: _best(b, s, k), "query_id long, id long, score double"))
            held.clear()

    for row in queries.where("vector IS NOT NULL").select(F.col("query_id").cast("long"), "vector", F.col("tag").cast("string")).toLocalIterator():
        held.append(row)
        if len(held) == block:
            flush()
    flush()
    if not parts:
        return points.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    return top(found, k, [F.desc("score"), F.col("id")])


def _best(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    ids, tags, matrix = shared.value
    tagged = np.array([t is not None for t in tags])
    for batch in batches:
        v = batch.column(1)
        filled = np.array([x is not None and len(x) == matrix.shape[1] for x in v.to_pylist()]) if v.null_count else np.ones(len(v), bool)
        rows = np.flatnonzero(filled)
        points = np.array(v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)).reshape(len(rows), -1)
        norms = np.linalg.norm(points, axis=1, keepdims=True)
        scores = matrix @ np.divide(points, norms, out=np.zeros_like(points), where=norms > 0).T
        if tagged.any():
            own = np.array(batch.column(2).to_pylist(), dtype=object)[rows]
            scores[tagged] = np.where(own[None, :] == np.array(tags, dtype=object)[tagged, None], scores[tagged], -np.inf)
        point_ids = batch.column(0).to_numpy(zero_copy_only=False)[rows]
        # All points with the batch's k-th best score stay: ties are settled by id over all batches.
        rounded = scores = _steady(scores)
        if scores.shape[1] > k:
            least = np.partition(rounded, -k, axis=1)[:, -k, None]
            q, p = np.nonzero((rounded >= least) & np.isfinite(scores))
        else:
            q, p = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[q]), pa.array(point_ids[p]), pa.array(scores[q, p])], ["query_id", "id", "score"])


def _contained(hay: Column, groups: Column) -> Column:
    return F.size(F.filter(groups, lambda g: F.exists(g, lambda t: F.contains(hay, t))))


def fused(plan: DataFrame, docs: DataFrame, index: Index, lex: DataFrame, dense: DataFrame, top_k: int = 5, compat: bool = True) -> DataFrame:
    """query_id, doc_id, score and its parts, rank: lexical and dense candidates in one order.

    ``lex``: what ``lexical`` gives; ``dense``: query_id, doc_id, variant, rank, score. Candidates are the
    full outer join of both legs; each takes its BM25 score whether or not the lexical leg proposed it.
    Scores enter the formula as they are; the result is rounded to four places and ranked.
    """
    lex = lex.select("query_id", "doc_id", "lex_rank", F.col("bm25").alias("lex_bm25"))
    best = dense.groupBy("query_id", "doc_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("dense"), F.min(F.struct("variant", "rank")).alias("place"))
    merged = lex.join(best, ["query_id", "doc_id"], "full")
    rest = pair_scores(index, plan, merged.where("lex_rank IS NULL").select("query_id", "doc_id"))
    merged = merged.join(rest, ["query_id", "doc_id"], "left").withColumn("bm25", F.coalesce("lex_bm25", "bm25", F.lit(0.0))).na.fill(0.0, ["dense"])
    c = merged.join(docs.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")), "doc_id").join(plan.select("query_id", "groups", "terms"), "query_id")
    hay, title = tx.normalize_search(F.concat_ws(" ", "title", "text"), compat=compat), tx.normalize_search(F.col("title"), compat=compat)
    c = c.withColumns({"hay": hay, "head": title})
    c = c.withColumns({"concept_hits": _contained(F.col("hay"), F.col("groups")), "title_hits": _contained(F.col("head"), F.col("groups")), "term_hits": F.size(F.filter("terms", lambda t: F.contains(F.col("hay"), t))), "concepts": F.size("groups")})
    mismatch = F.when((F.col("concepts") >= 2) & (F.col("concept_hits") == 0), 0.10).when((F.col("concepts") >= 2) & (F.col("concept_hits") == 1), 0.04).otherwise(0.0)
    short, link = F.when(F.length("text") < 50, 0.10).otherwise(0.0), F.when(F.contains("text", F.lit("HYPERLINK")), 0.05).otherwise(0.0)
    concept = F.when(F.col("concepts") > 0, 0.14 * F.col("concept_hits") / F.greatest("concepts", F.lit(1))).otherwise(0.0)
    score = 0.56 * F.col("dense") + 0.28 * F.col("bm25") / (F.col("bm25") + 4.0) + concept + F.least(F.lit(0.08), 0.03 * F.col("title_hits")) + F.least(F.lit(0.04), 0.01 * F.col("term_hits")) - short - link - mismatch
    c = c.withColumn("score", tx.round4(score)).select("query_id", "doc_id", "title", "text", "score", "dense", "bm25", "concept_hits", "concepts", "title_hits", "term_hits", "lex_rank", "place")
    return top(c, top_k, [F.desc("score"), F.col("lex_rank").asc_nulls_last(), F.col("place").asc_nulls_last(), F.col("doc_id")])


def search(docs: DataFrame, queries: DataFrame, top_k: int = 5, mode: str = "balanced", filter_lexical: bool = False, dense_limit: int = 12, compat: bool = True, index: Index | None = None, embedder: Embedder = embed) -> DataFrame:
    """Ranked documents of each query. ``mode`` fast leaves the dense leg out.

    docs: doc_id, title, text, lang; queries: query_id, query, language. The language narrows the
    dense leg only, unless ``filter_lexical``. Without an ``index`` one is built for this search.
    """
    plan = plan_queries(queries, compat=compat)
    index = index or build_index(docs, f"{shared_folder(docs.sparkSession)}/lexical-{uuid.uuid4().hex}", compat)
    # The candidates are few, and read twice; written once, they are not computed again.
    lex = stage(lexical(index, plan, top_k, filter_lexical), "lexical")
    if mode == "fast":
        dense = docs.sparkSession.createDataFrame([], "query_id long, doc_id long, variant int, rank int, score double")
    else:
        points = embedded(docs.withColumn("tag", F.col("lang")), "doc_id", tx.normalize_search(F.concat_ws(" ", "title", "text"), compat=compat), ["tag"], embedder).withColumnRenamed("doc_id", "id")
        each = plan.select("query_id", F.col("language").alias("tag"), F.posexplode("variants").alias("variant", "v")).withColumn("vid", F.col("query_id") * 2 + F.col("variant"))
        vectors = embedded(each, "vid", tx.normalize_search(F.col("v"), compat=compat), ["tag"], embedder).withColumnRenamed("vid", "query_id")
        near = nearest(points, vectors, dense_limit)
        dense = near.select(F.expr("query_id div 2").alias("query_id"), F.col("id").alias("doc_id"), F.expr("cast(query_id % 2 as int)").alias("variant"), "rank", "score")
        dense = stage(dense, "dense")
    return fused(plan, docs, index, lex, dense, top_k, compat)


def relevant(results: DataFrame, queries: DataFrame) -> DataFrame:
    """The results with whether each answers its query: an expected title, else all required words."""
    r = results.join(queries.select("query_id", "must_have", "expected_titles"), "query_id")
    title, text = tx.normalize_eval(F.coalesce("title", F.lit(""))), tx.normalize_eval(F.concat_ws(" ", "title", "text"))
    r = r.withColumns({"__title": title, "__text": text})
    expected = F.exists(F.filter(F.coalesce("expected_titles", F.array().cast("array<string>")), lambda t: tx.normalize_eval(t) != ""), lambda t: F.contains(F.col("__title"), tx.normalize_eval(t)))
    needed = F.filter(F.coalesce("must_have", F.array().cast("array<string>")), lambda t: tx.normalize_eval(t) != "")
    have = F.filter(needed, lambda t: F.contains(F.col("__text"), tx.normalize_eval(t)))
    coverage = F.when(F.size(needed) > 0, F.size(have) / F.size(needed)).otherwise(0.0)
    return r.withColumns({"relevant": expected | ((F.size(needed) > 0) & (F.size(have) == F.size(needed))), "coverage": coverage}).drop("__title", "__text", "must_have", "expected_titles")


def metrics(judged: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: queries, hit rates at 1, 3, 5 and 10, MRR at 10, mean coverage of the first, failures."""
    per = judged.groupBy("query_id").agg(F.min(F.when(F.col("relevant") & (F.col("rank") <= 10), F.col("rank"))).alias("first"), F.max(F.when(F.col("rank") == 1, F.col("coverage"))).alias("coverage"))
    q = queries.select("query_id").join(per, "query_id", "left")
    hit = lambda k: tx.round4(F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")))
    return q.agg(F.count("*").alias("queries"), *[hit(k).alias(f"recall_{k}") for k in (1, 3, 5, 10)], tx.round4(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0)))).alias("mrr_10"), tx.round4(F.avg(F.coalesce("coverage", F.lit(0.0)))).alias("coverage"), F.count_if(F.col("first").isNull()).alias("failed"))


def failures(judged: DataFrame) -> DataFrame:
    """query_id, best (the first ten documents) of each query without a relevant result in ten."""
    per = judged.where("rank <= 10").groupBy("query_id").agg(F.bool_or("relevant").alias("ok"), F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("best"))
    return per.where("NOT ok").select("query_id", F.array_join(F.transform("best", lambda x: x["doc_id"].cast("string")), ",").alias("best"))


def page_label(first: Column, last: Column) -> Column:
    """The pages of a passage: one number, or a range; ``?`` where they are not known."""
    text = lambda c, d: F.coalesce(c.cast("string"), F.lit(d))
    return F.when(first.eqNullSafe(last), text(first, "?")).otherwise(F.concat(text(first, "?"), F.lit("–"), text(last, "")))


def answer_context(results: DataFrame) -> DataFrame:
    """query_id, context, listing: the passages of a prompt under their sources, and as a list, in rank order.

    ``results``: query_id, rank, title, text, page_start, page_end (pages may be missing).
    """
    own = [F.col(c) if c in results.columns else F.lit(None).cast("int") for c in ("page_start", "page_end")]
    pages, title = page_label(*own), F.coalesce("title", F.lit("?"))
    block = F.concat(F.lit("[Buku: "), title, F.lit(", Halaman "), pages, F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    item = F.concat(F.lit("["), title, F.lit(", hlm. "), pages, F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n---"))
    per = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b"), item.alias("l")))).alias("x"))
    return per.select("query_id", F.array_join(F.transform("x", lambda i: i["b"]), "\n").alias("context"), F.array_join(F.transform("x", lambda i: i["l"]), "\n").alias("listing"))


#: Words in a question that ask for the large model.
LARGE = (
    "hukum", "wajib", "sunnah", "haram", "makruh", "mubah", "bid'ah", "sah", "batal", "dalil", "hadis", "ayat", "khilaf", "akidah", "tauhid", "syirik", "kafir", "shalat", "puasa", "zakat",
    "haji", "wudhu", "nikah",
)


def route(query: Column, mode: str = "auto", strict: bool = True) -> Column:
    """The model that answers: as the mode says, else by the words of the question."""
    if mode != "auto":
        return F.lit(mode)
    large = F.exists(F.array(*[F.lit(w) for w in LARGE]), lambda w: F.contains(F.lower(query), w))
    return F.when(F.lit(strict) & large, "large").otherwise("local")
