"""Queries of retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import retrieval as r
from leafmill.plans import sql
from leafmill.tables import load


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", "title", "text", "lang")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query", "language", "must_have", "expected_titles")


def _index(spark: SparkSession, d: str) -> r.Index:
    """The index of the documents in the shared folder, built when the table is new."""
    return r.kept_index(_docs(spark, d), f"{d}/documents.parquet", compat=False)


def postings(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index of all documents, aggregated by term."""
    return r.postings(_docs(spark, d), compat=False).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def query_expansion_terms(spark: SparkSession, d: str) -> DataFrame:
    """Keywords, groups, terms and variants of every query."""
    p = r.plan_queries(_items(spark, d), compat=False)
    return p.select("query_id", F.array_join("keywords", ",").alias("keywords"), F.size("groups").alias("groups"), F.array_join(F.array_sort("terms"), ",").alias("terms"), F.size("variants").alias("variants"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The lexical candidates of every query."""
    found = r.lexical(_index(spark, d), r.plan_queries(_items(spark, d), compat=False))
    return found.select("query_id", "doc_id", tx.round4(F.col("bm25")).alias("bm25"), "matched", "lex_rank")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The twelve nearest vectors of each vector whose id is divisible by 50, against all rows."""
    v = _vectors(spark, d)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", F.lit(None).cast("string").alias("tag"))
    return r.nearest(v.withColumn("tag", F.lit(None).cast("string")), q, 12).withColumn("score", tx.round4(F.col("score")))


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same among vectors of the query's own label."""
    v = _vectors(spark, d).withColumn("tag", F.col("label").cast("string"))
    return r.nearest(v, v.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 12).withColumn("score", tx.round4(F.col("score")))


def _search(spark: SparkSession, d: str, k: int, mode: str = "balanced") -> DataFrame:
    return r.search(_docs(spark, d), _items(spark, d), k, mode, compat=False, index=_index(spark, d))


def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    """The parts of the score of the first ten documents of each query."""
    return _search(spark, d, 10).select("query_id", "doc_id", tx.round4(F.col("dense")).alias("dense"), tx.round4(F.col("bm25")).alias("bm25"), "concept_hits", "concepts", "title_hits", "term_hits")


def hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The five best documents of each query."""
    return _search(spark, d, 5).select("query_id", "doc_id", "score", "rank")


def fast_search(spark: SparkSession, d: str) -> DataFrame:
    """The same without the dense leg."""
    return _search(spark, d, 5, "fast").select("query_id", "doc_id", "score", "rank")


def eval_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Whether each of the ten best answers its query."""
    return r.relevant(_search(spark, d, 10), _items(spark, d)).select("query_id", "doc_id", "rank", "relevant", F.floor(F.col("coverage") * 10000.0 + 0.5).cast("int").alias("coverage"))


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall, MRR and coverage of the search."""
    items = _items(spark, d)
    return r.metrics(r.relevant(_search(spark, d, 10), items), items)


def eval_failures(spark: SparkSession, d: str) -> DataFrame:
    """The best documents of queries without a relevant one."""
    return r.failures(r.relevant(_search(spark, d, 10), _items(spark, d)))


def context_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Passages under their sources for each query, the documents' rank standing for a page."""
    found = _search(spark, d, 5).select("query_id", "rank", "title", "text", F.col("rank").alias("page_start"), F.when(F.col("rank") % 2 == 0, F.col("rank") + 1).otherwise(F.col("rank")).alias("page_end"))
    return r.answer_context(found)


def model_route(spark: SparkSession, d: str) -> DataFrame:
    """The model that each query goes to."""
    return load(spark, d, "eval_items").select("item_id", r.route(F.col("query")).alias("model"))


QUERIES = {f.__name__: f for f in (postings, query_expansion_terms, bm25_topk, dense_topk, dense_topk_filtered, hybrid_merge, hybrid_rerank, fast_search, eval_relevance, eval_metrics, eval_failures, context_prompt, model_route)}

_STOP = ", ".join(f"'{w}'" for w in r.STOPWORDS)
_MAP = "CASE w " + " ".join("WHEN '{}' THEN [{}]".format(k.replace("'", "''"), ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(v))) for k, v in r.EXPANSIONS.items()) + " ELSE [w] END"
_TOK = "'[A-Za-z0-9\\x{600}-\\x{6ff}'']+'"
_BODY = "coalesce(title, '') || ' ' || coalesce(text, '')"
_N = lambda x: sql.normalize_search(x)
_PLAN = f"""k AS (SELECT item_id AS query_id, query, language, list_filter(regexp_extract_all({_N("coalesce(query, '')")}, {_TOK}), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})) AS keywords FROM eval_items),
    g AS (SELECT *, list_transform(keywords, lambda w: {_MAP}) AS gs FROM k),
    plan AS (SELECT *, list_distinct(gs) AS groups, CASE WHEN len(gs) > 0 THEN list_distinct(flatten(gs)) ELSE [query] END AS terms FROM g)"""
_STEADY = lambda x: f"(floor(({x}) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE)"
_BM25 = f"""{_PLAN}, t AS (SELECT doc_id, list_filter(regexp_extract_all({_N("coalesce(title, '') || ' ' || coalesce(text, '')")}, {_TOK}), lambda w: length(w) >= 2) AS toks FROM documents),
    dl AS (SELECT doc_id, len(toks) AS dl, toks FROM t WHERE len(toks) > 0), tot AS (SELECT count(*) AS n, avg(dl) AS m FROM dl),
    tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, dl, unnest(toks) AS term FROM dl) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    w AS (SELECT tf.term, doc_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / greatest(tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / m), 1e-9) AS w FROM tf JOIN df USING (term), tot),
    qt AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM plan),
    bm AS (SELECT query_id, doc_id, {_STEADY('sum(w)')} AS bm25, string_agg(DISTINCT term, ',' ORDER BY term) AS matched FROM qt JOIN w USING (term) GROUP BY 1, 2),
    lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS lex_rank FROM bm QUALIFY lex_rank <= 80)"""
_EMBED = lambda x: f"list_transform(range(64), lambda i: len(list_filter(string_split({x}, ' '), lambda w: w <> '' AND ('0x' || substr(md5(w), 1, 4))::INT % 64 = i))::DOUBLE)"
_DENSE = f""", dv AS (SELECT doc_id, lang, {_EMBED(_N("concat_ws(' ', title, text)"))} AS v FROM documents),
    ev AS (SELECT query_id, language, variant, {_EMBED(_N("q"))} AS v FROM (SELECT query_id, language, 0 AS variant, query AS q FROM plan UNION ALL SELECT query_id, language, 1, concat_ws(' ', query, array_to_string((SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(flatten(gs)) AS x, generate_subscripts(flatten(gs), 1) AS i) GROUP BY 1)), ' ')) FROM plan WHERE len(gs) > 0)),
    dn AS (SELECT query_id, variant, doc_id, {_STEADY("coalesce(CASE WHEN list_sum(dv.v) > 0 AND list_sum(ev.v) > 0 THEN list_cosine_similarity(dv.v, ev.v) ELSE 0 END, 0)")} AS s FROM dv JOIN ev ON ev.language IS NULL OR dv.lang = ev.language),
    dr AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY s DESC, doc_id) AS rk FROM dn QUALIFY rk <= 12),
    db AS (SELECT query_id, doc_id, greatest(max(s), 0) AS dense, min(variant * 1000 + rk) AS place FROM dr GROUP BY 1, 2)"""
_NONE = ", db AS (SELECT query_id, doc_id, 0::DOUBLE AS dense, 0 AS place FROM lex WHERE false)"
_FUSED = f""", mg AS (SELECT query_id, doc_id, lex_rank, dense, place FROM lex FULL JOIN db USING (query_id, doc_id)),
    cd AS (SELECT mg.query_id, mg.doc_id, lex_rank, place, coalesce(dense, 0) AS dense, coalesce(bm.bm25, 0) AS bm25, coalesce(title, '') AS title, coalesce(text, '') AS text, groups, terms, {_N("concat_ws(' ', coalesce(title, ''), coalesce(text, ''))")} AS hay, {_N("coalesce(title, '')")} AS head
        FROM mg LEFT JOIN bm ON bm.query_id = mg.query_id AND bm.doc_id = mg.doc_id JOIN documents d ON d.doc_id = mg.doc_id JOIN plan ON plan.query_id = mg.query_id),
    sc AS (SELECT *, len(list_filter(groups, lambda g: len(list_filter(g, lambda t: contains(hay, t))) > 0))::INT AS concept_hits, len(list_filter(groups, lambda g: len(list_filter(g, lambda t: contains(head, t))) > 0))::INT AS title_hits, len(list_filter(terms, lambda t: contains(hay, t)))::INT AS term_hits, len(groups)::INT AS concepts FROM cd),
    fs AS (SELECT *, {sql.round4("0.56::DOUBLE * dense + 0.28::DOUBLE * bm25 / (bm25 + 4.0::DOUBLE) + CASE WHEN concepts > 0 THEN 0.14::DOUBLE * concept_hits / greatest(concepts, 1) ELSE 0 END + least(0.08::DOUBLE, 0.03::DOUBLE * title_hits) + least(0.04::DOUBLE, 0.01::DOUBLE * term_hits) - CASE WHEN length(text) < 50 THEN 0.10::DOUBLE ELSE 0 END - CASE WHEN contains(text, 'HYPERLINK') THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN concepts >= 2 AND concept_hits = 0 THEN 0.10::DOUBLE WHEN concepts >= 2 AND concept_hits = 1 THEN 0.04::DOUBLE ELSE 0 END")} AS score FROM sc),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lex_rank NULLS LAST, place NULLS LAST, doc_id)::INT AS rank FROM fs QUALIFY rank <= 10)"""
_JUDGED = f""", jd AS (SELECT rk.query_id, rk.doc_id, rank, list_filter(coalesce(expected_titles, []), lambda t: {sql.collapse(sql.low('t'))} <> '') AS ex, list_filter(coalesce(must_have, []), lambda t: {sql.collapse(sql.low('t'))} <> '') AS mh, {sql.collapse(sql.low('title'))} AS nt, {sql.collapse(sql.low("concat_ws(' ', title, text)"))} AS nx FROM rk JOIN eval_items ON item_id = query_id),
    jr AS (SELECT *, len(list_filter(mh, lambda t: contains(nx, {sql.collapse(sql.low('t'))}))) AS hv FROM jd),
    rel AS (SELECT *, len(list_filter(ex, lambda t: contains(nt, {sql.collapse(sql.low('t'))}))) > 0 OR (len(mh) > 0 AND hv = len(mh)) AS relevant, CASE WHEN len(mh) > 0 THEN hv / len(mh) ELSE 0 END AS coverage FROM jr)"""
_KNN = lambda where: f"""SELECT query_id, id, {sql.round4('score')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS id, {_STEADY("list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])")} AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0{where}) QUALIFY rank <= 12"""  # noqa: E731
ORACLES = {
    "postings": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(regexp_extract_all({_N(_BODY)}, {_TOK})) AS term FROM documents) WHERE length(term) >= 2 GROUP BY 1",
    "query_expansion_terms": f"WITH {_PLAN} SELECT query_id, array_to_string(keywords, ',') AS keywords, len(groups)::INT AS groups, array_to_string(list_sort(terms), ',') AS terms, CASE WHEN len(gs) > 0 THEN 2 ELSE 1 END AS variants FROM plan",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, doc_id, {sql.round4('bm25')} AS bm25, matched, lex_rank::INT AS lex_rank FROM lex",
    "dense_topk": _KNN(""),
    "dense_topk_filtered": _KNN(" AND q.label = e.label"),
    "hybrid_merge": f"WITH {_BM25}{_DENSE}{_FUSED} SELECT query_id, doc_id, {sql.round4('dense')} AS dense, {sql.round4('bm25')} AS bm25, concept_hits, concepts, title_hits, term_hits FROM rk",
    "hybrid_rerank": f"WITH {_BM25}{_DENSE}{_FUSED} SELECT query_id, doc_id, score, rank FROM rk WHERE rank <= 5",
    "fast_search": f"WITH {_BM25}{_NONE}{_FUSED} SELECT query_id, doc_id, score, rank FROM rk WHERE rank <= 5",
    "eval_relevance": f"WITH {_BM25}{_DENSE}{_FUSED}{_JUDGED} SELECT query_id, doc_id, rank, relevant, floor(coverage * 10000 + 0.5)::INT AS coverage FROM rel",
    "eval_metrics": f"""WITH {_BM25}{_DENSE}{_FUSED}{_JUDGED}, per AS (SELECT query_id, min(CASE WHEN relevant THEN rank END) AS f, max(CASE WHEN rank = 1 THEN coverage END) AS c FROM rel GROUP BY 1), q AS (SELECT item_id, f, c FROM eval_items LEFT JOIN per ON query_id = item_id)
        SELECT count(*) AS queries, {", ".join(f"{sql.round4(f'avg(coalesce(f <= {k}, false)::INT::DOUBLE)')} AS recall_{k}" for k in (1, 3, 5, 10))}, {sql.round4("avg(coalesce(1.0::DOUBLE / f, 0))")} AS mrr_10, {sql.round4("avg(coalesce(c, 0)::DOUBLE)")} AS coverage, count_if(f IS NULL) AS failed FROM q""",
    "eval_failures": f"WITH {_BM25}{_DENSE}{_FUSED}{_JUDGED} SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS best FROM rel GROUP BY 1 HAVING NOT bool_or(relevant)",
    "context_prompt": f"WITH {_BM25}{_DENSE}{_FUSED}, l AS (SELECT *, rank::VARCHAR || CASE WHEN rank % 2 = 0 THEN '–' || (rank + 1)::VARCHAR ELSE '' END AS pages FROM rk WHERE rank <= 5) SELECT query_id, string_agg('[Buku: ' || title || ', Halaman ' || pages || ']' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS context, string_agg('[' || title || ', hlm. ' || pages || ']' || chr(10) || text || chr(10) || '---', chr(10) ORDER BY rank) AS listing FROM l GROUP BY 1",
    "model_route": "SELECT item_id, CASE WHEN " + " OR ".join("contains(lower(query), '{}')".format(w.replace("'", "''")) for w in r.LARGE) + " THEN 'large' ELSE 'local' END AS model FROM eval_items",
}
