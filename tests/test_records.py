"""Paths, states, names and embedders on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import dedupe, records, references, retrieval


def test_paths(spark):
    rows = [("json_output/a//./b.json", "f"), ("/abs/../x", "f"), ("", "f"), (None, None), ("json_output", "f"), ("x/../../y", "f"), ("json_output/../z", "f"), (".", "f")]
    got = [r.p for r in spark.createDataFrame(rows, "path string, name string").select(records.json_path(F.col("path"), F.col("name"), "/r").alias("p")).collect()]
    assert got == ["/r/a/b.json", "/abs/../x", "/r/f.json", "/r/.json", "/r", "/r/../y", "/r/z", "/r/."]
    r = spark.createDataFrame([("1", "/a", "r", "x", "n"), ("2", "/no", "r", "x", "n"), ("3", None, "", "x", "n"), ("4", " ", None, None, "n"), ("5", None, None, None, None)], "book_id string, source_path string, source_root string, source_relpath string, filename string")
    files = spark.createDataFrame([("/a",), ("r/x",), ("n",), ("n",)], "path string")
    assert {x.book_id: x.path for x in records.source_files(r, files).collect()} == {"1": "/a", "2": "r/x", "3": "n", "4": "n", "5": None}


def test_states(spark):
    raw = ['{"a": {"source_hash": "h", "complete": true}, "b": 3}', '{"books": {"c": {"next_batch_index": 4}}, "chunks": {"k": {"ref_count": 2}, "l": {"point_id": "p"}}}', "{", "[]", None, '{"chunks": {}}']
    books, chunks = records.states(spark.createDataFrame([(x,) for x in raw], "state string"))
    assert {r.book_id: (r.source_hash, r.next_batch_index, r.complete, r.point_count) for r in books.collect()} == {"a": ("h", 0, True, 0), "c": ("", 4, False, 0)}
    got = {r.chunk_hash: (r.point_id, r.ref_count) for r in chunks.collect()}
    assert got["l"] == ("p", 0) and got["k"][1] == 2 and len(got["k"][0]) == 36


def test_names_and_keys(spark):
    known = spark.createDataFrame([("bukhari",), ("nawawi_40",), ("lain",)], "collection string")
    marks = spark.createDataFrame([(i, n) for i, n in enumerate(["Sahih al-Bukhari", "nawawi40", "Nawawi 40", "LAIN", "baru sekali"])], "i int, name string")
    assert [r.coll for r in references.with_collection(marks, "name", known).orderBy("i").collect()] == ["bukhari", "nawawi_40", "nawawi_40", "lain", "baru_sekali"]
    hadith = spark.createDataFrame([("lain", "1", "lain_7", "A", None, None), ("lain", "12", "x", "B", None, None), ("lain", "3", "lain-9", "C", None, None)], "collection string, number string, key string, arabic string, translation_id string, translation_en string")
    none = spark.createDataFrame([], "key string, arabic string, translation_id string, translation_en string")
    texts = spark.createDataFrame([(1, "[[HADITH lain:7]] [[HADITH lain:012]] [[HADITH lain:9]] [[HADITH lain:x]] [[HADITH lain:99]]")], "doc_id long, text string")
    out, rest = references.resolve(texts, none, hadith, spark.createDataFrame([], "block_id string, text string"))
    assert out.first().text == "A B C B [[HADITH lain:99]]" and rest.count() == 1


def test_promotions_and_points(spark):
    rows = [(1, "b", "Page", "page_reviewed", 2, "", "", 1, True), (2, "b", "page", "page_pending", 3, "x", "why", 2, True), (3, "b", "page", "page_reviewed", 9, "y", "", 3, False), (4, "c", "book", "approved", None, "", "", 4, True)]
    a = spark.createDataFrame(rows, "id long, book_id string, scope string, action string, page_num int, reviewed_by string, note string, created_at int, promote boolean")
    assert [tuple(r) for r in records.promotions(a, F.col("promote")).collect()] == [("b", 3, "approved_manual", False, "x", "x", "why")]
    p = spark.createDataFrame([("h", "12"), ("h", "a"), ("h", "b"), ("g", "7"), ("g", "3"), (None, "z")], "chunk_hash string, point_id string")
    assert {r.chunk_hash: (r.point_id, r.points) for r in dedupe.stored_points(p).collect()} == {"h": ("a", 3), "g": ("3", 2)}


def test_embedder_is_called_in_batches_and_again():
    calls = []

    def service(texts):
        calls.append(len(texts))
        if len(calls) == 2:
            raise OSError("gone")
        return [[len(t), 1] for t in texts]

    assert np.array_equal(retrieval.batched(service, 2)(["a", "bb", "ccc"]), [[1, 1], [2, 1], [3, 1]]) and calls == [2, 1, 1]
    with pytest.raises(OSError):
        retrieval.batched(lambda t: (_ for _ in ()).throw(OSError("down")), 2, 2)(["a"])


def test_index_is_kept(spark, tmp_path):
    docs = [(1, "Hukum", "salat salat wudhu", "id"), (2, None, "zakat dan salat", "en"), (3, None, None, None)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(docs, "doc_id long, title string, text string, lang string").write.parquet(path)
    frame = spark.read.parquet(path)
    index = retrieval.kept_index(frame, path)
    assert {r.doc_id: dict(zip(r.terms, r.tfs)) for r in index.docs.collect()} == {1: {"hukum": 1, "salat": 2, "wudhu": 1}, 2: {"zakat": 1, "dan": 1, "salat": 1}}
    assert retrieval.kept_index(frame, path).docs.inputFiles() == index.docs.inputFiles()
    plan = retrieval.plan_queries(spark.createDataFrame([(1, "salat", "en"), (2, "tiada", None)], "query_id long, query string, language string"))
    for block in (1, 10):
        assert [(r.query_id, r.doc_id, r.lex_rank) for r in retrieval.lexical(index, plan, block=block).orderBy("lex_rank").collect()] == [(1, 1, 1), (1, 2, 2)]
    assert [r.doc_id for r in retrieval.lexical(index, plan, by_language=True).collect()] == [2]
    pairs = retrieval.pair_scores(index, plan, spark.createDataFrame([(1, 2), (2, 1)], "query_id long, doc_id long")).collect()
    assert [(r.query_id, r.doc_id) for r in pairs] == [(1, 2)]
    assert pairs[0].bm25 == retrieval.lexical(index, plan).where("doc_id = 2").first().bm25
