"""The parser runs on every document, whatever its text looks like."""

from leafmill.plans import reference_queries


def test_every_document(spark, tmp_path):
    texts = {1: "<p>satu</p><p>dua</p>", 2: "a &amp; b", 3: "x<!-- hidden -->y", 4: "plain\n\ntext\fnext 1 < 2", 5: "", 6: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = reference_queries.html_to_pages(spark, str(tmp_path)).orderBy("doc_id", "page_num").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "satu\ndua"), (2, 1, "a & b"), (3, 1, "x\ny"), (4, 1, "plain\n\ntext"), (4, 2, "next 1 < 2")]
