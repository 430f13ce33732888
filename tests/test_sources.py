"""Readers and writers on files made here, and the intake stream."""

import datetime as dt
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.sources import readers, sinks
from leafmill.streaming import intake


def make(folder):
    (folder / "ar").mkdir()
    (folder / "a.txt").write_bytes("satu\f\f dua \xff".encode("latin-1"))
    (folder / "blank.txt").write_text("             ")
    (folder / "ar" / "b.html").write_text("<html><head><style>p{}</style></head><body><p>Halo &amp; apa</p><script>x</script><noscript>n</noscript>kabar</body></html>")
    (folder / ".~lock.a.txt").write_text("x")
    (folder / "notes.md").write_text("x")
    with zipfile.ZipFile(folder / "c.epub", "w") as z:
        z.writestr("2.xhtml", "<p>kedua</p>")
        z.writestr("1.html", "<p>pertama</p>")
        z.writestr("x.css", "no")
        z.writestr("3.htm", "<p> </p>")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(folder / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:r><w:t>satu</w:t><w:br w:type="page"/><w:t>dua</w:t></w:r></w:p><w:p><w:r><w:t>tiga</w:t></w:r></w:p></w:body></w:document>')
    (folder / "bad.docx").write_bytes(b"no archive")
    (folder / "p.pdf").write_bytes(b"%PDF")


def test_scan_and_extract(spark, tmp_path):
    make(tmp_path)
    files = readers.scan_files(spark, str(tmp_path))
    assert [r.relpath for r in files.orderBy("length", "ext", "path").collect()][:2] == ["p.pdf", "bad.docx"] and files.count() == 7
    full = readers.with_contents(spark, str(tmp_path))
    got = {r.relpath: r for r in readers.extract(full, {".pdf": ("pdf", lambda data: [f"{len(data)} bytes"])}).collect()}
    assert got["a.txt"].pages == ["satu", "dua �"] and got["blank.txt"].pages == [""]
    assert got["ar/b.html"].pages == ["Halo & apa\nkabar"] and got["c.epub"].pages == ["pertama", "kedua"]
    assert got["d.docx"].pages == ["satu", "dua\ntiga"] and got["bad.docx"].problem.startswith("BadZipFile") and got["p.pdf"].pages == ["4 bytes"]
    assert len(got["a.txt"].source_hash) == 64
    assert {r.path.rsplit("/", 1)[1] for r in readers.list_flat(spark, str(tmp_path)).collect()} >= {"a.txt", "c.epub"}
    pages = readers.numbered_pages(readers.extract(full).where("relpath = 'c.epub'"), "relpath").collect()
    assert [(r.page_num, r.content) for r in pages] == [(1, "pertama"), (2, "kedua")]


def test_json_and_logs(spark, tmp_path):
    b = tmp_path / "books"
    b.mkdir()
    (b / "1.json").write_text(json.dumps({"book_id": "x", "text_simhash": 2**64 - 1, "extra": 1, "pages": [{"page": 1, "content": "a"}, {"page": 2, "content": None}]}))
    (b / "2.json").write_text("{broken")
    (b / "3.json").write_text(json.dumps({"book_id": "old"}))
    books = readers.read_books(spark, str(b))
    assert {r.book_id for r in books.collect()} == {"x", "old", None}
    assert [(r.page_num, r.content) for r in readers.book_pages(books).collect()] == [(1, "a"), (2, "")]
    q = tmp_path / "q"
    q.mkdir()
    (q / "s.jsonl").write_text('# note\n\n{"query": "apa", "must_have": ["x"], "expected_titles": []}\nbroken\n{"query": "b", "language": "en"}\n')
    got = sorted((r.query, r.language, r.source_file) for r in readers.read_queries(spark, str(q)).collect())
    assert got == [("apa", "id", "s.jsonl"), ("b", "en", "s.jsonl")]
    (tmp_path / "w.tsv").write_text("level\tblock_num\tconf\ttext\n5\t1\t9.5\tkata\n5\t2\n")
    words = readers.read_words(spark, str(tmp_path / "w.tsv"))
    assert words.where("text IS NOT NULL").first().conf == 9.5
    n = tmp_path / "n" / "db"
    n.mkdir(parents=True)
    (n / "x.json").write_text(json.dumps({"a": [{"id": 1, "chapterId": 2, "bookId": 3, "arabic": "م"}, {"id": 2}], "b": {"c": {"id": 5, "chapterId": 2, "bookId": 3, "arabic": ""}}}))
    (n / "bad.json").write_text("[")
    assert sorted(json.loads(r.item)["id"] for r in readers.nested_items(spark, str(tmp_path / "n")).collect()) == [1, 5]
    assert readers.table_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    assert spark.createDataFrame([("cb({\"a\":1});",)], "v string").select(readers.jsonp(F.col("v")).alias("j")).first().j == '{"a":1}'


def test_inventory(spark):
    paths = spark.createDataFrame([(1, "/x/a"), (2, "/y/b"), (3, "/x/c")], "file_id int, full_path string")
    files = spark.createDataFrame([(1, "h", "done", 3), (2, "h", "done", 3), (3, None, "done", 1)], "id int, content_hash string, hash_status string, size_bytes int")
    assert [tuple(r) for r in readers.inventory(paths, files, "/x/").collect()] == [("/x/a", "h", 3)]


def test_writers(spark, tmp_path):
    books = spark.createDataFrame([("a", "r", "id", "empty", 0, 0), ("b", "r", "en", "book", 1, 10), ("c", "s", "id", "book", 9, 99999)], "book_id string, source_root string, language string, document_type string, total_pages int, size_bytes long")
    sinks.write_books(books, str(tmp_path / "books"))
    assert spark.read.json(str(tmp_path / "books")).where("language = 'id'").count() == 2
    sinks.write_routed(books, str(tmp_path / "routed"))
    assert {(r.book_id, r.route) for r in spark.read.json(str(tmp_path / "routed")).collect()} == {("a", "_empty"), ("b", "_covers"), ("c", "main")}
    for i in (1, 2):
        sinks.append_log(spark.createDataFrame([(i,)], "n int"), str(tmp_path / "log"))
        sinks.write_version(spark.createDataFrame([(i,)], "n int"), str(tmp_path / "v"), f"{i:04}")
    assert readers.read_log(spark, str(tmp_path / "log"), "n int").count() == 2
    assert sinks.newest_version(spark, str(tmp_path / "v")).endswith("version=0002") and sinks.newest_version(spark, str(tmp_path / "no")) is None
    df = spark.createDataFrame([("a\nb", "a\nc"), (None, None)], "o string, n string").select(sinks.unified_diff("o", "n").alias("d"))
    assert [r.d for r in df.collect()][0].splitlines()[-2:] == ["-b", "+c"]


def test_intake_stream(spark, tmp_path):
    schema = "book_id string, page_num int, content string, updated_at timestamp_ntz"
    row = lambda b, text: (b, 1, text * 4, dt.datetime(2024, 1, 1))
    path, out, check = str(tmp_path / "pages"), str(tmp_path / "out"), str(tmp_path / "check")
    spark.createDataFrame([row("a", "Isi halaman pertama yang panjang. "), row("b", "Isi halaman kedua yang panjang. ")], schema).coalesce(1).write.parquet(path)
    intake.start(spark, path, spark.read.parquet(path).schema, out, check).awaitTermination()
    spark.createDataFrame([row("a", "Isi halaman pertama yang diubah. ")], schema).coalesce(1).write.mode("append").parquet(path)
    intake.start(spark, path, spark.read.parquet(path).schema, out, check).awaitTermination()
    intake.start(spark, path, spark.read.parquet(path).schema, out, check).awaitTermination()
    got = {r.book_id: r.text[:26] for r in intake.taken_in(spark, out).collect()}
    assert got == {"a": "Isi halaman pertama yang d", "b": "Isi halaman kedua yang pan"}
    # The rest of a book's pages comes in another batch: the book keeps what it had.
    more = [("b", n, f"Halaman {n} yang menyusul kemudian. " * 4, dt.datetime(2024, 1, 1)) for n in (2, 3)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(path)
    intake.start(spark, path, spark.read.parquet(path).schema, out, check).awaitTermination()
    assert sorted((r.book_id, r.page_start) for r in intake.taken_in(spark, out).collect()) == [("a", 1), ("b", 1), ("b", 2), ("b", 3)]


def test_import_folder(spark, tmp_path):
    from leafmill.plans.importing import import_folder

    make(tmp_path)
    text = "Buku ini dibaca oleh para murid setiap pagi dengan tenang dan sabar. "
    (tmp_path / "id_satu.txt").write_text(text * 2)
    (tmp_path / "salinan.txt").write_text(text * 2)
    (tmp_path / "mirip.txt").write_text("  " + (text * 2).upper())
    (tmp_path / "lama.txt").write_text(text + "tambahan lain di akhir halaman")
    seen = spark.createDataFrame([("0" * 64,)], "source_hash string")
    out = import_folder(spark, str(tmp_path), "rak", seen)
    books = {r.book_id: r for r in out["books"].collect()}
    kinds = {r.book_id: r.kind for r in out["skipped"].collect()}
    assert books["rak__lama.txt"].review_status == "approved_auto" and books["rak__a.txt"].review_status == "pending_review"
    assert kinds["rak__bad.docx"] == kinds["rak__p.pdf"] == "problem" and kinds["rak__blank.txt"] == "empty_after_extraction"
    assert sorted(kinds[f"rak__{n}.txt"] for n in ("id_satu", "salinan", "mirip") if f"rak__{n}.txt" in kinds) == ["content_family_skip", "source_hash_skip"]
    assert books["rak__ar_b.html"].language == "ar" and not set(books) & set(kinds)
    assert {r.book_id for r in out["pages"].collect()} == set(books)
    again = import_folder(spark, str(tmp_path), "rak", spark.createDataFrame([(r.source_hash,) for r in books.values()], "source_hash string"), out["books"].select("book_id", "content_hash", "text_hash"))
    assert again["books"].count() == 0


def test_previews_and_collections(spark, tmp_path):
    files = [("/x/a.bin", "html", b"<p>satu</p><p> </p>"), ("/x/b.TXT", None, b"dua\x0ctiga"), ("/x/c.zzz", " ", b" empat "), ("/x/d.docx", "docx", b"broken")]
    got = {r.path[-5:]: list(r.pages) for r in readers.preview(spark.createDataFrame(files, "path string, source_type string, content binary")).collect()}
    assert got == {"a.bin": ["satu"], "b.TXT": ["dua", "tiga"], "c.zzz": ["empat"], "/d.docx"[-5:]: []}
    pick = readers.longest(lambda b: ["x"], lambda b: 1 / 0, lambda b: ["satu", "dua"])
    assert pick(b"") == ["satu", "dua"] and readers.longest(lambda b: 1 / 0)(b"") == []
    (tmp_path / "by_book").mkdir()
    (tmp_path / "satu.json").write_text('{"satu:1": {"text": "a"}}')
    (tmp_path / "by_book" / "dua.jsonl").write_text('{"id": 7, "t": 1}\n\n{"key": "k"}\n{"number": 7, "t": 2}\n[1]')
    (tmp_path / "tiga.json").write_text("{broken")
    read = lambda name, *listed: {r.key: r.item for r in readers.read_collection(spark, str(tmp_path), name, listed).collect()}
    assert read("satu") == {"satu:1": '{"text": "a"}'} and read("dua") == {"7": '{"number": 7, "t": 2}', "k": '{"key": "k"}'}
    assert read("tiga") == {} == read("nihil") and read("nihil", f"{tmp_path}/satu.json") == read("satu")


def test_shared_folder_of_a_cluster(spark):
    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: None)})
        sparkContext = Context

    from leafmill import work

    with pytest.raises(RuntimeError):
        work.shared_folder(Session)
    df = work.stage(spark.range(3), "three")
    path = work._written[-1][1]
    assert df.count() == 3
    work.release()
    assert not os.path.exists(path.replace("file:", ""))
