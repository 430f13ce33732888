"""State machines, quality edges, references and retrieval on hand-made rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from leafmill.functions import hashing
from leafmill.operators import catalog, chunking, dedupe, ocr, quality, references, retrieval


def model_parts(t):
    out, at = [], 0
    if len(t) <= 500:
        return [t]
    while True:
        w = t[at : at + 500]
        if at + 500 >= len(t):
            return [*out, t[at:]]
        feed, space = w.rfind("\n"), w.rfind(" ")
        size = feed + 1 if feed > 250 else space + 1 if feed < 0 and space > 250 else 500
        out.append(t[at : at + size])
        at += size - 50


def test_split_parts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["kata ", "x" * 40, "\n", "é😀 ", "panjang "], weights=[8, 1, w, 1, 4], k=rng.randint(0, 400))) for w in (0, 0.2, 2) for _ in range(15)] + ["y" * 1200, "a" * 500, "a" * 501]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", chunking.split_parts(F.col("t")).alias("p")).collect()}
    assert all(got[i] == model_parts(t) for i, t in enumerate(texts))


LONG = "Isi halaman yang panjang sekali " * 4


def chunks(spark, pages):
    df = spark.createDataFrame(pages, "book_id string, page_num int, content string")
    rows = chunking.chunk_books(df).orderBy("book_id", "unit", "chunk_idx").collect()
    return [(r.page_start, r.page_end, r.chunk_idx, r.text) for r in rows]


def test_chunk_rules(spark):
    s = LONG.strip()
    note = "catatan kecil yang cukup panjang disini"
    head = "Bab Pertama Tentang Adab Menuntut Ilmu"
    assert chunks(spark, [("b", 1, note)]) == []  # nothing to belong to
    assert chunks(spark, [("b", 1, LONG), ("b", 2, note), ("b", 5, note)]) == [(1, 5, 0, f"{s}\n\n{note}\n\n{note}")]
    assert chunks(spark, [("b", 1, LONG), ("b", 2, head)]) == [(1, 2, 0, f"{s}\n\n{head}")]
    assert chunks(spark, [("b", 1, LONG), ("b", 3, head), ("b", 4, note), ("b", 5, LONG)]) == [(1, 1, 0, s), (3, 4, 0, f"{head}\n\n{note}"), (5, 5, 0, s)]
    assert chunks(spark, [("b", 1, head), ("b", 2, head), ("b", 3, note)]) == [(1, 3, 0, f"{head}\n\n{head}\n\n{note}")]
    assert chunks(spark, [("b", 1, "short"), ("b", 2, None), ("b", 3, "1420 H"), ("b", 4, "cover of\nthe book that is rather long indeed")]) == []
    long = LONG * 8
    parts = model_parts(long.strip())
    assert chunks(spark, [("b", 7, long), ("b", 8, note)])[-1] == (7, 8, len(parts) - 1, f"{parts[-1]}\n\n{note}")


def test_quality_edges(spark):
    def page(content, language="id", path="/x/a.txt"):
        df = spark.createDataFrame([("b", 1, content, language, path, "txt")], "book_id string, page_num int, content string, language string, path string, extractor string")
        return quality.page_quality(df).first()

    assert page(None).reasons == ["too_short_or_empty"] and page("").status == "ocr_needed"
    assert page("kata " * 5).reasons == ["too_short_or_empty"]
    assert page("buku ini dibaca oleh para murid setiap pagi").status == "ok"
    assert page("aaaa " * 40).reasons == ["low_character_diversity"]
    assert "arabic_script_mismatch" in page("this page is written in another language entirely", "ar").reasons
    assert "encoding_replacement_chars" in page("teks rusak di sini �� dan banyak kata lain ada").reasons
    assert page("buku ini dibaca oleh para murid setiap pagi", path="/ar/b.txt").reasons == ["arabic_script_mismatch"]
    books = spark.createDataFrame([("b", "id", "/x", "pdf", 2 << 20), ("none", "id", "/x", None, 0)], "book_id string, language string, path string, extractor string, size_bytes long")
    pages = spark.createDataFrame([("b", i, "isi halaman yang sama dengan halaman lain", "id", "/x") for i in range(1, 5)], "book_id string, page_num int, content string, language string, path string")
    got = {r.book_id: r for r in quality.book_quality(pages, books).collect()}
    assert got["b"].reasons == ["repeated_pages", "conversion_loss_suspected"] and got["b"].duplicate_page_ratio == 0.75
    assert got["none"].reasons == ["too_short_or_empty"] and got["none"].page_count == 0


def test_near_duplicates_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        pages = [f"p{rng.randint(0, 40)}" for _ in range(rng.randint(0, 6))]
        if i and rng.random() < 0.5:
            pages = list(rows[rng.randrange(i)][5])
        base = rng.getrandbits(64) if i % 3 or not i else rows[i - 1][8] & (2**64 - 1)
        for _ in range(rng.randint(0, 9)):
            base ^= 1 << rng.randrange(64)
        rows.append((f"{i:03}", f"b{i}", rng.choice(["id", "en", "unknown"]), rng.choice(["Jalan Malam", "Jalan Malam Satu", "Kisah", None]), len(pages), pages, rng.choice([None, f"c{rng.randint(0, 60)}"]), rng.choice([None, f"t{rng.randint(0, 60)}"]), base - (1 << 64) if base >> 63 else base))
    df = spark.createDataFrame(rows, "pos string, book_id string, language string, title string, page_count int, page_hashes array<string>, content_hash string, text_hash string, simhash long")
    want = {}
    for c in rows:
        best = None
        for e in rows:
            if e[0] >= c[0] or not c[5] or not e[5] or not (c[2] == "unknown" or e[2] in ("unknown", c[2])) or min(c[4], e[4]) / max(c[4], e[4]) < 0.45:
                continue
            if (c[6] and c[6] == e[6]) or (c[7] and c[7] == e[7]):
                best = (e[1], 1.0)
                break
            a, b = set(c[5]), set(e[5])
            score = max(len(a & b) / len(a | b), 1 - bin((c[8] ^ e[8]) & (2**64 - 1)).count("1") / 64 if c[8] and e[8] else 0)
            x, y = set((c[3] or "").lower().split()), set((e[3] or "").lower().split())
            title = len(x & y) / len(x | y) if x | y else 0
            if score >= 0.8 and title >= 0.4:
                score = min(1, score + min(0.08, 0.08 * title))
            if score >= 0.92 and (best is None or score > best[1] + 1e-12):
                best = (e[1], score)
        if best:
            want[c[1]] = best[0]
    got = {r.book_id: r.duplicate_of for r in dedupe.near_duplicates(df.drop("page_hashes"), df.selectExpr("pos", "explode(page_hashes) AS h")).collect()}
    assert got == want and len(want) > 10


def test_near_values(spark):
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for n in (1, 5, 6, 10, 11):
            w = v
            for bit in rng.sample(range(64), n):
                w ^= 1 << bit
            values.add(w)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "h long")
    for bits, least in ((5, 1), (10, 6)):
        want = {(a, b) for a in signed for b in signed if a != b and least <= ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
        assert {tuple(r) for r in hashing.near_values(frame, bits, least).collect()} == want and len(want) > 30


def test_page_jaccard_near_has_no_hot_pages(spark):
    """A page that all books have makes no candidates, and no similar pair is lost."""
    rng = random.Random(3)
    sets = {f"b{i:03}": {"filler", *(f"p{rng.randint(0, 300)}" for _ in range(9))} for i in range(120)}
    for i in range(0, 120, 4):
        sets[f"b{i:03}"] = set(sorted(sets[f"b{i + 1:03}"])[1:])
    rows = spark.createDataFrame([(b, x) for b, s in sets.items() for x in s], "book_id string, page_hash string")
    got = {(r.book_a, r.book_b): r.jaccard for r in dedupe.page_jaccard_near(rows).collect()}
    firsts = {}
    for b in sorted(sets):
        firsts.setdefault(frozenset(sets[b]), b)
    names = sorted(firsts.values())
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {k: round(v, 4) for k, v in want.items()} == got and len(want) >= 25
    n = rows.groupBy("book_id").count().selectExpr("book_id as pos", "count as n")
    prefix = dedupe._rarest(rows.selectExpr("book_id as pos", "page_hash as h").join(n, "pos"), 0.8)
    assert prefix.where("h = 'filler'").count() == 0


def test_catalog_merges(spark):
    old = spark.createDataFrame([("a", "p1", 1), ("b", "p2", 2), (None, "p3", 3)], "book_id string, json_path string, v int")
    new = spark.createDataFrame([("a", "p9", 7), (None, "p4", 9), ("z", "p2", 5)], "book_id string, json_path string, v int")
    once = catalog.upsert(old, new, ["book_id"])
    assert sorted(r.v for r in once.collect()) == [2, 5, 7, 9]
    assert sorted(r.v for r in catalog.upsert(once, new, ["book_id"]).collect()) == [2, 5, 7, 9]
    assert sorted(r.v for r in catalog.upsert_any(old, new, ["book_id", "json_path"]).collect()) == [3, 5, 7, 9]
    state = spark.createDataFrame([("a", "h", True, 4), ("b", "h", False, 2), ("c", "old", True, 1)], "book_id string, source_hash string, complete boolean, next_batch_index int")
    books = spark.createDataFrame([(x, "h") for x in "abcd"], "book_id string, source_hash string")
    assert {r.book_id: (r.action, r.next_batch) for r in catalog.intake_actions(books, state).collect()} == {"a": ("skip", 0), "b": ("resume", 2), "c": ("refresh", 0), "d": ("new", 0)}
    assert {r.action for r in catalog.intake_actions(books, state, force=True).collect()} == {"refresh", "new"}
    bridge = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "book_id string, chunk_hash string")
    assert [r.chunk_hash for r in catalog.release(bridge, spark.createDataFrame([("b",)], "book_id string"))[1].collect()] == ["y"]


def test_references(spark):
    lines = spark.createDataFrame([("# note",), ("2|5|a|b ",), ("x|1|z",), ("002|006|c",), ("broken",)], "value string")
    verses = references.parse_verses(lines)
    assert [(r.key, r.text) for r in verses.orderBy("key").collect()] == [("2:5", "a|b"), ("2:6", "c")]
    v = spark.createDataFrame([("2:5", "AR", "ID", "EN"), ("3:1", " ", "I3", None)], "key string, arabic string, translation_id string, translation_en string")
    h = spark.createDataFrame([("bukhari", "1", "bukhari:1", "HA", "niat amal", None), ("muslim", "7", "muslim:7", None, "sabar", None)], "collection string, number string, key string, arabic string, translation_id string, translation_en string")
    b = spark.createDataFrame([("P001_B002", " ocr "), ("e", " ")], "block_id string, text string")
    texts = spark.createDataFrame([
        (1, "a[[DELETE_START]]x\n[[QS 2:5]][[DELETE_END]]b [[qs 002:005 id+ar]] [[QS 9:9]] [[FIX_QS 3:1 id]]"), (2, "[[HADITH sahih_bukhari : 001 ar+id]] [[HADITH nope:3]] [[ARABIC_BLOCK p001_b002]] [[ARABIC_BLOCK e]]"),
        (3, "[[DORAR_SEARCH sabar::id]] end [[DORAR_SEARCH tiada]]"), (4, None), (5, "plain $1 \\ text"),
    ], "doc_id long, text string")
    out, rest = references.resolve(texts, v, h, b, policy="first")
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "ab AR\n\nID [[ERROR_QS_NOT_FOUND 9:9]] I3", 2: "HA\n\nniat amal [[HADITH nope:3]] ocr [[ARABIC_BLOCK e]]", 3: "sabar end [[DORAR_SEARCH tiada]]", 4: "", 5: "plain $1 \\ text"}
    assert sorted((r.doc_id, r.type) for r in rest.collect()) == [(1, "verse"), (2, "block"), (2, "hadith"), (3, "search")]
    q = spark.createDataFrame([(1, "bukhari:1"), (2, "niat amal"), (3, "7"), (4, "")], "query_id long, query string")
    best = {r.query_id: (r.key, r.reason, r.score) for r in references.search_records(q, h).where("rank = 1").collect()}
    assert best[1][:2] == ("bukhari:1", "nomor") and best[2] == ("bukhari:1", "", 500 + 80 + 30.0) and best[3][1] == "nomor" and 4 not in best


def test_lines_of_words(spark):
    cols = "page int, level int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
    words = [(1, 5, 1, 1, 1, 2, 50, 10, 30, 9, 80.0, "dua"), (1, 5, 1, 1, 1, 1, 10, 12, 30, 9, -1.0, "satu"), (1, 5, 1, 1, 2, 1, 5, 5, 9, 9, 90.0, "كتاب"), (1, 4, 1, 1, 1, 1, 0, 0, 9, 9, 1.0, "no"), (1, 5, 1, 1, 3, 1, 0, 0, 9, 9, 1.0, " ")]
    got = [(r.block_id, r.text, r.left, r.top, r.right, r.bottom, r.conf, r.script_guess) for r in ocr.line_blocks(spark.createDataFrame(words, cols)).orderBy("block_id").collect()]
    assert got == [("p001_b001", "كتاب", 5, 5, 14, 14, 90.0, "arabic"), ("p001_b002", "satu dua", 10, 10, 80, 21, 80.0, "latin")]


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8)).round(1)
    points = spark.createDataFrame([(i, v.tolist(), str(i % 3)) for i, v in enumerate(vectors)] + [(999, None, "0")], "id long, vector array<double>, tag string").repartition(5)
    q = spark.createDataFrame([(i, vectors[i].tolist(), None if i % 2 else str(i % 3)) for i in range(11)], "query_id long, vector array<double>, tag string")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {}
    for i in range(11):
        s = np.floor(unit @ unit[i] * 1e9 + 0.5) / 1e9
        ids = [j for j in range(300) if i % 2 or j % 3 == i % 3]
        want[i] = sorted(ids, key=lambda j: (-s[j], j))[:6]
    for block in (4, 100):
        got = {}
        for r in retrieval.nearest(points, q, 6, block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want
    assert retrieval.nearest(points, q.limit(0), 3).count() == 0


def test_search_and_judgement(spark):
    docs = spark.createDataFrame([(1, "Hukum Shalat", "Tata cara salat dan wudhu untuk pemula. " * 2, "id"), (2, "Zakat", "pendek", "id"), (3, None, None, None), (4, "Prayer", "how to pray salat properly every single day of the week", "en")], "doc_id long, title string, text string, lang string")
    queries = spark.createDataFrame([(1, "bagaimana sholat", "id", ["salat"], ["Hukum"]), (2, "zakat", None, [], ["zakat"]), (3, "yang untuk", "id", ["x"], [])], "query_id long, query string, language string, must_have array<string>, expected_titles array<string>")
    got = retrieval.search(docs, queries, 3)
    first = {r.query_id: r.doc_id for r in got.where("rank = 1").collect()}
    assert first[1] == 1 and first[2] == 2
    judged = retrieval.relevant(got, queries)
    m = retrieval.metrics(judged, queries).first()
    assert m.queries == 3 and m.recall_1 == 0.6667 and m.failed == 1
    plan = {r.query_id: r for r in retrieval.plan_queries(queries).collect()}
    assert plan[1].groups == [["salat", "shalat", "sholat"]] and plan[3].terms == ["yang untuk"] and len(plan[3].variants) == 1
    assert {r.query_id for r in retrieval.search(docs.limit(0), queries, 3).collect()} == set()
