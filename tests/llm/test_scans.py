"""Scan noise planted into clean pages, and the parts on their own."""

import datetime as dt
import random

import numpy as np

from leafmill.llm import scans

T = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)
WORDS = "ibu membaca buku besar tentang rumah dengan sabar guru menulis surat untuk murid sesudah hujan penjaga membeli roti dalam pasar keluarga menyimpan naskah".split()


def sentence(rng):
    s = " ".join(rng.choices(WORDS, k=rng.randint(5, 9)))
    return s.capitalize() + "."


def wrap(text, width):
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line]


def corpus(seed=1):
    rng = random.Random(seed)
    pages, want = [], set()
    for b in range(30):
        title = rng.choice(["Jalan Malam", "Hikmah Pasar", "Kisah Puasa Ustaz Ramiho"])
        for p in range(1, 9):
            body = wrap(" ".join(sentence(rng) for _ in range(8)), 56)
            rows = [(x, set()) for x in body]
            if b % 2:
                i = rng.randrange(1, len(rows) - 1)
                words = rows[i][0].split()
                for k, w in enumerate(words):
                    if "m" in w[1:] and w.isalpha():
                        words[k] = w[0] + w[1:].replace("m", "rn", 1)
                        rows[i] = (" ".join(words), {"misread"})
                        break
                i = rng.randrange(0, len(rows) - 1)
                first, rest = rows[i + 1][0].split()[0], rows[i + 1][0].split()[1:]
                if len(first) > 5 and first.isalpha() and "rn" not in first and rest and not rows[i + 1][1]:
                    mark = rng.choice(scans.MARKS)
                    rows[i] = (rows[i][0] + " " + first[:3] + mark, rows[i][1] | {"hyphen"})
                    rows[i + 1] = (first[3:] + " " + " ".join(rest), rows[i + 1][1])
                head = rng.choice([title, title.upper(), f"— {title} —"])
                if p > 1:
                    rows.insert(0, (head, {"header"}))
                rows.append((rng.choice(["- {} -", "Halaman {}", "[{}]", "{} |", "{}"]).format(p + 4), {"page_number"}))
            else:
                rows.insert(0, (title, set())) if p == 1 else None
                rows.append(("Buku tentang anak-", set()))
                rows.append(("anak dan kata-kata, anak-anak (12).", set()))
            pages.append((f"b{b}", p, "\r\n".join(x for x, _ in rows), T))
            want |= {(f"b{b}", p, i + 1, k) for i, (_, kinds) in enumerate(rows) for k in kinds}
    books = [(f"b{b}", None, T) for b in range(30)]
    return pages, books, want


SCHEMA = "book_id string, page_num int, content string, updated_at timestamp_ntz"


def test_planted(spark):
    pages, books, want = corpus()
    late = [("b1", 2, "Old state · of the page", T - DAY), pages[3], ("b2", 99, None, T), ("b2", 98, "", T), (None, 1, "ya.", None)]
    p = spark.createDataFrame(pages + late, SCHEMA).selectExpr("*", "1 as kind", "'k' as key", "2 as at")
    b = spark.createDataFrame(books, "book_id string, title string, updated_at timestamp_ntz")
    rows = [tuple(r) for r in scans.noisy_lines(p, b).collect()]
    assert len(rows) == len(set(rows))
    for kind, least in (("header", 0.97), ("page_number", 1), ("hyphen", 0.97), ("misread", 0.97)):
        found, true = {r for r in rows if r[3] == kind}, {r for r in want if r[3] == kind}
        assert len(found & true) >= least * len(true) and len(found & true) >= least * len(found), (kind, sorted(found ^ true)[:5])
    text = {(r.book_id, r.page_num): r for r in scans.repaired_pages(p, b).collect()}
    assert len(text) == len(pages) + 3
    for (book, number), r in text.items():
        assert r.content_len == len(r.content)
        if book and int(book[1:]) % 2:
            assert not any(m in r.content for m in "‐¬­|[") and "rn" not in r.content and "Halaman" not in r.content
    empty = p.limit(0)
    assert scans.noisy_lines(empty, b).count() == 0


def test_salted_words(spark, monkeypatch):
    pages, books, _ = corpus(2)
    p, b = spark.createDataFrame(pages, SCHEMA).repartition(6), spark.createDataFrame(books, "book_id string, title string, updated_at timestamp_ntz")
    one = {tuple(r) for r in scans.noisy_lines(p, b).collect()}
    monkeypatch.setattr(scans, "MOST_BLOCKS", 2)
    monkeypatch.setattr(scans, "CELL", 2)
    assert one == {tuple(r) for r in scans.noisy_lines(p, b).collect()}


def test_copies_count_once(spark):
    pages, books, _ = corpus(3)
    p, b = spark.createDataFrame(pages, SCHEMA), spark.createDataFrame(books, "book_id string, title string, updated_at timestamp_ntz")
    twice = p.unionAll(p).unionAll(p.selectExpr("book_id", "page_num", "'Old rurnah' as content", "updated_at - interval 1 day as updated_at"))
    for f in (scans.noisy_lines, scans.repaired_pages):
        assert sorted(map(str, f(p, b).collect())) == sorted(map(str, f(twice, b).collect()))


def test_words_that_names_follow_are_learned(spark):
    rng = random.Random(8)
    names = ["".join(rng.choices(["ra", "mi", "ho", "te", "lu", "ka", "so", "ne", "wi", "da"], k=4)) for _ in range(4000)]
    pages = [("b", i, " ".join(sentence(rng) + f" Ustaz {rng.choice(names).capitalize()} membaca." for _ in range(6)), T) for i in range(400)]
    blocks = scans.token_blocks(spark.createDataFrame(pages, SCHEMA).repartition(3))
    totals = blocks.select(scans.F.explode("uses").alias("u")).select("u.*").groupBy("word").agg(scans.F.sum("uses").alias("uses"), scans.F.sum("rare").alias("rare"))
    contexts = {r.word for r in scans.name_contexts(totals).collect()}
    assert contexts == {"ustaz"}
    entries = [e for r in scans.lexicons(blocks).collect() for e in r.entries]
    assert {e.word for e in entries if e.kind == scans._CONTEXT} == contexts and not any(e.kind == scans._WRONG and e.word in names for e in entries)


def test_near_headers(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abc", k=n))

    def damaged(s):
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + "x" + s[i:], s[:i] + "y" + s[i + 1 :]]) or "z"
        return s

    strong = {(f"b{rng.randint(0, 1)}", text(rng.randint(1, 25))) for _ in range(60)}
    weak = {(b, damaged(k)) for b, k in strong} | {("b2", k) for _, k in strong}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(b, k) for b, k in weak if any(b == c and len(s) > 1 and distance(k, s) <= (scans.NEAR if len(s) >= scans.SHORT_HEADER else 1) for c, s in strong)}
    frame = lambda x: spark.createDataFrame(sorted(x), "book_id string, key string")
    assert {tuple(r) for r in scans.near_headers(frame(weak), frame(strong)).collect()} == want


def test_stacked_edges():
    lines = ["Kisah Lama", "Bab Tiga", "12", "Ini baris pertama dari teks yang panjang sekali dan", "terus sampai di sini."]
    assert {i: k for i, k, _ in scans.edges(lines)} == {0: "header?", 1: "header?", 2: "page_number"}


def test_page_numbers():
    yes = ["12", "- 3 -", "[7]", "~ l8 ~", "9 |", "Halaman 58", "pg l7", "Hlm. 3", "p. 22", "صفحة ١", "صفحہ نمبر 7", "Стр. 12", "xiv", "l", "1O5", "٧"]
    no = ["954.", "(184).", "(12)", "", "di", "Pasar 4 roti", "Bab 3", "kata", "civil", "1234567", "buku lama"]
    assert all(scans.page_number(x) for x in yes), [x for x in yes if not scans.page_number(x)]
    assert not any(scans.page_number(x) for x in no), [x for x in no if scans.page_number(x)]


def test_skeletons(spark):
    words = ["rnernberi", "memberi", "clalam", "сmарик", "الىوم", "l0@5qvv"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", scans.skeletons(scans.F.col("w")).alias("s")).collect()
    assert all(r.s == scans.skeleton(r.w) for r in rows)
    assert scans.skeleton("mcrnberi") == scans.skeleton("memberi") and scans.skeleton("clalarn") == scans.skeleton("dalam")


def entries(words=(), names=(), compounds=(), contexts=(), choices=()):
    e = lambda kind, word, meant=None, before=None: {"kind": kind, "word": word, "meant": meant, "before": before}
    return [e(0, w, m) for w, m in words] + [e(1, w, m) for w, m in names] + [e(2, w) for w in compounds] + [e(3, w) for w in contexts] + [e(4, w, m, b) for b, w, m in choices]


def read(texts):
    """A block's tokens, cuts and lines, as they are read back."""
    own = {k: v[0].as_py() for k, v in scans.encoded(texts, np.ones(len(texts))).items()}
    block = scans.Block(*[own[c] for c in ("words", "numbers", "flags", "counts")])
    return block, block.placed(own["places"], own["gaps"]), own["cuts"], own["lines"]


def test_places_are_read_back():
    texts = ["Satu dua\n\n  tiga ·empat", None, "", "x", "İstanbul ve İzmir'de bir yol\nson", "ya"]
    block, (lines, starts), _, _ = read(texts)
    got = [(int(p), int(i), texts[p][a : a + len(w) - w.count("i\u0307")].lower()) for p, i, a, w in zip(block.page, lines, starts, (block.words[n] for n in block.number))]
    assert got == [(0, 0, "satu"), (0, 0, "dua"), (0, 2, "tiga"), (0, 2, "empat"), (3, 0, "x"), (4, 0, "i̇stanbul"), (4, 0, "ve"), (4, 0, "i̇zmir'de"), (4, 0, "bir"), (4, 0, "yol"), (4, 1, "son"), (5, 0, "ya")]


def said(texts, lexicon):
    block, where, cuts, lines = read(texts)
    return scans.marked(block, *where, cuts, lexicon), lines


def righted(texts, lexicon):
    """The texts with their fixes, in Python."""
    found, lines = said(texts, lexicon)
    out = [list(t or "") for t in texts]
    for page, _, kind, start, size, word in sorted(found, key=lambda r: -(r[3] or 0)):
        if kind == "fix":
            out[page][start : start + size] = word
    return ["".join(t) for t in out]


def test_specks_and_names(spark):
    lexicon = entries([("rurnah", "rumah")], [("rarnimi", "ramimi")], ["anak-anak"], ["ustaz"])
    texts = ["satu · dua\ntiga «' empat ; lima\nUstaz rarnimi rurnah.\nUstaz rurnah.", None, "• butir\n_ x"]
    found, lines = said(texts, lexicon)
    assert {(k, i) for k, i, kind, *_ in found if kind == "misread"} == {(0, 2)}
    assert {(x["i"], x["line"]) for x in lines if x["kind"] == "misread"} == {(0, 0), (0, 1), (2, 1)}
    assert [texts[x["i"]][x["start"] : x["start"] + x["size"]] for x in lines if x["kind"] == "speck"] == ["·", "«'", "_"]
    names = [(f"{a}{b}{c}", 60.0, True) for a in ("ra", "ne", "dim") for b in ("mi", "lbe", "que") for c in ("mi", "ra")] + [("nelbcra", 1.0, True), ("rarnimi", 1.0, True), ("lain", 5.0, False)]
    got = {r.word: r.meant for r in scans.misread_names(spark.createDataFrame(names, "word string, uses double, name boolean")).collect()}
    assert got == {"nelbcra": "nelbera", "rarnimi": "ramimi"}


def test_context_chooses(spark):
    pairs = [(1, "ibu", "clari", 1.0), (1, "ibu", "dan", 9.0), (1, "ibu", "dari", 2.0), (2, "pulang", "dari", 40.0), (2, "pulang", "dan", 2.0), (2, "pulang", "clari", 1.0), (3, "ke", "clari", 1.0)]
    forms = [("x", "dari", 90.0, "dari", True), ("x", "dan", 80.0, "dari", True), ("x", "clari", 3.0, "dari", False)]
    got = scans.choices(spark.createDataFrame(pairs, "block long, before string, word string, n double"), spark.createDataFrame(forms, "bones string, word string, uses double, meant string, standing boolean"))
    found = {tuple(r) for r in got.collect()}
    # After "pulang" a "dan" is misread, as its neighbour supports "dari" twenty times as often.
    assert found == {("ibu", "clari", "dan"), ("pulang", "dan", "dari")}
    lexicon = entries([("clari", "dari")], choices=found)
    assert righted(["ibu clari pulang clari x clari", "pulang dan", None, "İbu clari"], lexicon) == ["ibu dan pulang dari x dari", "pulang dari", "", "İbu dari"]
    assert [(i, k) for _, i, k, *_ in said(["ya\nPulang dan pergi ke pasar."], lexicon)[0] if k == "misread"] == [(1, "misread")]


def test_fixes_keep_the_case(spark):
    fixes = [(13, 1, ""), (6, 6, "rumah"), (0, 5, "dari")]
    frame = spark.createDataFrame([("CLARI Rurnah · ya", fixes), ("x", None)], "t string, f array<struct<start:int,size:int,word:string>>")
    assert [r.t for r in frame.select(scans.righted(scans.F.col("t"), scans.F.col("f")).alias("t")).collect()] == ["DARI Rumah ya", "x"]


def test_reflow(spark):
    text = ["Satu dua tiga em", "Judul Buku", "pat lima enam tujuh", "delapan.", "Sembilan sepuluh anak-", "anak dan rumah besar", "", "baru"]
    lines = [("p", i + 1, x.strip(), x == "Judul Buku", False, i in (0, 4)) for i, x in enumerate(text)] + [("q", 1, "", False, False, False)]
    frame = spark.createDataFrame(lines, "page string, line_num int, line string, gone boolean, indented boolean, glued boolean")
    got = {r.page: r.content for r in scans.reflowed(frame, "page").collect()}
    assert got == {"p": "Satu dua tiga empat lima enam tujuh delapan.\n\nSembilan sepuluh anak-anak dan rumah besar\n\nbaru", "q": ""}


def test_cut_words(spark):
    pages = [("b1", p, f"Judul\nIbu membaca buku besar tentang ru-\nrnah dan pasar dengan anak-\nanak besar sekali {p}.", T) for p in range(2, 5)]
    pages += [("b2", p, "ibu rumah besar anak-anak. " * 20, T) for p in range(1, 4)]
    p, b = spark.createDataFrame(pages, SCHEMA), spark.createDataFrame([("b1", None, T)], "book_id string, title string, updated_at timestamp_ntz")
    rows = {(r.page_num, r.line_num, r.kind) for r in scans.noisy_lines(p, b).where("book_id = 'b1'").collect()}
    assert {(2, 2, "hyphen"), (3, 3, "misread")} <= rows and (2, 3, "hyphen") not in rows
    text = {r.page_num: r.content for r in scans.repaired_pages(p, b).where("book_id = 'b1'").collect()}
    assert text[3].endswith("tentang rumah dan pasar dengan anak-anak besar sekali 3.")
