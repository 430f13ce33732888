"""Language spans: Viterbi against brute force, planted mixtures, defined cases."""

import datetime as dt
import itertools

import numpy as np
import pytest

from leafmill.llm import languages as lang

CODE = {x: i for i, x in enumerate(lang.LANGUAGES)}
TEXT = {
    "id": "ibu membaca buku besar di pasar. guru menulis surat lama dengan sabar.",
    "en": "the reader opens the large book. my father writes a letter with patience.",
    "fr": "le lecteur ouvre le grand livre. mon père écrit une lettre avec patience.",
    "tr": "okur büyük kitabı açıyor. babam sabırla mektubu yazıyor.",
    "ru": "читатель открывает большой том. отец пишет письмо терпеливо.",
    "ar": "يفتح القارئ الكتاب الكبير. يكتب الأب الرسالة بصبر.",
    "ur": "قاری بڑی کتاب کھولتا ہے۔ والد صبر سے خط لکھتے ہیں۔",
}


@pytest.fixture(scope="module")
def model():
    # One label in six is wrong.
    rows = [(t, CODE[x] if i % 6 else (CODE[x] + 1) % 7) for x, t in TEXT.items() for i in range(1, 13)]
    return lang.fit([t for t, _ in rows], [x for _, x in rows])


def test_pure_texts(model):
    s = model.spans(list(TEXT.values()))
    assert [lang.LANGUAGES[x] for x in s["language"]] == list(TEXT)
    assert s["text"].tolist() == list(range(7)) and (s["confidence"] > 0.5).all()


def test_mixed_text(model):
    text = TEXT["id"] + "\n\n" + TEXT["fr"] + " " + TEXT["ar"] + "\n" + TEXT["en"] + " («книга»)."
    s = model.spans(["", text, None, "123 ...", text])
    own = s["text"] == 1
    assert [lang.LANGUAGES[x] for x in s["language"][own]][:4] == ["id", "fr", "ar", "en"]
    a, b = s["start"][own][1], s["end"][own][1]
    assert text[a:b] == TEXT["fr"].rstrip(".")
    assert s["letters"][own][1] == sum(c.isalpha() for c in TEXT["fr"])
    assert set(s["text"]) == {1, 4}


def test_quoted_words_do_not_end_a_stretch(model):
    text = "the reader opens («книга») the large book. " + TEXT["id"]
    kinds, letters = model.stretches([text, None])[1:]
    assert [lang.LANGUAGES[x] for x in kinds] == ["en", "id"] and letters[0] >= sum(c.isalpha() for c in "the reader opens the large book")


def test_viterbi_is_optimal(model):
    text = "ibu le book. kitabı membaca père"
    w, label, scores = model.decode([text, "x", text])

    def cost(path, at):
        return sum(scores[at + i, k] for i, k in enumerate(path)) - sum((lang.SWITCH_AT_START if w.opens[at + i] else lang.SWITCH) for i in range(1, len(path)) if path[i] != path[i - 1])

    n, latin = w.last[0] - w.first[0], [CODE[x] for x in ("id", "en", "fr", "tr")]
    for at in (w.first[0], w.first[2]):
        best = max(cost(p, at) for p in itertools.product(latin, repeat=int(n)))
        assert cost(label[at : at + n].tolist(), at) == pytest.approx(best, abs=1e-3)


def test_lanes_change_nothing(model, monkeypatch):
    texts = [" ".join([TEXT["id"], TEXT["fr"], TEXT["ar"], TEXT["en"]] * 9), None, TEXT["tr"], "", TEXT["ur"] * 20 + "\n" + TEXT["ru"] * 7]
    whole = model.decode(texts)[1]
    for lane in (5, 17, 64):
        monkeypatch.setattr(lang, "LANE", lane)
        assert np.array_equal(whole, model.decode(texts)[1])


def test_other_languages(spark, model):
    # The toy model knows few words, so a text of a known language repeats its words.
    other = "Der alte Fischer kannte jeden Winkel seiner kleinen Bucht und erzählte abends gern davon, während draußen Wellen gegen schwarze Felsen schlugen."
    greek = "Ο γέρος ψαράς γνώριζε κάθε γωνιά του μικρού κόλπου του και το βράδυ του άρεσε να διηγείται ιστορίες."
    s = model.spans([TEXT["en"] * 3, greek, other])
    names = [*lang.LANGUAGES, lang.OTHER]
    letters = {i: {names[k]: int(s["letters"][(s["text"] == i) & (s["language"] == k)].sum()) for k in range(lang.STATES)} for i in range(3)}
    assert max(letters[0], key=letters[0].get) == "en" and max(letters[1], key=letters[1].get) == lang.OTHER and max(letters[2], key=letters[2].get) == lang.OTHER
    p = spark.createDataFrame([("b", 1, greek, dt.datetime(2024, 1, 1))], "book_id string, page_num int, content string, updated_at timestamp_ntz")
    b = spark.createDataFrame([("b", "en", dt.datetime(2024, 1, 1))], "book_id string, language string, updated_at timestamp_ntz")
    assert lang.mislabelled(p, b, model).count() == 0 and lang.book_languages(p, b, model).first().language == lang.OTHER


def test_label(spark):
    given = ["id", "EN_Latn", "fr-XA", "und", "", None, "  ", "unknown", "ar-001", "ms", " id"]
    df = spark.createDataFrame([(x,) for x in given], "language string").select(lang.label(lang.F.col("language")).alias("l"))
    assert [r.l for r in df.collect()] == ["id", "en", "fr", None, None, None, None, None, "ar", "ms", None]


def test_found(spark, model):
    t = dt.datetime(2024, 1, 1)
    late = t + dt.timedelta(days=1)
    pages = [("b", 1, TEXT["id"], t), ("b", 2, TEXT["id"] + " " + TEXT["ru"], t), ("b", 2, TEXT["id"] + " " + TEXT["ru"], t), ("b", 3, TEXT["en"], t), ("b", 3, None, late), ("c", 1, TEXT["tr"], t), (None, 1, "", None), ("d", 1, TEXT["ur"], t), ("b", 4, TEXT["id"] + " отец пишет письмо.", t)]
    books = [("b", "id-XA", t), ("b", "ru", t - dt.timedelta(days=9)), ("c", "und", t), ("d", "ur", None)]
    p = spark.createDataFrame(pages, "book_id string, page_num int, content string, updated_at timestamp_ntz").selectExpr("*", "'x' as language", "1 as mask")
    b = spark.createDataFrame(books, "book_id string, language string, updated_at timestamp_ntz").selectExpr("*", "1 as label")
    assert sorted(map(tuple, lang.mislabelled(p, b, model).collect())) == [("b", 2, "ru"), ("c", 1, "tr")]
    assert {(r.book_id, r.language) for r in lang.book_languages(p, b, model).collect()} == {("b", "id"), ("c", "tr"), ("d", "ur")}
    assert lang.mislabelled(p.limit(0), b, model).count() == 0
    empty = lang.fit([], [])
    assert empty.spans(["abc"])["letters"].tolist() == [3]


def test_tables(spark, sf):
    pages, books = spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/books.parquet")
    model = lang.fit_pages(pages, books)
    assert 0.1 <= model.scale <= 2 and np.array_equal(model.hashes, lang.fit_pages(pages, books).hashes)
    assert lang.fit_pages(pages.limit(0), books).hashes.size == 0
    rows = [r for r in lang.book_languages(pages, books, model).collect() if r.label in CODE and r.language]
    # Most labels are right, so most books must come out with theirs.
    assert np.mean([r.label == r.language for r in rows]) > 0.7
