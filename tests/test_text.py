"""Text functions against plain Python models of the same rules."""

import hashlib
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import hashing, text

#: Texts with the two normal forms that they must have.
FORMS = [
    ('', '', ''),
    (' ', '', ''),
    ('Ab c', 'ab c', 'ab c'),
    ('\ufb01 \xbd \xb2', 'fi 1 2 2', 'fi 1 2 2'),
    ('\u0645\u064f\u062d\u064e\u0645\u064e\u0651\u062f \u0643\u062a\u0627\u0628', '\u0645\u062d\u0645\u062f \u0643\u062a\u0627\u0628', '\u0645\u062d\u0645\u062f \u0643\u062a\u0627\u0628'),
    ('a\xa0b\x0cc', 'a b c', 'a b c'),
    ('&amp;lt; x', 'lt x', 'amp lt x'),
    ('\xdcn\xefcode_\xc9', '\xfcn\xefcode_\xe9', '\xfcn\xefcode_\xe9'),
    ('\U0001f600a', 'a', 'a'),
    ('x\x1cy', 'x y', 'x y'),
    ('\u2028 z', 'z', 'z'),
    ('AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA', 'aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa', 'aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa'),
    ('\u0640\u062a\u0637\u0648\u064a\u0644', '\u0640\u062a\u0637\u0648\u064a\u0644', '\u0640\u062a\u0637\u0648\u064a\u0644'),
    ("bid'ah ada", 'bid ah ada', 'bid ah ada'),
    ('\u65e5\u672c text', '\u65e5\u672c text', '\u65e5\u672c text'),
]


def run(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", column.alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_normal_forms(spark):
    t, samples = F.col("t"), [x for x, _, _ in FORMS]
    assert run(spark, text.normalize_import(t), samples) == [x for _, x, _ in FORMS]
    assert run(spark, text.normalize_search(t), samples) == [x for _, _, x in FORMS]
    assert run(spark, text.strip(t), samples) == [x.strip() for x in samples]
    assert run(spark, text.normalize_import(t), [None]) == [None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aÉé ½²_-.,;ﬁمَـ \f\x1c😀Я"), max_size=20), min_size=1, max_size=20))
def test_normal_forms_are_stable(spark, values):
    """A normal form is its own normal form, has single spaces, and no sign that is dropped."""
    for form in (text.normalize_import, text.normalize_search):
        once = run(spark, form(F.col("t")), values)
        assert run(spark, form(F.col("t")), once) == once
        assert not any("  " in x or x != x.strip() or "\u064e" in x or set(x) & set(".,;-\f") for x in once)


def test_profile_and_script(spark):
    rows = run(spark, text.char_profile(F.col("t")), ["aBé1٣ ,$�م", None])
    assert tuple(rows[0]) == (10, 9, 4, 1, 3, 2, 1, 2, 1, 0) and rows[1].total == 0
    cases = {"": "unknown", "a" * 19: "mixed", "a" * 20: "latin", "م" * 20 + "a" * 10: "arabic", "م" * 20 + "a" * 11: "mixed", "123": "unknown"}
    assert run(spark, text.detect_script(F.col("t")), list(cases)) == list(cases.values())


def test_names(spark):
    titles = {"id_THE_book_of_al-x": "THE Book of Al X", "en-the_KITAB_of_a": "The KITAB of a", "x": "X", "ar_": "ar_"}
    assert run(spark, text.clean_title(F.col("t")), list(titles)) == list(titles.values())
    paths = {"/a/AR/x.txt": "ar", "/a/en_x.txt": "en", "/id/ru/al-x.pdf": "al", "/a/b.txt": "unknown", "/id/x": "id"}
    assert run(spark, text.language_from_path(F.col("t")), list(paths)) == list(paths.values())
    assert run(spark, text.book_id(F.lit("r"), F.col("t")), ["a/b c.pdf", "__é x\\y"]) == ["r__a_b_c.pdf", "r__x_y"]
    assert run(spark, text.stem_key(F.col("t")), ["Id_Buku-A.1", "كتاب"]) == ["id buku a 1", ""]
    assert run(spark, text.split_pages(F.col("t")), ["a\f\f b \f", "\f"]) == [["a", "b"], []]
    assert run(spark, text.highlight(F.col("t"), F.lit("buku ab Kitab")), ["Buku dan KITAB ab"]) == ["<mark>Buku</mark> dan <mark>KITAB</mark> ab"]
    assert run(spark, text.snippet(F.col("t")), ["x " * 300]) == [("x " * 300).strip()[:360] + "..."]


def test_hashes(spark):
    values = ["", "abc", "kitab é"]
    assert run(spark, hashing.uuid5(F.col("t")), values) == [str(uuid.uuid5(uuid.NAMESPACE_URL, v)) for v in values]
    assert run(spark, hashing.signed64(F.col("t")), ["ffffffffffffffff", "7fffffffffffffff", "0"]) == [-1, (1 << 63) - 1, 0]

    def simhash(t):
        total = [0] * 64
        for w in t.split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            for i in range(64):
                total[i] += 1 if h >> i & 1 else -1
        v = sum(1 << i for i in range(64) if total[i] > 0) if t.split() else 0
        return v - (1 << 64) if v >> 63 else v

    texts = ["", "a b c", "a a b", "satu dua tiga empat lima", None]
    assert run(spark, hashing.simhash_compat(F.col("t")), texts) == [simhash(t or "") for t in texts]
    rows = spark.createDataFrame([("x", "satu dua"), ("x", "dua tiga empat lima"), ("y", " ")], "k string, t string")
    assert [tuple(r) for r in hashing.simhash_by(rows, "k", "t").collect()] == [("x", simhash("satu dua dua tiga empat lima"))]
