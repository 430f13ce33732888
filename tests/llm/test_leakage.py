"""Leaks against a brute-force comparison of all runs of twelve words."""

import random
import unicodedata

import numpy as np
import regex

from leafmill.llm import kernel, leakage

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def runs(text):
    words = WORD.findall(leakage.normalised(text))
    return {tuple(words[i : i + 12]) for i in range(len(words) - 11)}


def brute(docs, items):
    have = [(i, runs(p)) for i, p in items]
    return {(d, i) for d, t in docs for i, r in have if r and runs(t) & r}


def test_suffix_array():
    rng = random.Random(3)
    for n in (0, 1, 2, 50, 300):
        words = np.array([rng.randint(1, 3) for _ in range(n)], np.uint64)
        order = leakage.suffix_array(words).tolist()
        assert sorted(order) == list(range(n))
        keys = [tuple(words[i : i + 16]) for i in order]
        assert keys == sorted(keys)


def test_normalised():
    assert leakage.normalised("A&amp;b­c ​d") == "a&bc d" and leakage.normalised(None) == ""
    assert leakage.normalised("ﬁ مُحَـمّد") == "fi محمد"
    for c in [0xAD, 0x200B, 0x200D, 0xFEFF, 0x640, 0x64B, 0x65F, 0x670, 0x6D6, 0x6ED]:
        assert leakage.normalised(f"م{chr(c)}x") == "مx"
    _, first, last = kernel.words(["a b", None, "", "c"])
    assert (last - first).tolist() == [2, 0, 0, 1]


def test_against_brute_force(spark, sf):
    rng = random.Random(7)
    vocabulary = ["kata", "b", "é", "سلام", "دعاء", "X", "7", "d"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([0, 5, 12, 13, 40]))) for i in range(25)] + [(25, None), (26, items_text := text(30)), (27, items_text), (None, text(14))]
    docs = [(i, text(rng.choice([0, 3, 11, 12, 60]))) for i in range(120)] + [(120, None), (121, "")]
    for k, (i, p) in enumerate(items):
        words = (p or "").split()
        a = rng.randint(0, max(0, len(words) - 12))
        part = words[a : a + rng.choice([11, 12, 13])]
        docs.append((200 + k, text(4) + " " + rng.choice(["­ ", "&nbsp;", ", "]).join(part).upper() + " " + text(4)))
    docs += docs[:5] + [(None, items_text), (None, "kata b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'z' as words")
    tests = spark.createDataFrame(items, "item_id long, passage string")
    want = brute(docs, items)
    for most in (10**6, 30):
        got = leakage.leaks(frame, tests, most).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {r.doc_id for r in leakage.cleaned(frame, tests).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert leakage.leaks(frame.limit(0), tests).count() == 0 == leakage.leaks(frame, tests.limit(0)).count()


def test_longest(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"W{i}" for i in range(5, 30)) + " z " + " ".join(f"w{i}" for i in range(12)))], "doc_id long, text string")
    tests = spark.createDataFrame([(9, passage)], "item_id long, passage string")
    assert [tuple(r) for r in leakage.leaks(docs, tests).collect()] == [(1, 9, 25, 2)]


def test_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.passage) for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect()]
    got = leakage.leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items)
    assert unicodedata.normalize("NFKC", "ﬁ") == "fi"
