"""Splitting: exact round trip, limits, overlaps and locality on small texts."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import splitting as s

WHITE = " \t\r\n"


def check(text, pieces):
    text = (text or "").strip(WHITE)
    assert "".join(text[p["start"] + p["overlap"] : p["stop"]] for p in pieces) == text
    for before, p in zip([None, *pieces], pieces):
        assert 0 < p["stop"] - p["start"] <= s.LIMIT
        assert 0 <= p["overlap"] <= s.OVERLAP
        if before:
            assert p["start"] == before["stop"] - p["overlap"]
        if p["cut"] not in ("hard", "end"):
            assert text[p["stop"]] in WHITE and text[p["stop"] - 1] not in WHITE


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["kata ", "buku. ", "x" * 130 + " ", "\n\n", "\r\n", "é😀 ", "z" * 700, " "]), max_size=300))
def test_round_trip(parts):
    text = "".join(parts)
    for t, p in zip([text, None, "a"], s.split_texts([text, None, "a"])):
        check(t, p)


def test_defined_cases():
    assert s.split_texts([None, "", " \t\r\n"]) == [[], [], []]
    assert [len(p) for p in s.split_texts(["y" * 1000, "y" * 1001])] == [1, 2]
    cut = s.split_texts(["y" * 3000])[0]
    assert [p["overlap"] for p in cut] == [0, 100, 100, 100] and {p["cut"] for p in cut[:-1]} == {"hard"}
    # A word of 950 characters is not cut: less is repeated before it.
    text = "a " * 200 + "z" * 950 + " b" * 300
    check(text, s.split_texts([text])[0])
    assert "hard" not in {p["cut"] for p in s.split_texts([text])[0]}


def test_edit_moves_only_neighbours():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(4000)]
    one = " ".join(words)
    words[2000] = "changed words here"
    two = " ".join(words)
    cut = lambda t: {t[p["start"] : p["stop"]] for p in s.split_texts([t])[0]}
    assert len(cut(one) ^ cut(two)) <= 8


def test_pages(spark):
    late, early = dt.datetime(2024, 2, 1), dt.datetime(2024, 1, 1)
    rows = [
        ("a", 1, "y" * 1001, early), ("a", 1, "short", late), ("a", 2, "word " * 300, late), ("a", 2, "word " * 300, late),
        ("b", 1, None, early), ("b", 2, "  " + "y" * 1000 + "\n", early), (None, 1, "y" * 1200 + " é", None), ("c", 1, "", late),
    ]
    pages = spark.createDataFrame(rows, "book_id string, page_num int, content string, updated_at timestamp_ntz").selectExpr("*", "1 as piece", "'x' as text")
    assert sorted(map(tuple, s.oversized_pages(pages).select("book_id", "page_num", "cut").collect()), key=str) == [("a", 2, "soft"), (None, 1, "hard")]
    assert s.page_pieces(pages).count() == 2 + 1 + 1 + 2
    assert s.oversized_pages(pages.limit(0)).count() == 0
