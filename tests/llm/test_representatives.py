"""Survivors and whole bundles against brute force on small families."""

import datetime as dt
import itertools
import random

from leafmill.llm import representatives as r

T = dt.datetime(2024, 1, 1)
BOOK = "book_id string, content_hash string, text_hash string, review_status string, quality_status string, source_type string, filename string, title string, source_relpath string, extractor string, quality_expected_language string, quality_detected_script string, updated_at timestamp_ntz, family_key string"


def tables(spark, books, families):
    columns = {c for names, _ in r.BUNDLES.values() for c in names}
    df = spark.createDataFrame(books, BOOK)
    for c in sorted(columns - set(df.columns)):
        df = df.selectExpr("*", f"cast(null as string) as {c}")
    return spark.createDataFrame(families, "family_key string, content_hash string, text_hash string, updated_at timestamp_ntz"), df


def book(name, c="h", t=None, review="approved", quality="ok", source="txt", filled="abcdef", day=0):
    return (name, c, t, review, quality, source, *[x if x != " " else None for x in filled], T + dt.timedelta(days=day), "clash")


def test_survivors(spark):
    books = [
        book("a", review=" Approved_Auto ", filled="ab  ef", day=3), book("b", review="rejected", filled=" b   f", day=1), book("b", review="rejected", filled=" b   f", day=1),
        book("c", t="x", c=None, review="pending_review", filled="      ", day=2), book("d", c=None, t=None), book("e", c="", t=" "),
        book("g1", c="g", filled="abcde ", day=2), book("g2", c="g", review="rejected", quality="warn", source=None, filled="    ef", day=1),
        book("k1", c="k", day=5, review="rejected"), book("k2", c="k", day=1), book("s", c="single"), book(None, c="g", review=None, quality=None, source=None, filled="      ", day=-3),
    ]
    families = [("f", "h", "x", T), ("g", "g", None, T), ("k", "k", None, T), ("single", "single", None, T), ("null", None, None, T), ("blank", "", " ", T), ("f", "old", None, T - dt.timedelta(days=1))]
    fam, bk = tables(spark, books, families)
    got = {tuple(x) for x in r.survivors(fam, bk).collect()}
    # In family k each member beats the other somewhere, so none survives.
    assert got == {("f", "record", "a"), ("g", "record", "g1"), ("g", "quality_detected_script", "g2")}
    assert r.survivors(fam.limit(0), bk).count() == 0 and r.survivors(fam, bk.limit(0)).count() == 0
    golden = {(x.family_key, x.bundle): x.book_id for x in r.golden_records(fam, bk).collect()}
    assert golden[("f", "title")] == "a" and golden[("g", "language")] == "g1"


def test_search_is_optimal():
    rng = random.Random(4)
    for _ in range(200):
        bundles = [f"b{i}" for i in range(rng.randint(1, 4))]
        needs = lambda: {k: v for k in ("type", "script") if (v := rng.choice([None, "x", "y", "z"])) is not None}
        options = [(b, needs() if b != "b0" else {}, (rng.randint(1, 3), rng.randint(0, 9))) for b in bundles for _ in range(rng.randint(1, 3))]
        agree = lambda ix: all(len({options[i][1][k] for i in ix if k in options[i][1]}) <= 1 for k in ("type", "script"))
        found = r.search(options)
        total = lambda ix: tuple(sum(options[i][2][k] for i in ix) for k in range(2))
        best = (0, 0)
        choices = [[None, *[i for i, o in enumerate(options) if o[0] == b]] for b in bundles]
        for pick in itertools.product(*choices):
            ix = [i for i in pick if i is not None]
            if agree(ix):
                best = max(best, total(ix))
        assert total(found.values()) == best and agree(found.values())
    assert r.search([]) == {}


def test_alone():
    options = [("record", {"c": True}, (2, 1)), ("record", {"c": False}, (1, 2)), ("c", {"c": False}, (0, 0))]
    assert r.search(options, alone="record") == {}
    assert r.search([*options, ("record", {"c": False}, (2, 2))], alone="record") == {"record": 3, "c": 2}


def test_search_decides(spark, monkeypatch):
    """Taking every option that the search is given gives other rows than the search."""
    books = [book("a", filled="ab  ef", day=3), book("b", review="rejected", filled=" bcd f", day=1), book("c", quality="warn", filled="a     ", day=2)]
    fam, bk = tables(spark, books, [("f", "h", None, T)])
    got = {tuple(x) for x in r.survivors(fam, bk).collect()}
    assert got == {("f", "record", "a"), ("f", "source_relpath", "b"), ("f", "extractor", "b")}
    own = [("a", (3, 3, 3, 4, 3), 1, (True, True, False, False, True, True)), ("b", (1, 3, 3, 4, 1), 1, (False, True, True, True, False, True))]
    fillers = {(c,): ("b", (1, 3, 3, 4, 1)) for c in r.FILLED} | {("filename", "source_relpath"): ("c", (3, 2, 3, 2, 2))}
    options = r.record_options(own) + r.filler_options(fillers)
    found = r.search([o[:3] for o in options], alone="record")
    rows = {x for i in found.values() for x in options[i][3]}
    assert rows == {("record", "a"), ("source_relpath", "b"), ("extractor", "b")} and rows != {x for o in options for x in o[3]}
    # A record that lacks both columns of a bundle takes them from one member that has both.
    none = r.record_options([("a", (3, 3, 3, 2, 3), 1, (False, True, False, True, True, True))])
    options = none + r.filler_options(fillers)
    assert ("filename", "c") in {x for i in r.search([o[:3] for o in options], alone="record").values() for x in options[i][3]}


def test_hot_family(spark):
    books = [book(f"m{i:04}", filled="      ", day=-i, review="rejected") for i in range(1500)] + [book("top", filled="abcde ", day=9), book("f", filled="     f", day=-2, review="rejected")]
    fam, bk = tables(spark, books, [("f", "h", None, T)])
    assert {tuple(x) for x in r.survivors(fam, bk).collect()} == {("f", "record", "top"), ("f", "quality_detected_script", "f")}
