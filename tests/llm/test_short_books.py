"""Every book has a row in the groups, however short its text."""

import datetime as dt

from leafmill.llm import duplicates as dup

T = dt.datetime(2024, 1, 1)


def test_short_and_empty_books(spark):
    long = " ".join(f"w{i}" for i in range(80))
    few = " ".join(f"v{i}" for i in range(49))
    texts = {"a": [(1, long)], "b": [(1, long + " end")], "c": [(1, few)], "d": [(3, few[: few.index("v20")]), (90, few[few.index("v20") :])], "e": [(1, few + " x")], "f": [(1, "one")], "g": [(200, "One.")], "h": [(1, "")], "i": [(1, None), (99, " . ")], "j": [(1, "two one")], "k": [(1, "one two")]}
    rows = [(b, p, c, T) for b, pages in texts.items() for p, c in pages] + [(None, 1, "one", T)]
    pages = spark.createDataFrame(rows, "book_id string, page_num int, content string, updated_at timestamp_ntz")
    got = {r.book_id: r for r in dup.groups(pages).collect()}
    assert set(got) == set(texts)
    together = lambda column: sorted(sorted(b for b in got if got[b][column] == k) for k in {r[column] for r in got.values()})
    assert together("group_id") == [["a", "b"], *[[b] for b in "cdefghijk"]]
    assert together("class_id") == [["a"], ["b"], ["c", "d"], ["e"], ["f", "g"], ["h", "i"], ["j"], ["k"]]
    assert {b: r.links for b, r in got.items() if r.links} == {"a": 1, "b": 1}
    assert {tuple(r) for r in dup.similar_books(pages).collect()} == {("a", "b")}
