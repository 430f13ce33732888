"""Pairs of classes and the classes' members give all pairs of books."""

import datetime as dt
import itertools

from leafmill.operators import dedupe
from leafmill.plans import catalog_queries, text_queries

T = dt.datetime(2024, 1, 1)


def all_pairs(members, links):
    """Pairs of books with the value of their classes' link, or None within a class."""
    groups = {}
    for book, first in members.items():
        groups.setdefault(first, []).append(book)
    out = {p: None for g in groups.values() for p in itertools.combinations(sorted(g), 2)}
    return out | {tuple(sorted(p)): v for (a, b), v in links.items() for p in itertools.product(groups[a], groups[b])}


def test_simhash_classes(spark, tmp_path):
    hashes = {"a": 5, "b": 5, "c": 4, "d": 4, "e": 5, "f": -1, "g": -1, "h": 0, "i": 0, "j": None, "k": 1 << 40}
    rows = [(b, h, T) for b, h in hashes.items()] + [("f", 5, T - dt.timedelta(days=1))]
    spark.createDataFrame(rows, "book_id string, text_simhash long, updated_at timestamp_ntz").write.parquet(f"{tmp_path}/books.parquet")
    d = str(tmp_path)
    classes = {r.book_id: r for r in text_queries.simhash_classes(spark, d).collect()}
    assert {b: r.text_simhash for b, r in classes.items()} == hashes and (classes["e"].books, classes["h"].books, classes["j"].books) == (3, 1, 1)
    got = all_pairs({b: r.class_book for b, r in classes.items()}, {(r.book_a, r.book_b): r.distance for r in text_queries.simhash_hamming_pairs(spark, d).collect()})
    want = {(a, b): ((hashes[a] ^ hashes[b]) & (2**64 - 1)).bit_count() or None for a, b in itertools.combinations(sorted(hashes), 2) if hashes[a] and hashes[b]}
    assert got == {p: n for p, n in want.items() if n is None or n <= 5}


def test_page_classes(spark, tmp_path):
    sets = {"a": "xyz", "b": "xyz", "c": "xyzw", "d": "wxyz", "e": "q", "f": "", "g": "", "h": None}
    rows = [(b, i, x, T) for b, pages in sets.items() if pages is not None for i, x in enumerate([*pages, *pages[:1], None, ""])]
    pages = spark.createDataFrame(rows, "book_id string, page_num int, page_hash string, updated_at timestamp_ntz")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(b, T) for b in sets], "book_id string, updated_at timestamp_ntz").write.parquet(f"{tmp_path}/books.parquet")
    d = str(tmp_path)
    classes = {r.book_id: r for r in catalog_queries.page_jaccard_classes(spark, d).collect()}
    assert {b: (r.class_book, r.pages, r.books) for b, r in classes.items()} == {"a": ("a", 3, 2), "b": ("a", 3, 2), "c": ("c", 4, 2), "d": ("c", 4, 2), "e": ("e", 1, 1), "f": ("f", 0, 1), "g": ("g", 0, 1), "h": ("h", 0, 1)}
    got = all_pairs({b: r.class_book for b, r in classes.items()}, {(r.book_a, r.book_b): r.jaccard for r in catalog_queries.page_jaccard_pairs(spark, d).collect()})
    full = {b: set(p or "") for b, p in sets.items()}
    jaccard = {(a, b): len(full[a] & full[b]) / len(full[a] | full[b]) for a, b in itertools.combinations(sorted(sets), 2) if full[a] & full[b]}
    assert {p: v or 1 for p, v in got.items()} == jaccard
    assert dedupe.page_classes(pages.limit(0)).count() == 0
