"""Near-duplicate books against brute force over all pairs; the bit-sliced parts against plain counts."""

import datetime as dt
import itertools
import random

import numpy as np
import pyarrow as pa
import regex

from leafmill.llm import duplicates as dup

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
T = dt.datetime(2024, 1, 1)
SCHEMA = "book_id string, page_num int, content string, updated_at timestamp_ntz"


def brute(pages):
    latest = {}
    for b, p, c, u in pages:
        if (b, p) not in latest or u > latest[b, p][0]:
            latest[b, p] = (u, c)
    texts = {}
    for (b, p), (_, c) in sorted(latest.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        texts.setdefault(b, []).append(c or "")
    sets = {}
    for b, parts in texts.items():
        w = WORD.findall("\n".join(parts).lower())
        if len(w) >= 50 and b:
            sets[b] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


def test_counters():
    rng = random.Random(1)
    planes = [rng.getrandbits(100) for _ in range(83)]
    counters = dup.add_planes(list(planes))
    counts = [sum(p >> i & 1 for p in planes) for i in range(100)]
    assert [sum((c >> i & 1) << k for k, c in enumerate(counters)) for i in range(100)] == counts
    total = dup._sum(dup.add_planes(planes[:40]), dup.add_planes(planes[40:]))
    assert [sum((c >> i & 1) << k for k, c in enumerate(total)) for i in range(100)] == counts
    for radius in (0, 30, 41, 42, 83, 200):
        assert dup.at_most(counters, radius, (1 << 100) - 1) == sum(1 << i for i, n in enumerate(counts) if n <= radius)


def test_near_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (6, 24), dtype=np.uint8)
    rows, group, side = [], [], []
    for g, size in enumerate([1, 2, 7, 40, 3, 1, 130]):
        for k in range(size):
            x = base[rng.integers(0, 6)].copy()
            x[rng.integers(0, 24, 8)] ^= rng.integers(0, 256, 8, dtype=np.uint8)
            rows.append(x)
            group.append(g)
            side.append(0 if g < 3 else 1 + (k >= size // 2))
    rows, group, side = np.array(rows), np.array(group), np.array(side)
    bits = np.unpackbits(rows, axis=1)
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if group[i] == group[j] and (side[i] != side[j] or side[i] == 0) and (bits[i] != bits[j]).sum() <= 60}
    a, b = dup.near_pairs(rows, group, side, 60)
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_segments_and_overlap():
    rng = np.random.default_rng(5)
    big = rng.integers(0, 2**64 - 1, 30_000, dtype=np.uint64)
    sets = {1: big, 2: np.concatenate([big[:20_000], rng.integers(0, 2**64 - 1, 9_000, dtype=np.uint64)])}
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([30_000, 200_000]), pa.array([dup._pack(sets[1]), dup._pack(sets[2])], pa.binary())], ["a", "b", "c"])
    parts = {(r["cls"], r["segment"]): (r["fold"], r["runs"]) for b in dup._segments([batch]) for r in b.to_pylist()}
    folds = {c: f for (c, _), (f, _) in parts.items()}
    assert folds == {1: 2, 2: 5}
    rows = [(1, 2, 5, s, [parts[1, s >> 3][1]], [parts[2, s][1]]) for s in range(32)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(4)] + [pa.array([r[i] for r in rows], pa.list_(pa.binary())) for i in (4, 5)], list("abcdef"))
    out = [r for b in dup._overlap([batch]) for r in b.to_pylist()]
    assert (sum(r["both"] for r in out), sum(r["either"] for r in out)) == (20_000, 39_000)


def make(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "سلامٌ", "X9"]
    text = lambda n: rng.choices(vocabulary, k=n)
    pages = []

    def book(name, words, per, blank=False):
        for p, i in enumerate(range(0, max(1, len(words)), per), 1):
            pages.append((name, p, rng.choice([" ", ", ", "\r\n"]).join(words[i : i + per]), T))
            if blank and p % 5 == 0:
                pages[-1] = (name, p, rng.choice([None, "", " . "]), T)

    for k in range(12):
        base = text(rng.choice([40, 49, 50, 60, 300, 900]))
        book(f"b{k}", base, rng.choice([7, 50, 1000]))
        for c in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0, 0.02, 0.05, 0.1, 0.15]))):
                i = rng.randrange(len(copy))
                copy[i : i + 1] = rng.choice([[], ["new"], [copy[i], "in"]])
            if rng.random() < 0.3:
                copy = copy[len(copy) // 2 :] + copy[: len(copy) // 2]
            book(f"c{k}_{c}", copy, rng.choice([11, 60, 1000]))
    long = text(1500)  # several chunks of one or two words a page, with empty pages
    book("long1", long, 3, blank=True)
    book("long2", long[:1400] + text(60), 2)
    book("long3", long, 9)
    pages += [("b0", 1, "old state " * 60, T - dt.timedelta(days=1)), pages[0], (None, 1, "a b c d " * 40, T), ("n", None, "a b c d e " * 30, T), ("z1", 1, "a " * 50, T), ("z2", 1, "a " * 70, T)]
    rng.shuffle(pages)
    return pages


def test_books(spark):
    for seed in (1, 2):
        pages = make(seed)
        frame = spark.createDataFrame(pages, SCHEMA).selectExpr("*", "1 as cls", "'k' as key", "'q' as runs", "2 as chunk")
        got = [tuple(r) for r in dup.similar_books(frame).collect()]
        fixed = [(b, -1 if p is None else p, c, u) for b, p, c, u in pages]
        assert len(got) == len(set(got)) and set(got) == brute(fixed)
    assert dup.similar_books(frame.limit(0)).count() == 0


def test_minima_of_several_chunks(spark):
    """A book's minima are the same however its text is cut into pages."""
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(600)]
    pages = [(name, i // per + 1, " ".join(words[i : i + per]), T) for name, per in (("a", 600), ("b", 3), ("c", 1), ("d", 5)) for i in range(0, 600, per)]
    whole, _ = dup.books(dup.chunks(spark.createDataFrame(pages, SCHEMA)))
    rows = whole.collect()
    assert len(rows) == 4 and len({bytes(r.minima) for r in rows}) == 1 and {r.words for r in rows} == {600}


def test_groups(spark):
    pages = make(1)
    rows = dup.groups(spark.createDataFrame(pages, SCHEMA)).collect()
    group = {r.book_id: r.group_id for r in rows}
    pairs = brute([(b, -1 if p is None else p, c, u) for b, p, c, u in pages])
    root = {b: b for b in group}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    assert {frozenset(k for k in group if find(k) == find(b)) for b in group} == {frozenset(k for k in group if group[k] == group[b]) for b in group}


def test_long_chain(spark):
    nodes = spark.range(200).withColumnRenamed("id", "cls")
    links = spark.range(150).selectExpr("id as a", "id + 1 as b")
    got = {r.cls: r.root for r in dup.components(nodes, links).collect()}
    assert got == {i: 0 if i <= 150 else i for i in range(200)}
