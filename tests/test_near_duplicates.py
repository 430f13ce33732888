"""Near duplicates of many records that are alike: every best is found, and what is shuffled grows with the records."""

import random

import numpy as np
import pyarrow as pa

from leafmill.operators import dedupe, matching

CATALOG = "pos string, book_id string, language string, title string, page_count int, content_hash string, text_hash string, simhash long"
WORDS = [f"kata{i}" for i in range(12)]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def alike(n, flips, seed=1):
    """Records with pages of their own, a common title word and SimHashes around one value."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        value = 0x5ED978C68F7A3CEE
        for bit in rng.sample(range(64), rng.randint(0, flips)):
            value ^= 1 << bit
        title = " ".join(["buku", *rng.sample(WORDS, rng.randint(0, 3))])
        rows.append((f"{i:05}", f"b{i}", rng.choice(["id", "en", "unknown"]), title, rng.randint(3, 9), f"c{i}", None, signed(value)))
    return rows


def brute(rows):
    want = {}
    for x in rows:
        best = None
        for y in rows:
            if y[0] >= x[0]:
                break
            if not (x[2] == y[2] or "unknown" in (x[2], y[2])) or min(x[4], y[4]) / max(x[4], y[4]) < 0.45:
                continue
            score, a, b = 1 - ((x[7] ^ y[7]) & (2**64 - 1)).bit_count() / 64, set(x[3].split()), set(y[3].split())
            titles = len(a & b) / len(a | b)
            bonus = score >= 0.8 and titles >= 0.4
            score = min(1.0, score + min(0.08, titles * 0.08)) if bonus else score
            if score >= 0.92 and (best is None or score > best[1]):
                best = (y[1], score, "text_similarity" + "+title" * bonus)
        if best:
            want[x[1]] = (best[0], int(best[1] * 10000 + 0.5) / 10000, best[2])
    return want


def found(spark, rows):
    pages = spark.createDataFrame([(r[0], f"{r[1]}-{i}") for r in rows for i in range(3)], "pos string, h string")
    got = dedupe.near_duplicates(spark.createDataFrame(rows, CATALOG), pages).collect()
    return {r.book_id: (r.duplicate_of, r.score, r.reason) for r in got}


def test_alike_records_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "TILE", 40, raising=False)
    rows = alike(300, 9)
    want = brute(rows)
    assert found(spark, rows) == want and len(want) > 100 and {v[2] for v in want.values()} == {"text_similarity", "text_similarity+title"}


def test_shuffle_grows_with_the_records(spark):
    """At four times as many alike records the pairs are sixteen times as many."""
    jvm = spark.sparkContext._gateway.jvm

    def written():
        done = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (done.apply(i) for i in range(done.size()))}

    sizes = []
    for n in (200, 800):
        before = written()
        assert found(spark, alike(n, 5, n))
        sizes.append(sum(v for k, v in written().items() if k not in before))
    assert sizes[1] < 6 * sizes[0]


def test_best_earlier_over_batches(monkeypatch):
    """Groups that reach over batches, are compared as rectangles or with others make no difference."""
    rng = random.Random(4)
    rows = sorted((rng.choice([1, 2, 2, 2, -9]), i, signed(0x5ED978C68F7A3CEE ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(8))), rng.choice([0, 5, 6]), rng.randint(0, 9)) for i in range(150))
    names = ["bucket", "pos", "simhash", "lang", "page_count"]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a : a + 7]], pa.int64()) for k in range(5)], names) for a in range(0, len(rows), 7)]
    want = {}
    for x in rows:
        fitting = [y for y in rows if y[0] == x[0] and y[1] < x[1] and (x[3] == y[3] or 0 in (x[3], y[3])) and (0 in (x[4], y[4]) or min(x[4], y[4]) / max(x[4], y[4]) >= 0.45)]
        near = [(((x[2] ^ y[2]) & (2**64 - 1)).bit_count(), y[1]) for y in fitting]
        if near and min(near)[0] <= 3:
            want[x[1]] = min(near)[1]
    for size, pairs, wide in ((1 << 16, 1 << 21, 256), (20, 60, 8), (1, 1, 1), (1, 500, 1000)):
        monkeypatch.setattr(matching, "ROWS", size)
        monkeypatch.setattr(matching, "PAIRS", pairs)
        monkeypatch.setattr(matching, "WIDE", wide)
        got = {}
        for out in matching.best_earlier(3, 0.45)(iter(batches)):
            got |= dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
        assert got == want and len(want) > 50


def test_titles():
    sets = [[-5, 3, 8], [3], [3, 8, 67, 131], [-5, 3, 8], [1, 65, 129]]
    titles = matching.Titles(pa.chunked_array([pa.array([[0], *sets], pa.list_(pa.int64())).slice(1)]))
    i, j = (np.array(k) for k in zip(*[(a, b) for a in range(5) for b in range(5)]))
    want = [len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) for a, b in zip(i, j)]
    assert titles.jaccard(i, j).tolist() == want and (titles.most(i, j) >= want).all()
