"""The best earlier row for each row of a group, by SimHash and title, as Arrow functions over sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Rows to look at together, at least; pairs to look at together, at most; rows from which a group is compared as a rectangle.
ROWS, PAIRS, WIDE = 1 << 16, 1 << 21, 256


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows in tables that end where the (sorted) key changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS:
            continue
        other = np.flatnonzero(batch.column(key).to_numpy() != batch.column(key)[-1].as_py())
        if len(other):
            cut = int(other[-1]) + 1
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def near_rows(values: np.ndarray, begin: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """i, j in order: rows with all rows before them in their group, which starts at ``begin``, whose values differ in at most so many bits."""
    before = np.arange(len(values)) - begin
    total = np.concatenate([[0], np.cumsum(before)])
    at = 0
    while at < len(values):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        first = begin[at]
        if before[at] >= WIDE and begin[stop - 1] == first:
            i, j = np.nonzero(np.bitwise_count(values[at:stop, None] ^ values[None, first:stop]) <= bits)
            i, j = i + at, j + first
            own = j < i
        else:
            i = np.repeat(np.arange(at, stop), before[at:stop])
            j = np.arange(len(i)) - (total[i] - total[at]) + begin[i]
            own = np.bitwise_count(values[i] ^ values[j]) <= bits
        yield i[own], j[own]
        at = stop


def greatest(i: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Where the first greatest score of each i is; the rows come in order of i."""
    if not len(i):
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.diff(i, prepend=-1))
    hit = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, start), np.diff(start, append=len(i))))
    return hit[np.diff(i[hit], prepend=-1) != 0]


class Titles:
    """Sets of words (64-bit hashes, sorted) of rows."""

    def __init__(self, words: pa.ChunkedArray):
        lists = words.combine_chunks()
        flat = lists.flatten().to_numpy()
        self.n = np.diff(lists.offsets.to_numpy())
        self.begin = np.concatenate([[0], np.cumsum(self.n)])
        kinds, self.word = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(self.n)), self.n)
        self.kinds = max(1, len(kinds))
        self.code = row * self.kinds + self.word  # in order, as a row's words are
        # A bit a word: what two sets share is at most the bits they share, and words that fell on one bit.
        self.bits = np.zeros(len(self.n), np.uint64)
        np.bitwise_or.at(self.bits, row, np.uint64(1) << (flat.view(np.uint64) & np.uint64(63)))
        self.more = self.n - np.bitwise_count(self.bits)

    def most(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Jaccard similarities, or more."""
        shared = np.bitwise_count(self.bits[i] & self.bits[j]) + np.minimum(self.more[i], self.more[j])
        shared = np.minimum(shared, np.minimum(self.n[i], self.n[j]))
        return shared / (self.n[i] + self.n[j] - shared)

    def jaccard(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if not len(i):
            return np.zeros(0)
        n = self.n[i]
        end = np.cumsum(n)
        at = np.arange(end[-1]) + np.repeat(self.begin[i] - (end - n), n)
        sought = np.repeat(j, n) * self.kinds + self.word[at]
        place = np.minimum(np.searchsorted(self.code, sought), len(self.code) - 1)
        shared = np.add.reduceat((self.code[place] == sought).astype(np.int64), end - n)
        return shared / (n + self.n[j] - shared)


def best_earlier(bits: int, ratio: float, threshold: float | None = None, bonus: float = 0.08, least: float = 0.4) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """pos, at, score of the best earlier row of each row in its bucket; of equals the earliest.

    Rows: bucket, pos (sorted by both), simhash, lang (0: fits any), page_count. With a ``threshold`` titles count:
    rows have ``words`` and ``side`` (rows of one side are not compared, but for -1), and only pairs count that
    have at least ``least`` of their words in common and reach the threshold with the bonus for them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            bucket, pos, simhash, lang, count = (table.column(k).to_numpy() for k in ("bucket", "pos", "simhash", "lang", "page_count"))
            new = np.diff(bucket, prepend=bucket[0]) != 0
            begin = np.maximum.accumulate(np.where(new, np.arange(len(bucket)), 0))
            values = simhash.view(np.uint64)
            titles, side = (None, None) if threshold is None else (Titles(table.column("words")), table.column("side").to_numpy())
            for i, j in near_rows(values, begin, bits):
                if titles:
                    own = (side[i] < 0) | (side[i] != side[j])
                    i, j = i[own], j[own]
                own = (lang[i] == lang[j]) | (lang[i] == 0) | (lang[j] == 0)
                i, j = i[own], j[own]
                small, large = np.minimum(count[i], count[j]), np.maximum(count[i], count[j])
                own = (small <= 0) | (small / np.maximum(large, 1) >= ratio)
                i, j = i[own], j[own]
                score = 1.0 - np.bitwise_count(values[i] ^ values[j]) / 64.0
                if titles:
                    title = titles.most(i, j)
                    own = (title >= least) & (score + np.minimum(bonus, title * bonus) >= threshold)
                    i, j, score = i[own], j[own], score[own]
                    title = titles.jaccard(i, j)
                    score = np.minimum(1.0, score + np.minimum(bonus, title * bonus))
                    own = (title >= least) & (score >= threshold)
                    i, j, score = i[own], j[own], score[own]
                top = greatest(i, score)
                if len(top):
                    yield pa.RecordBatch.from_arrays([pa.array(pos[i[top]]), pa.array(pos[j[top]]), pa.array(score[top])], ["pos", "at", "score"])

    return run
