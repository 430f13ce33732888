"""Evaluation texts leaking into training text, by suffix arrays over the training shards.

Texts are normalised (HTML entities, NFKC, soft hyphens, zero-width characters, tatweel and Arabic
vowel signs dropped), and become sequences of word hashes. Every shard (a block of documents of
about a million characters) gets a suffix array over its words, sorted by prefix doubling to a
depth of 16 words. Every suffix of every test passage is binary-searched in it; the neighbours of
the place where it belongs hold its longest verbatim match, and the interval of suffixes that
begin with its first 12 words holds all documents that share such a run.

The corpus is read once, each shard's array is built once, and nothing is shuffled but the matches.
Test passages are held-out sets: they are broadcast in blocks of at most ``BLOCK_WORDS`` words, however
many there are, and each block is looked up in every shard of an Arrow batch before the next is loaded.

Defined cases: null, empty and short passages or texts (under 12 words) leak nothing; a repeated
document gives one row an item; item_id or doc_id null is an ordinary value, also when affected
documents are removed.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import kernel

#: Successive words that count as a leak, and words to which suffixes are sorted.
RUN, DEPTH = 12, 16
#: Words of test passages in one broadcast block (8 bytes each).
BLOCK_WORDS = 2_000_000
#: Soft hyphen, zero-width and invisible format characters, tatweel, Arabic vowel signs.
_DROPPED = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\u0640\u064b-\u065f\u0670\u06d6-\u06ed]+")


def normalised(text: str | None) -> str:
    """The text as it is compared; words are its longest runs of letters, marks and numbers."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _DROPPED.sub("", unicodedata.normalize("NFKC", text))
    return text.lower()


def suffix_array(words: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The suffixes' first words in the order of their first ``depth`` words (as integers)."""
    if not len(words):
        return np.empty(0, np.int64)
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    width = 1
    while width < depth:
        key = rank * (len(words) + 2)
        key[:-width] += rank[width:]  # beyond the end: 0, before any word
        order = np.argsort(key, kind="stable")
        step = np.empty(len(key), np.int64)
        step[0] = 1
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(step)
        width *= 2
        if rank[order[-1]] == len(words):
            return order
    return order if width > 1 else np.argsort(rank, kind="stable")


def _bound(words: np.ndarray, order: np.ndarray, tests: np.ndarray, at: np.ndarray, depth: int, upper: bool) -> np.ndarray:
    """For each test suffix, the first suffix whose first words are not less (upper: are greater)."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    n, m = len(words), len(tests)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        s, t = order[middle], at[open_]
        less = np.zeros(len(open_), bool)
        tied = np.arange(len(open_))
        for k in range(depth):
            i, j = s[tied] + k, t[tied] + k
            a_end, b_end = i >= n, j >= m
            a, b = words[np.minimum(i, n - 1)], tests[np.minimum(j, m - 1)]
            less[tied] = np.where(b_end, False, a_end | (a < b))
            tied = tied[~a_end & ~b_end & (a == b)]
            if not len(tied):
                break
        less[tied] = upper  # equal in all words
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


class Passages:
    """A block of test passages as one array of words, each followed by a word that is in no text."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        words, first, last = kernel.words([normalised(text) for _, text in items])
        parts, self.item, self.start = [], [], []
        position = 0
        for k, (a, b) in enumerate(zip(first, last)):
            if b - a < RUN:
                continue
            # Suffixes with fewer than RUN words left can't begin a run.
            self.start.append(position + np.arange(b - a - RUN + 1))
            self.item.append(np.full(b - a - RUN + 1, k))
            parts += [words[a:b], np.asarray([kernel.mix(np.asarray([k], np.uint64))[0] ^ np.uint64(0x5BF0)], np.uint64)]
            position += b - a + 1
        self.words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.start = np.concatenate(self.start) if self.start else np.empty(0, np.int64)
        self.item = np.concatenate(self.item) if self.item else np.empty(0, np.int64)
        self.ids = [i for i, _ in items]

    def matches(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, longest run in words, its place) of each pair that shares a run of RUN words."""
        none = (np.empty(0, np.int64),) * 4
        if not len(self.start) or not len(shard.order):
            return none
        words, order = shard.words, shard.order
        low, high = (_bound(words, order, self.words, self.start, RUN, upper) for upper in (False, True))
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return none
        count = high[hit] - low[hit]
        test = np.repeat(hit, count)
        at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[hit], count)]
        size = np.full(len(test), RUN)
        j = self.start[test]
        going = np.arange(len(test))
        while len(going):  # every hit is carried on to its full length
            a, b = at[going] + size[going], j[going] + size[going]
            same = (a < len(words)) & (b < len(self.words))
            same &= words[np.minimum(a, len(words) - 1)] == self.words[np.minimum(b, len(self.words) - 1)]
            going = going[same]
            size[going] += 1
        # Empty texts begin where the next one does.
        text = np.searchsorted(shard.first, at, side="right") - 1
        keys = text * len(self.ids) + self.item[test]
        best = np.lexsort((at, -size, keys))
        best = best[np.flatnonzero(np.diff(keys[best], prepend=-1))]
        return text[best], self.item[test[best]], size[best], at[best] - shard.first[text[best]]


class Shard:
    """The words of a block of texts and their suffix array; a word of its own ends each text, so that no run goes on in the next."""

    def __init__(self, texts: list[str | None]):
        words, first, last = kernel.words([normalised(t) for t in texts])
        shift = np.arange(len(texts))
        self.first, self.order = first + shift, np.empty(0, np.int64)
        self.words = np.empty(0, np.uint64)
        if len(words) >= RUN:
            place = np.arange(len(words)) + np.repeat(shift, last - first)
            self.words = kernel.mix(np.arange(len(words) + len(texts), dtype=np.uint64)) | np.uint64(1 << 63)
            self.words[place] = words
            self.order = suffix_array(self.words)


def passages(items: DataFrame, most: int = BLOCK_WORDS) -> Iterator[Passages]:
    """The test passages in blocks; they are read through an iterator, one block in memory."""
    block, size = [], 0
    for row in items.select("item_id", "passage").toLocalIterator():
        n = len((row.passage or "").split()) + 1
        if block and size + n > most:
            yield Passages(block)
            block, size = [], 0
        block.append((row.item_id, row.passage))
        size += n
    if block:
        yield Passages(block)


def leaks(documents: DataFrame, items: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, words, position: each document and item that share a run, with the longest."""
    context = documents.sparkSession.sparkContext
    shared = [context.broadcast(block) for block in passages(items, most)]
    found = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(functools.partial(_scan, shared), "doc_id long, item_id long, words int, position int")
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.max_by("position", F.struct("words", -F.col("position"))).alias("position"))


def _scan(shared: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        shards = [(a, Shard(texts[a:b])) for a, b in kernel.blocks(texts)]
        for one in shared:
            block = one.value
            for a, shard in shards:
                text, item, size, at = block.matches(shard)
                if len(text):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(text + a)), pa.array([block.ids[i] for i in item], pa.int64()), pa.array(size.astype(np.int32)), pa.array(at.astype(np.int32))], ["doc_id", "item_id", "words", "position"])
            if len(shared) > 1:
                one._value = None  # one block in memory; it is loaded from the worker's disk again


def cleaned(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without those that hold a passage: an anti join on the matches."""
    found = leaks(documents, items).select(F.col("doc_id").alias("__leaked")).distinct()
    return documents.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__leaked")), "left_anti")
