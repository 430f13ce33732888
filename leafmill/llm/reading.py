"""Reading level of each document, from the levels of its sentences.

Every sentence is classified by a softmax model over its words, its words' character trigrams, its
words' lengths and its own length, all hashed, with ridge regularisation. The distribution over a
document's sentences, with a few of its lengths, goes into a second, small softmax model that is
fitted on documents whose sentences the first model did not see, so that its probabilities are
calibrated.

The classifier is fitted from at most ``MOST_LABELLED`` labelled documents of ``MOST_CHARS`` characters
together, chosen by a hash of doc_id; a document's target is the distribution of its raters' distinct
valid votes. The two halves of that sample are fitted side by side in tasks; the driver gets their
weights and a few numbers a document, and no text. Features are kept a distinct word, so both fitting
and scoring look up each word of a block once. Scoring reads each text once, with no shuffle; the
model's size is fixed (``DIMENSION``).

Defined cases: null, empty and short texts (under ``LEAST_WORDS`` words) get no row; labels that are
null or out of range are ignored, repeated ones count once; without any valid label no document
gets a level; ties go to the lower level; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import kernel
from leafmill.work import stage

LEVELS, LEAST_WORDS = 4, 40
MOST_LABELLED, MOST_CHARS, DIMENSION = 6_000, 60_000_000, 1 << 17
#: Features of a document in the second model.
FEATURES = 23
_RIDGE, _STEPS, _RATE = 2e-4, 60, 0.5
_STOPS = ".!?…؟۔"


@functools.lru_cache(None)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stops, commas = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    stops[[ord(c) for c in _STOPS]] = True
    commas[[ord(c) for c in ",،;:؛"]] = True
    script = np.zeros(0x110000, np.uint8)  # of little weight: other scripts share a class
    script[0x0041:0x0250] = 1
    script[0x0400:0x0530] = 2
    script[0x0600:0x0700] = 3
    return stops, commas, script


class Sentences:
    """Hashed features of each sentence of a block of texts."""

    def __init__(self, texts: list[str | None]):
        stops, commas, script = _tables()
        cp, starts, ends = kernel.encode([t.lower() if t else t for t in texts])
        s, e = kernel.runs(kernel.word_chars()[cp])
        first, last = np.searchsorted(s, starts), np.searchsorted(s, ends)
        self.words = last - first
        # A sentence ends at a stop before white space, or at an empty line or the end of a line that ends in a stop.
        white = np.isin(cp, [9, 10, 13, 32])
        end = np.zeros(len(cp), bool)
        end[:-1] = stops[cp[:-1]] & (white[1:] | np.isin(cp[1:], [ord(c) for c in "\"'»”’)"]))
        end[:-1] |= (cp[:-1] == 10) & (cp[1:] == 10)
        count = np.concatenate([[0], np.cumsum(end)])
        owner = np.repeat(np.arange(len(texts)), self.words)
        number = count[s] if len(s) else np.empty(0, np.int64)
        new = np.ones(len(s), bool)
        new[1:] = (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(s)))
        keep = size >= 2
        self.text, self.size = owner[begin[keep]], size[keep]
        chosen = np.repeat(keep, size)
        s, e = s[chosen], e[chosen]
        length = e - s
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64) if len(self.size) else np.empty(0, np.int64)
        self.letters = np.add.reduceat(length, self.begin) if len(self.begin) else np.empty(0, np.int64)
        comma = np.concatenate([[0], np.cumsum(commas[cp])])
        stop = self.begin + self.size - 1
        self.commas = comma[e[stop]] - comma[s[self.begin]] if len(self.begin) else np.empty(0, np.int64)
        kind = script[cp[s]] if len(s) else np.empty(0, np.uint8)
        self.script = kind[self.begin] if len(self.begin) else np.empty(0, np.uint8)
        # Features are listed a distinct word: the word, its trigrams with a space at either end, its length.
        kinds, at, self.number = np.unique(kernel.span_hashes(cp, s, e), return_index=True, return_inverse=True)
        grams, bounds = _trigrams(cp, s[at], e[at]) if len(at) else (np.empty(0, np.uint64), np.zeros(1, np.int64))
        wide = kernel.mix(np.minimum(length[at], 20).astype(np.uint64) * np.uint64(8) + kind[at]) ^ np.uint64(0xC3)
        self.parts = np.concatenate([[0], np.cumsum(np.diff(bounds) + 2)]).astype(np.int64)
        features = np.empty(self.parts[-1], np.uint64)
        features[self.parts[:-1]], features[self.parts[:-1] + 1] = kinds, wide
        inner = np.ones(len(features), bool)
        inner[self.parts[:-1]] = inner[self.parts[:-1] + 1] = False
        features[inner] = grams
        self.features = (features & np.uint64(DIMENSION - 1)).astype(np.int64)
        bucket = np.minimum(self.size, 40).astype(np.uint64)
        own = [kernel.mix(bucket * np.uint64(8) + self.script) ^ np.uint64(0xD4), kernel.mix((bucket >> np.uint64(1)) + np.uint64(1000)) ^ np.uint64(0xE5), kernel.mix(np.minimum(self.commas, 6).astype(np.uint64) * np.uint64(8) + self.script + np.uint64(5000))]
        self.own = (np.stack(own, 1) & np.uint64(DIMENSION - 1)).astype(np.int64) if len(self.size) else np.empty((0, 3), np.int64)

    @functools.cached_property
    def share(self) -> np.ndarray:
        """What each feature of a word counts for: the word itself and its length in full, its trigrams together as one."""
        size = np.diff(self.parts)
        share = np.repeat(1 / np.maximum(size - 2, 1), size)
        share[self.parts[:-1]] = share[self.parts[:-1] + 1] = 1
        return share.astype(np.float32)

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """Mean of the words' weights (by root of their number) and the sentence's own."""
        if not len(self.size):
            return np.empty((0, LEVELS), np.float32)
        words = np.add.reduceat(weights[self.features] * self.share[:, None], self.parts[:-1], axis=0)
        total = np.add.reduceat(words[self.number], self.begin, axis=0)
        return total / np.sqrt(self.size)[:, None] + weights[self.own].sum(1)


def _trigrams(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the trigrams of each span, padded with a space at either end, and where each span's begin."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 2)])
    flat = np.full(at[-1] + 2, 32, np.uint64)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(at[:-1] + 1, size) + inner] = cp[np.repeat(starts, size) + inner]
    grams = kernel.mix(flat[:-2] + flat[1:-1] * np.uint64(0x1F123BB5) + flat[2:] * np.uint64(0x3C6EF372FE94F82B)) ^ np.uint64(0xA1)
    keep = np.ones(at[-1], bool)
    keep[at[1:] - 1] = keep[at[1:] - 2] = False  # those that go over a span's end
    return grams[keep], np.concatenate([[0], np.cumsum(size)])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _fit_sentences(s: Sentences, target: np.ndarray) -> np.ndarray:
    """Weights by full-batch Adagrad on the ridge-regularised cross-entropy."""
    weights = np.zeros((DIMENSION, LEVELS), np.float32)
    if not len(s.size):
        return weights
    scale = np.repeat(1 / np.sqrt(s.size), s.size)[:, None].astype(np.float32)
    owner = np.repeat(np.arange(len(s.size)), s.size)
    tokens = np.argsort(s.number, kind="stable")
    first = np.flatnonzero(np.diff(s.number[tokens], prepend=-1))
    index = np.concatenate([s.features, s.own.ravel()])
    factor = np.concatenate([s.share, np.ones(s.own.size, np.float32)])[:, None]
    order = np.argsort(index, kind="stable")
    begin = np.flatnonzero(np.diff(index[order], prepend=-1))
    used = index[order][begin]
    squares = np.full((len(used), LEVELS), 1e-8, np.float32)
    words = np.repeat(np.arange(len(s.parts) - 1), np.diff(s.parts))
    for _ in range(_STEPS):
        wrong = (softmax(s.logits(weights)) - target).astype(np.float32) / len(s.size)
        by_word = np.add.reduceat((wrong[owner] * scale)[tokens], first, axis=0)
        each = np.concatenate([by_word[words], np.repeat(wrong, 3, axis=0)]) * factor
        step = np.add.reduceat(each[order], begin, axis=0) + _RIDGE * weights[used] / len(used)
        squares += step**2
        weights[used] -= _RATE * 0.2 * step / np.sqrt(squares)
    return weights


def _documents(s: Sentences, p: np.ndarray, n: int) -> np.ndarray:
    """Features of each text: the distribution of its sentences' levels, and lengths."""
    count = np.bincount(s.text, minlength=n)
    mean = lambda x: np.bincount(s.text, x, n) / np.maximum(count, 1)
    shares = [mean(p[:, k]) for k in range(LEVELS)]
    # Weighted by words, long sentences count more.
    weight = s.size.astype(np.float64)
    total = np.maximum(np.bincount(s.text, weight, n), 1)
    heavy = [np.bincount(s.text, weight * p[:, k], n) / total for k in range(LEVELS)]
    long = np.log1p(total / np.maximum(count, 1))
    letters = np.bincount(s.text, s.letters, n) / total
    rate = mean(s.commas.astype(np.float64))
    kind = [mean((s.script == k).astype(np.float64)) for k in (1, 2, 3)]
    return np.stack([np.ones(n), *shares, *heavy, *[np.log(x + 0.02) for x in shares], long, long**2, letters / 5, rate, *kind, *[k * long for k in kind]], 1)


def _fit_documents(x: np.ndarray, target: np.ndarray, steps: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Softmax regression on standardised features, by gradient descent with momentum."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    mean[0], spread[0] = 0, 1
    z = (x - mean) / spread
    w, v = np.zeros((x.shape[1], LEVELS)), np.zeros((x.shape[1], LEVELS))
    for _ in range(steps):
        v = 0.9 * v - 0.3 * (z.T @ (softmax(z @ w) - target) / max(1, len(z)) + 1e-3 * w)
        w = w + v
    return w, mean, spread


class Model:
    """Sentence weights (of two halves of the labelled documents) and the document model."""

    def __init__(self, halves: list[np.ndarray], document: tuple[np.ndarray, np.ndarray, np.ndarray]):
        # Logits are linear in the weights, so the mean of both halves' logits is that of their mean weights.
        self.weights, self.document = np.mean(halves, axis=0).astype(np.float32), document

    def levels(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the probabilities of the levels, and the number of words."""
        s = Sentences(texts)
        p = softmax(s.logits(self.weights)) if len(s.size) else np.empty((0, LEVELS))
        w, mean, spread = self.document
        return softmax((_documents(s, p, len(texts)) - mean) / spread @ w), s.words


def fit(texts: list[str | None], votes: np.ndarray) -> Model:
    """The model from texts and their distributions of votes (rows that sum to one), in one process."""
    half = np.arange(len(texts)) % 2
    parts = [[t for t, h in zip(texts, half) if h == k] for k in (0, 1)]
    weights = [fit_half(parts[k], votes[half == k]) for k in (0, 1)]
    features = [seen_by(parts[k], weights[1 - k]) for k in (0, 1)]
    return Model(weights, _fit_documents(np.concatenate(features), np.concatenate([votes[half == k] for k in (0, 1)])))


def fit_half(texts: list[str | None], votes: np.ndarray) -> np.ndarray:
    s = Sentences(texts)
    return _fit_sentences(s, votes[s.text] if len(texts) else votes)


def seen_by(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """The document features of texts by a sentence model that did not see them."""
    s = Sentences(texts)
    return _documents(s, softmax(s.logits(weights)), len(texts))


def votes(labels: DataFrame) -> DataFrame:
    """doc_id, v1 to v4: shares of the distinct valid votes (a rater's equal votes count once)."""
    valid = labels.select(F.col("doc_id").cast("long"), "rater", F.col("level").cast("int")).where(f"doc_id IS NOT NULL AND level BETWEEN 1 AND {LEVELS}").distinct()
    return valid.groupBy("doc_id").agg(*[F.avg((F.col("level") == k).cast("double")).alias(f"v{k}") for k in range(1, LEVELS + 1)])


def fit_tables(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, characters: int = MOST_CHARS) -> Model | None:
    """The model from at most ``most`` labelled documents of ``characters`` characters together; None without any.

    Repeated documents count once, by their longest text.
    """
    marks = [f"v{k}" for k in range(1, LEVELS + 1)]
    chosen = votes(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", *marks).agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over the sample only
    kept = rows.select("doc_id", F.length("text").alias("n")).select("doc_id", (F.row_number().over(order) % 2).alias("half"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far")).where(F.col("so_far") <= characters)
    sample = stage(rows.join(F.broadcast(kept.select("doc_id", "half")), "doc_id"), "labelled")

    def each(work) -> list:
        """``work`` on the texts and votes of each half, in a task of its own: (half, what it gives)."""

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id")
            return pd.DataFrame({"half": [key[0]], "data": [work(int(key[0]), pdf["text"].tolist(), pdf[marks].to_numpy())]})

        return sample.groupBy("half").applyInPandas(run, "half int, data binary").collect()

    weights = {r.half: np.frombuffer(r.data, np.float32).reshape(DIMENSION, LEVELS) for r in each(lambda half, texts, v: fit_half(texts, v).tobytes())}
    if not weights:
        return None
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    seen = each(lambda half, texts, v: np.hstack([seen_by(texts, shared.value.get(1 - half, shared.value[half])), v]).astype(np.float64).tobytes())
    table = np.concatenate([np.frombuffer(r.data).reshape(-1, FEATURES + LEVELS) for r in sorted(seen, key=lambda r: r.half)])
    return Model([weights[h] for h in sorted(weights)], _fit_documents(table[:, :FEATURES], table[:, FEATURES:]))


def _score(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in kernel.blocks(texts):
            p, words = model.levels(texts[a:b])
            keep = np.flatnonzero(words >= LEAST_WORDS)
            p = np.floor(p[keep] * 1e4 + 0.5) / 1e4
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep + a)), pa.array((p.argmax(1) + 1).astype(np.int32)), *[pa.array(p[:, k]) for k in range(LEVELS)], pa.array(words[keep].astype(np.int32))], ["doc_id", "level", "p1", "p2", "p3", "p4", "words"])


def reading_levels(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, level, p1 to p4 (probabilities), words: each document of some length."""
    schema = "doc_id long, level int, p1 double, p2 double, p3 double, p4 double, words int"
    model = model or fit_tables(documents, labels)
    spark = documents.sparkSession
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(functools.partial(_score, shared), schema)


def profile(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """source, level, documents, words: the corpus by how demanding its texts are."""
    levels = reading_levels(documents, labels, model).select("doc_id", "level", "words")
    return documents.select("doc_id", "source").join(levels, "doc_id").groupBy("source", "level").agg(F.count("*").alias("documents"), F.sum("words").alias("words"))
