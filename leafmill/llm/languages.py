"""Languages of documents and of the passages of mixed-language text.

Script ranges narrow the candidates of each word (a word of one script is charged a fixed amount
under languages of another). Words known to the model score by their smoothed probability in each
language, unknown ones by their character trigrams. Viterbi over the words, with a switching
penalty that is lower where a sentence or line begins, labels the spans; all texts of a block are
decoded side by side, one array step for the n-th word of each. Long texts are cut into lanes of
``LANE`` words, one for each state that the lane before may end in, and the lanes are chained: the
path is the same, in as many steps as a lane has words.

Beside the seven languages there is a state ``other``, which likes unknown words nearly as well as
the best language does; a long span of few known words is ``other`` too. It is never a finding.

The model is fitted in one task from a bounded sample of current pages (``SAMPLE_PAGES`` pages,
``SAMPLE_CHARS`` characters; labels may be wrong: segments are labelled again by the model and
counted again, ``ROUNDS`` times), and is as large as that sample's vocabulary. A span's confidence is
scaled so that what half of its words say predicts what the other half says, on the same
sample. Everything else covers all rows.

Defined cases: null, empty and blank texts, and texts without letters, have no span; ties go to the
language that comes first in ``LANGUAGES``; the latest row of a page counts; other columns are not read.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import kernel
from leafmill.tables import current_rows, updated

LANGUAGES = ("id", "en", "ar", "ru", "fr", "tr", "ur")
#: Letters that make a stretch of another language a finding.
LEAST_LETTERS = 40
#: The name of all other languages.
OTHER = "other"
STATES = len(LANGUAGES) + 1
#: The fit: pages and characters in the sample at most, and rounds of relabelling.
SAMPLE_PAGES, SAMPLE_CHARS, ROUNDS = 8_000, 40_000_000, 3
#: Words of a lane of the decoder.
LANE = 4_096
#: The first and last code points of scripts, and the languages written in them.
SCRIPTS = (
    ((0x0041, 0x024F), ("id", "en", "fr", "tr")),
    ((0x1E00, 0x1EFF), ("id", "en", "fr", "tr")),
    ((0x0400, 0x052F), ("ru",)),
    ((0x0600, 0x06FF), ("ar", "ur")),
    ((0x0750, 0x077F), ("ar", "ur")),
    ((0xFB50, 0xFDFF), ("ar", "ur")),
    ((0xFE70, 0xFEFF), ("ar", "ur")),
)
#: Costs in log-probability: of a switch between words, of one where a sentence or line begins, and
#: of a word in another language's script.
SWITCH, SWITCH_AT_START, OTHER_SCRIPT = 9.0, 3.0, 8.0
_SPREAD, _UNKNOWN = 6.0, 1.5
#: Costs of a known and of an unknown word in another language; words of a span (of some length at most) and the
#: share of known ones below which the span is of another language.
OTHER_KNOWN, OTHER_UNKNOWN, OTHER_WORDS, OTHER_LENGTH, OTHER_SHARE = 4.0, 1.0, 8, 20, 0.25
_GRAMS = 1 << 15
_STOPS = "\n.!?…؟۔:;"


@functools.lru_cache(None)
def _letters() -> np.ndarray:
    return kernel.categories() == ord("L")


@functools.lru_cache(None)
def _stops() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in _STOPS]] = True
    return table


@functools.lru_cache(None)
def _script() -> np.ndarray:
    """Per code point, the bits of the languages it may belong to (all, if it is of no known script)."""
    every = (1 << len(LANGUAGES)) - 1
    table = np.full(0x110000, every, np.uint8)
    for (a, b), languages in SCRIPTS:
        table[a : b + 1] = sum(1 << LANGUAGES.index(x) for x in languages)
    return table


class Words:
    """The words of a block of texts: bounds, hashes, letters, allowed languages, sentence starts."""

    def __init__(self, texts: list[str | None]):
        self.cp, starts, ends = kernel.encode([t.lower() if t else t for t in texts])
        self.start, self.end = kernel.runs(kernel.word_chars()[self.cp])
        self.hash = kernel.span_hashes(self.cp, self.start, self.end)
        self.first, self.last = np.searchsorted(self.start, starts), np.searchsorted(self.start, ends)
        self.offset = starts
        letters = np.concatenate([[0], np.cumsum(_letters()[self.cp])])
        self.letters = letters[self.end] - letters[self.start]
        stops = np.concatenate([[0], np.cumsum(_stops()[self.cp])])
        before = np.concatenate([[0], self.end[:-1]]) if len(self.start) else self.start
        self.opens = stops[self.start] > stops[before]
        # The script of a word is that of its first letter.
        self.script = _script()[self.cp[self.start]] if len(self.start) else np.empty(0, np.uint8)


def _grams(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the spans, with their bounds as a space, and where each span's begin."""
    size = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(at[-1], 32, np.uint32)
    inner = np.arange((ends - starts).sum()) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
    flat[np.repeat(at[:-1] + 1, ends - starts) + inner] = cp[np.repeat(starts, ends - starts) + inner]
    x = flat.astype(np.uint64)
    h = x.copy()
    h[:-1] += x[1:] * np.uint64(0x1F123BB5)
    h[:-2] += x[2:] * np.uint64(0x3C6EF372FE94F82B)
    return (kernel.mix(h) & np.uint64(_GRAMS - 1)).astype(np.int64), at


class Model:
    """Word and trigram scores of each language, and the scale of confidences."""

    def __init__(self, hashes: np.ndarray, scores: np.ndarray, grams: np.ndarray, scale: float = 1.0):
        self.hashes, self.scores, self.grams, self.scale = hashes, scores.astype(np.float32), grams.astype(np.float32), scale

    def word_scores(self, w: Words) -> np.ndarray:
        """For each word and state, a score (0 for the best language of a known word); sets the words' ``known``."""
        kinds, at, number = np.unique(w.hash, return_index=True, return_inverse=True)
        out = np.zeros((len(kinds), STATES), np.float32)
        known = np.zeros(len(kinds), bool)
        if len(kinds) and len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, kinds), len(self.hashes) - 1)
            known = self.hashes[place] == kinds
            out[known, :-1] = self.scores[place[known]]
            out[known, -1] = -OTHER_KNOWN
        new = np.flatnonzero(~known)
        if len(new):
            starts, ends = w.start[at[new]], w.end[at[new]]
            grams, bounds = _grams(w.cp, starts, ends)
            total = np.add.reduceat(self.grams[grams], bounds[:-1], axis=0)
            total -= total.max(1, keepdims=True)
            # A long run without white space has the weight of the words in it.
            weight = np.maximum(1, (ends - starts) / 12)
            out[new, :-1] = np.maximum(total, -_UNKNOWN * weight[:, None])
            out[new, -1] = -OTHER_UNKNOWN * weight
        bits = w.script[at]
        for k in range(len(LANGUAGES)):
            out[(bits >> k) & 1 == 0, k] -= OTHER_SCRIPT
        out[w.letters[at] == 0] = 0
        w.known = known[number]
        return out[number]

    def decode(self, texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words, each word's language by Viterbi, and the words' scores."""
        w = Words(texts)
        scores = self.word_scores(w)
        label = np.zeros(len(w.hash), np.int8)
        cost = np.where(w.opens, SWITCH_AT_START, SWITCH).astype(np.float32)
        first, size, init, chains = _lanes(w, scores, cost)
        order = np.argsort(-size, kind="stable")
        first, size, value = first[order], size[order], init[order]
        if not len(order):
            return w, label, scores
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # lanes longer than t
        stays, froms = [], []
        for t in range(1, size[0]):
            k = active[t]
            at = first[:k] + t
            v = value[:k]
            best = v.argmax(1)
            change = v[np.arange(k), best] - cost[at]
            stay = v >= change[:, None]
            value[:k] = np.where(stay, v, change[:, None]) + scores[at]
            stays.append(stay)
            froms.append(best.astype(np.int8))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        state = value.argmax(1)
        chosen = np.ones(len(order), bool)
        for chain in chains:
            # Each part but the first has a lane for every state before it; the best way through is taken.
            total, ways = value[place[chain[0][0]]], []
            for part in chain[1:]:
                each = total[:, None] + value[place[part]]
                ways.append(each.argmax(0))
                total = each.max(0)
                chosen[place[part]] = False
            end = int(total.argmax())
            for part, way in zip(reversed(chain[1:]), reversed(ways)):
                lane = place[part[way[end]]]
                chosen[lane], state[lane] = True, end
                end = int(way[end])
            state[place[chain[0][0]]] = end
        own = np.flatnonzero(chosen)
        state, first, size = state[own], first[own], size[own]
        label[first + size - 1] = state
        live = np.searchsorted(-size, -np.arange(size[0]), side="left")
        for t in range(size[0] - 1, 0, -1):
            k = live[t]
            rows = own[:k]
            state[:k] = np.where(stays[t - 1][rows, state[:k]], state[:k], froms[t - 1][rows])
            label[first[:k] + t - 1] = state[:k]
        return w, label, scores

    def stretches(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, language, letters) of each stretch: spans of one language, across quoted words of others."""
        s = self.spans(texts)
        keep = ~s["quoted"]
        text, language, letters = s["text"][keep], s["language"][keep], s["letters"][keep]
        if not len(text):
            return text, language, letters
        begin = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (language[1:] != language[:-1])]))
        return text[begin], language[begin], np.add.reduceat(letters, begin)

    def spans(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """Spans in order: text, start and end (characters), language, letters, confidence, quoted."""
        w, label, scores = self.decode(texts)
        n = len(label)
        if not n:
            return {k: np.empty(0, np.int64) for k in ("text", "start", "end", "language", "letters")} | {"confidence": np.empty(0), "quoted": np.empty(0, bool)}
        new = np.ones(n, bool)
        new[1:] = label[1:] != label[:-1]
        size = w.last - w.first
        new[w.first[size > 0]] = True
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], n)
        text = np.repeat(np.arange(len(texts)), size)[begin]
        letters = np.add.reduceat(w.letters, begin)
        language = label[begin].astype(np.int64)
        total = np.add.reduceat(scores, begin, axis=0).astype(np.float64)
        # Words of one span aren't independent evidence: the log odds grow with the root of their number.
        total *= self.scale / np.sqrt(stop - begin)[:, None]
        odds = np.exp(total - total.max(1, keepdims=True))
        confidence = (odds / odds.sum(1, keepdims=True))[np.arange(len(begin)), language]
        if len(self.hashes):
            # Few known words in a long span: what its script or its trigrams suggest is not what it is. Numbers and
            # runs of words without white space say nothing.
            fair = (w.letters > 0) & (w.end - w.start <= OTHER_LENGTH)
            fairs, known = np.add.reduceat(fair.astype(np.int64), begin), np.add.reduceat((fair & w.known).astype(np.int64), begin)
            language[(fairs >= OTHER_WORDS) & (known < OTHER_SHARE * fairs)] = STATES - 1
        keep = letters > 0
        # One or two words in quotation marks or brackets don't end the stretch around them.
        quoted = (stop - begin <= 2) & np.isin(w.cp[np.maximum(w.start[begin] - 1, 0)], [ord(c) for c in "«(\"'„“‘["])
        return {"quoted": quoted[keep], "text": text[keep], "start": (w.start[begin] - w.offset[text])[keep], "end": (w.end[stop - 1] - w.offset[text])[keep], "language": language[keep], "letters": letters[keep], "confidence": confidence[keep]}


def _lanes(w: Words, scores: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """First word, words and first values of each lane, and the lanes of each text that has several parts."""
    size = w.last - w.first
    short = np.flatnonzero((size > 0) & (size <= LANE))
    firsts, sizes, init, chains, n = [w.first[short]], [size[short]], [scores[w.first[short]]], [], len(short)
    for i in np.flatnonzero(size > LANE).tolist():
        chain = []
        for a in range(w.first[i], w.last[i], LANE):
            states = 1 if a == w.first[i] else STATES
            value = scores[a] + (np.where(np.eye(STATES, dtype=bool), 0, -cost[a]) if states > 1 else np.zeros((1, STATES), np.float32))
            firsts.append(np.full(states, a))
            sizes.append(np.full(states, min(LANE, w.last[i] - a)))
            init.append(value.astype(np.float32))
            chain.append(np.arange(n, n + states))
            n += states
        chains.append(chain)
    return np.concatenate(firsts), np.concatenate(sizes), np.concatenate(init), chains


def calibrated(model: Model, texts: list[str | None]) -> Model:
    """The model with the scale at which the odds of every other word of a span best predict what the rest says."""
    halves: list[list[np.ndarray]] = [[], []]
    counts = []
    for a, b in kernel.blocks(texts):
        w, label, scores = model.decode(texts[a:b])
        if not len(label):
            continue
        new = np.ones(len(label), bool)
        new[1:] = label[1:] != label[:-1]
        new[w.first[w.last > w.first]] = True
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(label)))
        odd = (np.arange(len(label)) - np.repeat(begin, size)) % 2 == 1
        some = size >= 2
        for k in (0, 1):
            halves[k].append(np.add.reduceat(scores * (odd == k)[:, None], begin, axis=0)[some])
        counts.append((size - size // 2)[some])
    if not counts:
        return model
    x, y, n = np.concatenate(halves[0]), np.concatenate(halves[1]).argmax(1), np.concatenate(counts)
    x = x / np.sqrt(n)[:, None]

    def fitness(scale: float) -> float:
        z = x * scale
        z = z - z.max(1, keepdims=True)
        return float((z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))).mean())

    model.scale = max((0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0, 1.25, 1.5, 2.0), key=fitness)
    return model


def _scores(counts: np.ndarray, total: np.ndarray, smooth: float) -> np.ndarray:
    s = np.log(counts + smooth) - np.log(total + smooth * max(1, len(counts)))
    s -= s.max(1, keepdims=True)
    return np.maximum(s, -_SPREAD)


def fit(texts: list[str | None], labels: list[int | None], rounds: int = ROUNDS) -> Model:
    """A model from texts with (partly wrong) labels; None is no label. Texts are held a block at a time."""
    m = len(LANGUAGES)
    parts = []
    for a, b in kernel.blocks(texts):
        w = Words(texts[a:b])
        size = w.last - w.first
        opens = w.opens.copy()
        opens[w.first[size > 0]] = True
        grams, bounds = _grams(w.cp, w.start, w.end) if len(w.start) else (np.empty(0, np.int64), np.zeros(1, np.int64))
        given = np.repeat(np.array([-1 if x is None else x for x in labels[a:b]], np.int8), size)
        parts.append({"hash": w.hash, "letters": w.letters > 0, "script": w.script, "segment": np.cumsum(opens) - 1, "grams": grams.astype(np.uint16), "per_word": np.diff(bounds).astype(np.int32), "given": given})
        del w
    hashes = np.concatenate([p["hash"] for p in parts]) if parts else np.empty(0, np.uint64)
    kinds, number = np.unique(hashes, return_inverse=True)
    number, ends = number.astype(np.int32), np.cumsum([len(p["hash"]) for p in parts])
    for p, end in zip(parts, ends):
        p["number"] = number[end - len(p["hash"]) : end]
        # A label counts for words of its scripts; scripts of a single language need no label.
        allowed = ((p["script"][:, None] >> np.arange(m)) & 1).astype(bool)
        own = np.maximum(p["given"], 0)
        label = np.where((p["given"] >= 0) & allowed[np.arange(len(own)), own], p["given"], -1)
        one = (p["script"] & (p["script"] - 1)) == 0
        label = np.where(one & p["letters"], np.log2(np.maximum(p["script"], 1)).astype(np.int8), label)
        label[~p["letters"]] = -1
        p["label"] = label.astype(np.int8)
    model = Model(kinds, np.zeros((len(kinds), m)), np.zeros((_GRAMS, m)))
    for r in range(rounds + 1):
        counts, gram_counts = np.zeros(len(kinds) * m), np.zeros(_GRAMS * m)
        for p in parts:
            ok = p["label"] >= 0
            counts += np.bincount(p["number"][ok].astype(np.int64) * m + p["label"][ok], minlength=len(counts))
            by_word = np.repeat(p["label"], p["per_word"])
            gram_counts += np.bincount(p["grams"][by_word >= 0].astype(np.int64) * m + by_word[by_word >= 0], minlength=len(gram_counts))
        counts, gram_counts = counts.reshape(-1, m), gram_counts.reshape(-1, m)
        scores = _scores(counts, counts.sum(0), 0.2)
        model = Model(kinds, scores, _scores(gram_counts, gram_counts.sum(0), 1.0) * 0.5)
        if r == rounds:
            break
        for p in parts:
            if not len(p["segment"]):
                continue
            allowed = ((p["script"][:, None] >> np.arange(m)) & 1).astype(bool)
            each = scores[p["number"]] - np.where(allowed, 0, OTHER_SCRIPT)
            each[~p["letters"]] = 0
            total = np.stack([np.bincount(p["segment"], each[:, k], p["segment"][-1] + 1) for k in range(m)], 1)
            label = np.where(p["letters"], total.argmax(1)[p["segment"]], -1).astype(np.int8)
            label[~allowed[np.arange(len(label)), np.maximum(label, 0)]] = -1
            p["label"] = label
    return model


def label(language: Column) -> Column:
    """The two-letter code with which a label begins, followed by ``-``, ``_`` or the end; else null."""
    return F.nullif(F.lower(F.regexp_extract(language, r"^([A-Za-z]{2})(?:[-_]|$)", 1)), F.lit(""))


def _labels(books: DataFrame) -> DataFrame:
    return current_rows(books.select("book_id", "language", "updated_at"), ["book_id"]).select("book_id", label(F.col("language")).alias("label"))


def fit_pages(pages: DataFrame, books: DataFrame, most: int = SAMPLE_PAGES, characters: int = SAMPLE_CHARS) -> Model:
    """The model fitted in one task on at most ``most`` current pages of ``characters`` characters, those with the least hashes of their keys."""
    key = F.xxhash64("book_id", "page_num")
    last = pages.select(key.alias("key")).distinct().orderBy("key").limit(most).agg(F.max("key")).first()[0]
    few = pages.select("book_id", "page_num", F.col("content").cast("string").alias("content"), "updated_at", key.alias("key")).where(F.col("key") <= F.lit(last))
    few = current_rows(few, ["book_id", "page_num"]).where("content <> ''").join(_labels(books), "book_id", "left")
    order = Window.orderBy("key", "book_id", "page_num").rowsBetween(Window.unboundedPreceding, 0)  # over the sample only
    rows = few.withColumn("so_far", F.sum(F.length("content")).over(order)).where(F.col("so_far") <= characters).select("key", "content", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {x: i for i, x in enumerate(LANGUAGES)}
        sample = sorted(((k, t, x) for batch in batches for k, t, x in zip(*[c.to_pylist() for c in batch.columns])), key=lambda r: (r[0], r[1]))
        texts = [t for _, t, _ in sample]
        model = calibrated(fit(texts, [code.get(x) for _, _, x in sample]), texts[::4])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit([], [])


def _mask(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        texts = batch.column(3).to_pylist()
        out = []
        for a, b in kernel.blocks(texts):
            text, language, letters = model.stretches(texts[a:b])
            mask = np.zeros(b - a, np.int64)
            long = letters >= LEAST_LETTERS
            np.bitwise_or.at(mask, text[long], np.left_shift(1, language[long]))
            out.append(mask)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.concatenate(out).astype(np.int32))], ["book_id", "page_num", "at", "mask"])


def _keys(pages: DataFrame) -> DataFrame:
    return pages.select("book_id", "page_num", updated().alias("at"), F.col("content").cast("string").alias("content"))


def page_languages(pages: DataFrame, model: Model) -> DataFrame:
    """book_id, page_num, mask: for each current page the languages of its long spans, as bits.

    The texts never leave their scan; what is shuffled to settle the latest row is two numbers a page.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = _keys(pages)
    kind = rows.schema["page_num"].dataType.simpleString()
    masks = rows.mapInArrow(functools.partial(_mask, shared), f"book_id string, page_num {kind}, at timestamp_ntz, mask int")
    return masks.groupBy("book_id", "page_num").agg(F.max_by("mask", "at").alias("mask"))


def mislabelled(pages: DataFrame, books: DataFrame, model: Model | None = None) -> DataFrame:
    """book_id, page_num, language: each page and language of a long span that isn't the book's label."""
    model = model or fit_pages(pages, books)
    found = page_languages(pages, model).where("mask <> 0")
    rows = found.join(_labels(books), "book_id", "left")
    each = F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(x)) for i, x in enumerate(LANGUAGES)])
    return rows.select("book_id", "page_num", "label", F.explode(F.array_compact(each)).alias("language")).where(~F.col("language").eqNullSafe(F.col("label"))).select("book_id", "page_num", "language")


def _spans(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = shared.value
    names = np.array([*LANGUAGES, OTHER])
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in kernel.blocks(texts):
            s = model.spans(texts[a:b])
            rows = pa.array(s["text"] + a)
            number = np.arange(len(s["text"])) - np.searchsorted(s["text"], s["text"])
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number.astype(np.int32)), pa.array(s["start"].astype(np.int32)), pa.array(s["end"].astype(np.int32)), pa.array(names[s["language"]] if len(number) else [], pa.string()), pa.array(s["letters"].astype(np.int32)), pa.array(np.floor(s["confidence"] * 1e4 + 0.5) / 1e4)]
            yield pa.RecordBatch.from_arrays(columns, ["book_id", "page_num", "span", "start", "stop", "language", "letters", "confidence"])


def passages(pages: DataFrame, books: DataFrame, model: Model | None = None) -> DataFrame:
    """Every span of every current page: its bounds in characters, language, letters and confidence."""
    model = model or fit_pages(pages, books)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = current_rows(pages.select("book_id", "page_num", "content", "updated_at"), ["book_id", "page_num"]).drop("updated_at").select("book_id", "page_num", F.col("content").cast("string"))
    kind = rows.schema["page_num"].dataType.simpleString()
    return rows.mapInArrow(functools.partial(_spans, shared), f"book_id string, page_num {kind}, span int, start int, stop int, language string, letters int, confidence double")


def book_languages(pages: DataFrame, books: DataFrame, model: Model | None = None) -> DataFrame:
    """book_id, label, language, confidence: each book's language by the letters written in it.

    Letters are summed a page and language first (map-side), so a book of any length is no hot group.
    The confidence is the language's share of the letters times the spans' mean confidence.
    """
    spans = passages(pages, books, model)
    by = spans.groupBy("book_id", "language").agg(F.sum("letters").alias("letters"), F.sum(F.col("letters") * F.col("confidence")).alias("sure"))
    rank = F.struct("letters", *[(F.col("language") == x).cast("int") for x in (*LANGUAGES, OTHER)])
    best = by.groupBy("book_id").agg(F.max_by("language", rank).alias("language"), F.max_by("sure", rank).alias("sure"), F.sum("letters").alias("total"))
    return _labels(books).join(best, "book_id", "left").select("book_id", "label", "language", (F.floor(F.col("sure") / F.col("total") * 1e4 + 0.5) / 1e4).alias("confidence"))
