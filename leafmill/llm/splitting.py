"""Splitting oversized items at natural boundaries: content-defined chunking with overlap.

A gear hash over the last 32 characters marks landmarks, one in 256 characters on average. Each
landmark snaps to the nearest paragraph end, else sentence end, else word end around it. A piece
ends at the first snapped landmark between its smallest and largest size, so an edit moves only
the cuts next to it; where no landmark lies in that window the best last natural boundary is
taken, and only where there is none the piece ends inside a word (``hard``).

Defined cases: null, empty and blank texts give no piece; texts within the limit give one piece;
repeated rows are settled before (the latest row of a key counts); other columns are not read.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import kernel
from leafmill.tables import updated

#: Characters of a piece at most and (where the text allows) at least, and of the overlap at most.
LIMIT, LEAST, OVERLAP = 1000, 400, 100
#: A landmark is where the hash's low bits are zero; how far it may snap, by kind of boundary.
_MASK, _WINDOW, _REACH = np.uint32(255), 32, {3: 160, 2: 100, 1: 40}
_WHITE = " \t\r\n"
_CLOSERS = "\"'»”’)]}"
_ENDERS = ".!?…؟۔。！？"
_KINDS = {3: "paragraph", 2: "sentence", 1: "word"}
PIECES = "array<struct<piece int, start int, stop int, overlap int, cut string>>"


@functools.lru_cache(None)
def _tables() -> dict[str, np.ndarray]:
    def marks(chars: str) -> np.ndarray:
        table = np.zeros(0x110000, bool)
        table[[ord(c) for c in chars]] = True
        return table

    return {"white": marks(_WHITE), "closer": marks(_CLOSERS), "ender": marks(_ENDERS), "gear": kernel.mix(np.arange(0x110000)).astype(np.uint32)}


def _plan(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: word starts, word ends, the kind of each end, and landmarks."""
    t = _tables()
    starts, ends = kernel.runs(~t["white"][cp])
    feeds = np.concatenate([[0], np.cumsum(cp == 10)])
    following = np.append(starts[1:], len(cp))
    last = cp[ends - 1]
    before = cp[np.maximum(ends - 2, 0)]
    sentence = t["ender"][last] | (t["closer"][last] & t["ender"][before])
    gap = feeds[following] - feeds[ends]
    kind = np.where((gap >= 2) | ((gap == 1) & sentence), 3, np.where(sentence, 2, 1)).astype(np.int8)
    h, width = t["gear"][cp], 1
    while width < _WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return starts, ends, kind, np.flatnonzero((h & _MASK) == 0) + 1


def _snap(marks: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where each landmark comes to lie; landmarks without a boundary in reach are left out."""
    out = np.full(len(marks), -1, np.int64)
    for level, reach in _REACH.items():
        own = ends[kind >= level]
        if len(own):
            at = np.searchsorted(own, marks)
            low, high = own[np.maximum(at - 1, 0)], own[np.minimum(at, len(own) - 1)]
            near = np.where(np.abs(marks - low) <= np.abs(high - marks), low, high)
            out = np.where((out < 0) & (np.abs(near - marks) <= reach), near, out)
    return np.unique(out[out >= 0])


def _split(begin: int, end: int, starts: list, ends: list, kinds: list, snaps: list, limit: int, least: int, overlap: int) -> list[dict]:
    """The pieces of the text [begin, end) of a block."""
    pieces, s, done = [], begin, begin
    while end - s > limit:
        low, high = max(s + least, done + 1), s + limit
        i = bisect_left(snaps, low)
        cut = "hard"
        if i < len(snaps) and snaps[i] <= high:
            e = snaps[i]
            cut = _KINDS[kinds[bisect_left(ends, e)]]
        else:
            j, k = bisect_right(ends, high) - 1, bisect_left(ends, low)
            best = max(range(k, j + 1), key=lambda x: (kinds[x], x), default=None)
            if best is None and j >= 0 and ends[j] > done:
                best = j
            i = bisect_right(ends, done)
            if best is None and i < len(ends) and starts[i] >= done and ends[i] - done <= limit:
                # The whole next word fits if less is repeated: whole words below the overlap.
                best = i
                s = min(starts[bisect_left(starts, ends[i] - limit)], starts[i])
            if best is None:
                e = high
            else:
                e, cut = ends[best], _KINDS[kinds[best]]
        pieces.append({"piece": len(pieces), "start": s - begin, "stop": e - begin, "overlap": done - s, "cut": cut})
        done = e
        i = bisect_left(starts, e - overlap)
        s = starts[i] if i < len(starts) and starts[i] < e else max(s + 1, e - overlap)
    pieces.append({"piece": len(pieces), "start": s - begin, "stop": end - begin, "overlap": done - s, "cut": "end"})
    return pieces


def split_texts(texts: list[str | None], limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP) -> list[list[dict]]:
    """The pieces of each text, as offsets into the text without white space at its ends."""
    out: list[list[dict]] = []
    texts = [t.strip(_WHITE) if t else "" for t in texts]
    for a, b in kernel.blocks(texts):
        part = texts[a:b]
        if max(map(len, part)) <= limit:
            out += [[{"piece": 0, "start": 0, "stop": len(t), "overlap": 0, "cut": "end"}] if t else [] for t in part]
            continue
        cp, begins, stops = kernel.encode(part)
        starts, ends, kind, marks = _plan(cp)
        snaps = _snap(marks, ends, kind)
        for t, begin, stop in zip(part, begins.tolist(), stops.tolist()):
            if not t:
                out.append([])
                continue
            w0, w1 = np.searchsorted(starts, [begin, stop])
            p0, p1 = np.searchsorted(snaps, [begin + 1, stop])
            out.append(_split(begin, stop, starts[w0:w1].tolist(), ends[w0:w1].tolist(), kind[w0:w1].tolist(), snaps[p0:p1].tolist(), limit, least, overlap))
    return out


def pieces(text: Column, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP) -> Column:
    """An array with the pieces of a text (``PIECES``); offsets count characters of the trimmed text."""
    if not 0 <= overlap < least <= limit:
        raise ValueError("sizes must satisfy 0 <= overlap < least <= limit")

    @F.pandas_udf(PIECES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(split_texts(batch.tolist(), limit, least, overlap), index=batch.index)

    return run(text)


def trimmed(text: Column) -> Column:
    """The text without space, tab, line feed and carriage return at either end."""
    return F.btrim(text, F.lit(_WHITE))


def oversized_pages(pages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The pages that the splitter had to cut: book_id, page_num, cut (soft or hard), pieces.

    Only texts over the limit go to Python. The shuffle that finds the latest row of each page
    carries two numbers a row, never the text.
    """
    text = trimmed(F.col("content"))
    cut = pieces(F.when(F.length(text) > limit, text), limit)
    rows = pages.select("book_id", "page_num", updated().alias("at"), F.length(text).alias("n"), F.when(F.length(text) > limit, F.regexp_like("content", F.lit(rf"[^ \t\r\n]{{{limit + 1}}}"))).alias("unbroken"), cut.alias("pieces"))
    hard = F.exists("pieces", lambda p: p["cut"] == "hard") & F.col("unbroken")
    code = F.when(F.size("pieces") > 1, F.size("pieces") * 2 + hard.cast("int")).otherwise(0)
    latest = rows.select("book_id", "page_num", "at", code.alias("code")).groupBy("book_id", "page_num").agg(F.max_by("code", "at").alias("code"))
    return latest.where("code > 0").select("book_id", "page_num", F.when(F.col("code") % 2 == 1, "hard").otherwise("soft").alias("cut"), F.expr("cast(code div 2 as int)").alias("pieces"))


def page_pieces(pages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every piece of every current page with its text, in order, and what it repeats."""
    from leafmill.tables import current_rows

    text = trimmed(F.col("content"))
    rows = current_rows(pages.select("book_id", "page_num", "content", "updated_at"), ["book_id", "page_num"])
    rows = rows.select("book_id", "page_num", text.alias("text"))
    short = rows.where(F.length("text").between(1, limit)).select("book_id", "page_num", F.lit(0).alias("piece"), F.lit(0).alias("overlap"), F.lit("end").alias("cut"), "text")
    long = rows.where(F.length("text") > limit).select("book_id", "page_num", "text", F.explode(pieces(F.col("text"), limit)).alias("p"))
    long = long.select("book_id", "page_num", "p.piece", "p.overlap", "p.cut", F.substring("text", F.col("p.start") + 1, F.col("p.stop") - F.col("p.start")).alias("text"))
    return short.unionByName(long)
