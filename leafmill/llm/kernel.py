"""Vectorised text primitives shared by the operators: whole batches of texts as code-point arrays.

All functions are pure numpy over one batch, so an operator's Python cost is a few array passes a
character instead of an object a word. Lookup tables are built once per worker process.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

#: Batches of texts are cut into blocks of about so many characters (one text at least).
BLOCK_CHARS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_U64 = np.uint64


@functools.lru_cache(None)
def categories() -> np.ndarray:
    """The first letter of each code point's general category, as a byte."""
    return np.frombuffer("".join([unicodedata.category(chr(c))[0] for c in range(0x110000)]).encode(), np.uint8)


@functools.lru_cache(None)
def word_chars() -> np.ndarray:
    """True for letters, combining marks and numbers."""
    return np.isin(categories(), np.frombuffer(b"LMN", np.uint8))


def blocks(texts: Sequence[str | None], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters; a longer text has a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def encode(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, with a line feed after each, and each text's start and end."""
    joined = "\n".join([t or "" for t in texts]) + "\n"
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts), np.int64)
    if len(texts) > 1:
        np.cumsum(lengths[:-1] + 1, out=starts[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts, starts + lengths


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = _U64(pow(int(_BASE), -1, 1 << 64))
    one = np.ones(1, _U64)
    with np.errstate(over="ignore"):
        return np.concatenate([one, np.cumprod(np.full(n, _BASE))]), np.concatenate([one, np.cumprod(np.full(n, inverse))])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points; equal spans have equal hashes anywhere."""
    n = 1 << max(16, int(len(cp)).bit_length())
    power, inverse = _powers(n)
    total = np.zeros(len(cp) + 1, _U64)
    np.cumsum((cp.astype(_U64) + _U64(1)) * power[: len(cp)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U64))


def words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: each word's hash, the first word of each text, and one past its last."""
    cp, starts, ends = encode([t.lower() if t else t for t in texts])
    s, e = runs(word_chars()[cp])
    return span_hashes(cp, s, e), np.searchsorted(s, starts), np.searchsorted(s, ends)


def word_hash(word: str) -> int:
    """The hash that ``words`` gives a single word."""
    h, _, _ = words([word])
    return int(h[0])


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` successive words, by the run's first word."""
    if len(hashes) < size:
        return np.empty(0, _U64)
    out = np.zeros(len(hashes) - size + 1, _U64)
    for k in range(size):
        out *= _U64(0xD6E8FEB86659FD93)
        out += hashes[k : k + len(out)]
    return mix(out)
