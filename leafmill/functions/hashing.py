"""Hashes, fingerprints and identifiers."""

from __future__ import annotations

import hashlib
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the URL namespace of name-based UUIDs, in hexadecimal.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def uuid5(name: Column) -> Column:
    """The name-based UUID (version 5) of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substr(h, F.lit(17), F.lit(2)), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))


def chunk_hash(book: Column, first: Column, last: Column, number: Column, text: Column) -> Column:
    """The identity of a chunk: book, pages, number and text."""
    return F.sha2(F.concat_ws("|", book, first.cast("string"), last.cast("string"), number.cast("string"), text), 256)


def point_id(chunk: Column) -> Column:
    return uuid5(F.concat(F.lit("rag-chunk:"), chunk))


def signed64(hexadecimal: Column) -> Column:
    """Sixteen hexadecimal digits as a signed 64-bit integer."""
    return F.conv(hexadecimal, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def shared_blocks(value: Column, bits: int) -> Column:
    """(i, part) by which two 64-bit values that differ in at most ``bits`` bits meet: the bits of some of their blocks.

    The values are cut into blocks, more than there may be differing bits; as many as are left over are
    equal in both, so both have the same bits under the mask of one combination of so many blocks. For five
    bits that is three blocks of eight, so values meet by chance once in 2^24; for ten, two of twelve.
    """
    blocks, equal = (8, 3) if bits <= 5 else (12, 2)
    if bits > blocks - equal:
        raise ValueError("no masks for so many differing bits")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in own) for own in itertools.combinations(range(blocks), equal)]
    return F.array(*[F.struct(F.lit(i).alias("i"), value.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint")).alias("part")) for i, m in enumerate(masks)])


def near_values(values: DataFrame, bits: int, least: int = 1, on: tuple[str, ...] = ()) -> DataFrame:
    """h, o, on: pairs of different values of ``h`` (distinct rows of h, on) that differ in ``least`` to ``bits`` bits, equal in ``on``."""
    keyed = values.select("h", *on, F.explode(shared_blocks(F.col("h"), bits)).alias("b")).select("h", *on, "b.i", "b.part")
    pairs = keyed.join(keyed.withColumnRenamed("h", "o"), ["i", "part", *on])
    return pairs.where((F.col("h") != F.col("o")) & hamming(F.col("h"), F.col("o")).between(least, bits)).select("h", "o", *on).distinct()


def simhash_bits(word_hash: str = "h") -> list[Column]:
    """64 aggregates over rows of distinct words: the signed weight of each bit of column ``word_hash``, with count ``n``."""
    return [F.sum(F.when(F.col(word_hash).bitwiseAND(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")) != 0, F.col("n")).otherwise(-F.col("n"))).alias(f"b{i}") for i in range(64)]


def simhash_of_bits() -> Column:
    out = F.lit(0).cast("bigint")
    for i in range(64):
        out = out.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out


@F.pandas_udf(T.LongType())
def blake2b64(words: pd.Series) -> pd.Series:
    """The 8-byte BLAKE2b of each word as a signed integer, big end first."""
    return words.map(lambda w: None if w is None else int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big", signed=True))


def simhash_by(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, simhash: ``simhash_compat`` over all texts of a key, as an aggregate over distinct words.

    Words are counted before they are hashed, and bits are summed on the map side; no key's text is
    put together. Keys without words give no row.
    """
    words = rows.select(key, F.explode(F.filter(F.split(text, " "), lambda w: w != "")).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    return words.select(key, "n", blake2b64("w").alias("h")).groupBy(key).agg(*simhash_bits()).select(key, simhash_of_bits().alias("simhash"))


@F.pandas_udf(T.LongType())
def simhash_compat(texts: pd.Series) -> pd.Series:
    """SimHash with 8-byte BLAKE2b over white-space tokens, as signed 64 bits; no tokens give 0.

    Each different word of a batch is hashed once; the bits of all texts are summed together.
    """
    import numpy as np

    words = texts.fillna("").str.split().reset_index(drop=True).explode().dropna()
    out = np.zeros(len(texts), np.int64)
    if not len(words):
        return pd.Series(out)
    number, kinds = pd.factorize(words)
    raw = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in kinds), np.uint8).reshape(-1, 8)
    bits = np.unpackbits(raw, axis=1).astype(np.int8) * np.int8(2) - np.int8(1)
    owner = words.index.to_numpy()
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    for a in range(0, len(begin), 512):  # texts, so that the words' bits are few at a time
        own = begin[a : a + 512]
        stop = begin[a + 512] if a + 512 < len(begin) else len(owner)
        total = np.add.reduceat(bits[number[own[0] : stop]], own - own[0], axis=0, dtype=np.int64)
        out[owner[own]] = np.frombuffer(np.packbits(total > 0, axis=1).tobytes(), ">i8")
    return pd.Series(out)
