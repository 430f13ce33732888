"""Encoding the whole corpus with a public byte-level BPE tokenizer by a shuffle of distinct words.

1. Blocks of documents (about a million characters) are cut into pre-tokens by array operations.
   Each block keeps, by position, the number of each pre-token within the block, and lists its
   distinct pre-tokens. That is the exploded (word, position) relation, aggregated before any shuffle.
2. The distinct words of all blocks meet in one shuffle on the word; each is encoded once.
3. The ids go back to the blocks that hold the word (a join on the word; a word has at most one row
   a block, and where blocks are very many each word's rows are spread over several keys).
4. Each block is put together by position from its own words' ids.

Blocks and words are written to the shared folder first, so that a lost executor never repeats
step 1, and step 4 reads them again without another pass over the texts.

Defined ids: null and empty texts give an empty list; strings that look like special tokens are
ordinary text; unpaired surrogates cannot occur in a Spark string. doc_id may be null or repeated:
every input row gives one output row. Decoding joins the token-byte table.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import kernel
from leafmill.work import stage

#: Folder with the public tokenizers' vocabulary files; a parameter of every function here.
FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
MOST_TOKENS = 300_000
#: Blocks in which a word may occur before its rows are spread over several keys.
MOST_BLOCKS = 100_000
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
#: The suffixes that the pattern splits off after an apostrophe.
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers of Unicode 16, which the tokenizer knows and Python's tables may not.
_NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


@functools.lru_cache(None)
def _classes() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    category = kernel.categories()
    table = np.full(0x110000, _OTHER, np.uint8)
    table[category == ord("L")] = _LETTER
    table[category == ord("N")] = _NUMBER
    for a, b in _NEW_LETTERS:
        table[a : b + 1] = _LETTER
    for a, b in _NEW_NUMBERS:
        table[a : b + 1] = _NUMBER
    table[_WHITE] = _SPACE
    return table


def pre_tokens(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each pre-token of texts within ``cp`` (each followed by a separator).

    The rules of the vocabulary's split pattern as array operations: runs of letters, numbers and
    other characters, each with one space before it; contractions at an apostrophe; the last white
    space of a run stands alone unless it is a space before a run.
    """
    kind = _classes()[cp]
    n = len(cp)
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[starts] = edge[ends] = True  # the separator is a run of its own
    separator = np.zeros(n, bool)
    separator[ends] = True
    edge[np.minimum(ends + 1, n)] = True
    cut = edge.copy()
    # White space before something else: the last one is cut off; a space then joins what follows.
    space = (kind == _SPACE) & ~separator
    last = np.flatnonzero(space & edge[1 : n + 1])
    last = last[(last + 1 < n)]
    last = last[~separator[last + 1]]
    cut[last] = True
    joins = last[cp[last] == 32]
    cut[joins + 1] = False
    # Contractions: an apostrophe that begins a pre-token and is a run of one, before letters.
    apostrophe = np.flatnonzero((cp[: n - 1] == 39) & cut[: n - 1] & edge[1:n] & (kind[1:] == _LETTER))
    if len(apostrophe):
        a, b = cp[np.minimum(apostrophe + 1, n - 1)], cp[np.minimum(apostrophe + 2, n - 1)]
        long = np.zeros(len(apostrophe), bool)
        inside = ~edge[np.minimum(apostrophe + 2, n)]
        for one, two in (x for x in _SUFFIXES if len(x) == 2):
            long |= (a == ord(one)) & (b == ord(two)) & inside
        short = np.isin(a, [ord(x) for x in _SUFFIXES if len(x) == 1])
        # A single-letter suffix is tried before "re", "ve" and "ll"; none of those begins with one.
        length = np.where(short, 1, np.where(long, 2, 0))
        hit = apostrophe[length > 0]
        cut[hit + 1] = False
        cut[hit + 1 + length[length > 0]] = True
    begin = np.flatnonzero(cut[:n])
    stop = np.append(begin[1:], n)
    keep = ~separator[begin]
    return begin[keep], stop[keep]


@functools.lru_cache(4)
def _encoder(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _cut(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens (the most frequent first), the number of each position's, and counts."""
    cp, starts, ends = kernel.encode(texts)
    begin, stop = pre_tokens(cp, starts, ends)
    counts = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
    if not len(begin):
        return [], np.empty(0, np.uint32), counts
    _, first, number, size = np.unique(kernel.span_hashes(cp, begin, stop), return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-size, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    raw = cp.tobytes()
    words = [raw[4 * begin[i] : 4 * stop[i]].decode("utf-32-le", "surrogatepass") for i in first[order]]
    return words, place[number], counts


def _small(values: np.ndarray) -> bytes:
    """Little-endian integers of the narrowest width, which the first byte gives."""
    width = 1 if not len(values) or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


_BLOCK = "block long, words array<string>, numbers binary, counts binary, docs array<long>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context, serial = TaskContext.get(), 0
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in kernel.blocks(texts):
            words, numbers, counts = _cut(texts[a:b])
            block = (context.partitionId() << 33) + serial
            serial += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([words], pa.list_(pa.string())), pa.array([_small(numbers)], pa.binary()), pa.array([_small(counts)], pa.binary()), pa.array([ids[a:b].to_pylist()], pa.list_(pa.int64()))],
                ["block", "words", "numbers", "counts", "docs"],
            )


def encode_words(words: DataFrame, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(word, ids) of each distinct word: one call of the tokenizer a word in the whole corpus.

    The vocabulary file is read on the driver and shipped to the executors.
    """
    words.sparkSession.sparkContext.addFile(f"{folder}/{name}.json")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _encoder(SparkFiles.get(f"{name}.json"))
        for pdf in batches:
            found = tokenizer.encode_batch(pdf["word"].tolist(), add_special_tokens=False)
            yield pd.DataFrame({"word": pdf["word"], "ids": [x.ids for x in found]})

    return words.select("word").mapInPandas(run, "word string, ids array<int>")


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            numbers, counts = _large(columns[0][i].as_py()), _large(columns[1][i].as_py()).astype(np.int64)
            docs, entries = columns[2][i].values, columns[3][i].values
            places = entries.field("place").to_numpy()
            lists = entries.field("ids")
            order = np.argsort(places)
            begins = lists.offsets.to_numpy()
            lengths, begins = np.diff(begins)[order].astype(np.int64), begins[:-1][order].astype(np.int64)
            flat = lists.values.to_numpy()
            size = lengths[numbers]
            ends = np.cumsum(size)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[numbers] - (ends - size), size)
            offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
            for a in range(0, len(counts), 2000):  # batches of bounded size
                o = offsets[a : a + 2001]
                yield pa.RecordBatch.from_arrays([docs.slice(a, len(o) - 1), pa.ListArray.from_arrays(pa.array(o - o[0], pa.int32()), pa.array(flat[at[o[0] : o[-1]]], pa.int32()))], ["doc_id", "ids"])


def encode_corpus(documents: DataFrame, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """doc_id, ids: the token ids of each document's text, without special tokens."""
    blocks = stage(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_blocks, _BLOCK), "token-blocks")
    entries = blocks.select("block", F.posexplode("words").alias("place", "word"))
    ids = encode_words(entries.select("word").distinct(), folder, name)
    salts = 1 + blocks.select("block").count() // MOST_BLOCKS
    if salts > 1:
        entries = entries.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
        ids = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    back = entries.join(ids, ["word"] + ["salt"] * (salts > 1)).groupBy("block").agg(F.collect_list(F.struct("place", "ids")).alias("entries"))
    full = blocks.select("block", "numbers", "counts", "docs").join(back, "block", "left")
    full = full.select("numbers", "counts", "docs", F.coalesce("entries", F.expr("cast(array() as array<struct<place int, ids array<int>>>)")).alias("entries"))
    return full.mapInArrow(_reassemble, "doc_id long, ids array<int>")


def token_bytes(spark: SparkSession, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(id, bytes): the table that decodes ids; as large as the vocabulary, which is fixed."""
    rows = [(int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in open(f"{folder}/{name}.tiktoken", "rb") if line.strip())]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "bytes"]), "id int, bytes binary")


def _decode(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    data, begins, sizes = shared.value
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            lists = pa.concat_arrays([part.column(1)])
            ids, counts = lists.flatten().to_numpy(zero_copy_only=False), np.array([len(x) if x is not None else 0 for x in lists])
            size = sizes[ids]
            ends = np.cumsum(size)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[ids] - (ends - size), size)
            flat = data[at].tobytes()
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
            texts = [flat[x:y].decode("utf-8", "replace") for x, y in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode_corpus(encoded: DataFrame, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """doc_id, text: the inverse of ``encode_corpus``.

    Every id is joined with the token-byte table by position in it. The table is a file of fixed
    size (``MOST_TOKENS`` rows at most), so it is broadcast, and no token is shuffled.
    """
    rows = sorted(tuple(r) for r in token_bytes(encoded.sparkSession, folder, name).collect())
    if len(rows) > MOST_TOKENS or [i for i, _ in rows] != list(range(len(rows))):
        raise ValueError("the vocabulary is larger than what is broadcast, or has gaps")
    sizes = np.array([len(b) for _, b in rows], np.int64)
    table = np.frombuffer(b"".join(b for _, b in rows), np.uint8), np.cumsum(sizes) - sizes, sizes
    shared = encoded.sparkSession.sparkContext.broadcast(table)
    return encoded.select("doc_id", "ids").mapInArrow(functools.partial(_decode, shared), "doc_id long, text string")
