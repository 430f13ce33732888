"""Token ids against the tokenizer itself, text by text, and the round trip."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import kernel, tokenizing

ALPHABET = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "1", "é", "ع", "!", "'s", "a", "<|endoftext|>", "😀", "​", "́", "S", "\x85", "\x1c", "Ᲊ", "　"]


def cut(texts):
    cp, starts, ends = kernel.encode(texts)
    begin, stop = tokenizing.pre_tokens(cp, starts, ends)
    raw = cp.tobytes()
    words = [raw[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(begin, stop)]
    at = np.searchsorted(begin, starts), np.searchsorted(begin, ends)
    return [words[a:b] for a, b in zip(*at)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join), min_size=1, max_size=8))
def test_pre_tokens(texts):
    reference = tokenizing._encoder(f"{tokenizing.FOLDER}/{tokenizing.NAME}.json").pre_tokenizer
    for text, words in zip(texts, cut(texts)):
        assert words == [text[a:b] for _, (a, b) in reference.pre_tokenize_str(text)]


def test_every_kind_of_character():
    reference = tokenizing._encoder(f"{tokenizing.FOLDER}/{tokenizing.NAME}.json").pre_tokenizer
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in [*range(0x3000), *range(0xA000, 0xD800), *range(0xE000, 0x20000)] if c % 3 == 0]
    for text, words in zip(texts, cut(texts)):
        assert words == [text[a:b] for _, (a, b) in reference.pre_tokenize_str(text)], hex(ord(text[1]))


def test_corpus(spark, sf):
    rng = random.Random(2)
    odd = ["", None, " ", "<|endoftext|> x", "x" * 50_000, "a b " * 400_000, "\x00\x07", *("".join(rng.choices(ALPHABET, k=20)) for _ in range(50))]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(odd)] + [(10**9, "again"), (None, "no id")], "doc_id long, text string")
    both = docs.unionByName(extra).selectExpr("*", "1 as block", "'x' as words", "2 as ids")
    want = both.select("doc_id", "text").collect()
    tokenizer = tokenizing._encoder(f"{tokenizing.FOLDER}/{tokenizing.NAME}.json")
    expected = sorted((str(r.doc_id), tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in want)
    got = tokenizing.encode_corpus(both)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got.collect()) == expected
    back = {r.doc_id: r.text for r in tokenizing.decode_corpus(tokenizing.encode_corpus(docs)).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}
    assert tokenizing.encode_corpus(docs.limit(0)).count() == 0
