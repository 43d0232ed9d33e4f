"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest

from labmesh.llm import bytepairs
from labmesh.llm.bytepairs import (
    EncodedText,
    Encoder,
    Prefixes,
    decode_byte_pairs,
    encode_byte_pairs,
    load_byte_pairs,
)
from labmesh.llm.queries import REGISTRY

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

FOLDER = "/root/testdata/sf0.001"
SIGNS = list("aab'strevmld  \n\t  .,1234'éñ漢字🙂<|endoftext|>▁\x1c\x00")


@pytest.fixture(scope="module")
def vocabulary():
    return load_byte_pairs(tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding(
        "own", pat_str=tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}
    )


def some(rng, n):
    return "".join(rng.choice(SIGNS) for _ in range(n))


def test_pattern():
    assert bytepairs.PATTERN == tokenizers.PATTERN


def test_texts_of_odd_signs(vocabulary, library):
    rng = random.Random(1)
    texts = [some(rng, rng.randint(0, 60)) for _ in range(3000)]
    encoder = Encoder(vocabulary, remembered=50_000)
    for at in range(0, len(texts), 100):
        found = encoder.encode_many(texts[at : at + 100])
        assert [np.frombuffer(f, np.int32).tolist() for f in found] == library.encode_ordinary_batch(
            texts[at : at + 100]
        )


def test_every_character(vocabulary, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "1 ".join(every[k : k + 64]) + "\n" for k in range(0, len(every), 64)]
    encoder = Encoder(vocabulary)
    found = [np.frombuffer(f, np.int32).tolist() for f in encoder.encode_many(texts)]
    assert found == library.encode_ordinary_batch(texts)


def test_long_words_and_segments(vocabulary, library, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdethinrs") for _ in range(rng.randint(60, 900))) for _ in range(40)]
    texts = [*words, "a" * 5000, " " * 3000 + "x", "ab" * 900 + "\n" * 70, "漢" * 400]
    encoder = Encoder(vocabulary)
    want = library.encode_ordinary_batch(texts)
    assert [encoder.encode(t) for t in texts] == want
    monkeypatch.setattr(bytepairs, "SEGMENT", 37)
    assert [encoder.encode(t) for t in texts] == want
    long = [some(rng, 500) for _ in range(60)]
    assert [encoder.encode(t) for t in long] == library.encode_ordinary_batch(long)


def test_another_vocabulary_and_pattern(vocabulary):
    ranks = load_byte_pairs(tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks
    pattern = r"\p{L}+|\s+|[^\s\p{L}]+"
    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [some(rng, 80) for _ in range(200)]
    encoder = Encoder(bytepairs.byte_pairs(ranks, pattern))
    assert [encoder.encode(t) for t in texts] == library.encode_ordinary_batch(texts)


def test_tokens_that_no_merges_lead_to():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyzw": 257, b"abab": 258}
    library = tiktoken.Encoding("few", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    encoder = Encoder(bytepairs.byte_pairs(ranks, r"\S+|\s+"))
    for text in ("xyzw", "xyzwa", "abab", "ababab", "aabab", "xyzw abab"):
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_vocabulary_needs_all_bytes():
    with pytest.raises(ValueError):
        bytepairs.byte_pairs({b"a": 0, b"b": 1})


def test_prefixes_follow_appends_and_edits(vocabulary):
    rng = random.Random(4)
    for _ in range(200):
        word = "".join(rng.choice("abcdethinrs") for _ in range(rng.randint(1, 400))).encode()
        grown = Prefixes(vocabulary)
        for at in range(0, len(word), 7):
            grown.append(word[at : at + 7])
        assert grown.last == Prefixes(vocabulary, word).last
        start = rng.randint(0, len(word))
        end = rng.randint(start, min(len(word), start + 9))
        new = some(rng, rng.randint(0, 8)).encode()
        grown.replace(start, end, new)
        assert grown.last == Prefixes(vocabulary, word[:start] + new + word[end:]).last


def test_an_edit_finds_few_prefixes_anew(vocabulary):
    word = b"internationalization" * 500
    prefixes = Prefixes(vocabulary, word)
    assert prefixes.replace(40, 41, b"q") < 400
    assert prefixes.last == Prefixes(vocabulary, bytes(prefixes.word)).last


def test_texts_follow_edits(vocabulary, library):
    rng = random.Random(5)
    for _ in range(400):
        text = EncodedText(vocabulary, some(rng, rng.randint(0, 80)))
        for _ in range(4):
            start = rng.randint(0, len(text.text))
            end = rng.randint(start, min(len(text.text), start + 6))
            text.replace(start, end, some(rng, rng.randint(0, 5)))
            assert text.ids() == library.encode_ordinary(text.text)
    long = EncodedText(vocabulary, "the quick brown fox " * 1000)
    assert long.replace(5000, 5003, "X") < 10
    assert long.append(" end") < 10
    assert long.ids() == library.encode_ordinary(long.text)


def test_rows(spark, vocabulary, library):
    """NULL, empty, very long and repeated texts, columns named like the new ones, no rows."""
    schema = "doc_id long, text string, Token_Ids string, decoded int, n int"
    texts = [None, "", "a b", "a b", "word " * 60_000, "x" * 9000, "\n\n"]
    docs = spark.createDataFrame([(k, t, "old", 1, 5) for k, t in enumerate(texts)], schema)
    out = encode_byte_pairs(docs, vocabulary, decoded="decoded")
    assert out.columns == ["doc_id", "text", "n", "token_ids", "decoded"]
    again = decode_byte_pairs(out.withColumnRenamed("decoded", "first"), vocabulary)
    for row in again.collect():
        text = row["text"] or ""
        assert row["token_ids"] == library.encode_ordinary(text)
        assert bytes(row["first"]) == bytes(row["decoded"]) == text.encode()
    assert encode_byte_pairs(docs.limit(0), vocabulary).count() == 0
    with pytest.raises(ValueError):
        encode_byte_pairs(docs, vocabulary, ids="TEXT")
    odd = spark.createDataFrame([([5, -1, 60_000],), (None,)], "token_ids array<int>")
    decoded = [bytes(r["decoded"]) for r in decode_byte_pairs(odd, vocabulary).collect()]
    assert decoded == [vocabulary_token(vocabulary, 5) + "��".encode(), b""]


def vocabulary_token(vocabulary, rank):
    return next(t for t, r in vocabulary.ranks.items() if r == rank)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no given tables")
def test_query(spark, library):
    rows = REGISTRY["op12_byte_bpe"](spark, FOLDER).toPandas().set_index("doc_id")
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    assert len(rows) == len(given)
    for doc_id, text in zip(given["doc_id"], given["text"]):
        ids = library.encode_ordinary(text or "")
        joined = " ".join(map(str, ids))
        assert rows["n_tokens"][doc_id] == len(ids)
        assert rows["ids_sha256"][doc_id] == hashlib.sha256(joined.encode()).hexdigest()
        assert rows["decoded_sha256"][doc_id] == hashlib.sha256((text or "").encode()).hexdigest()
