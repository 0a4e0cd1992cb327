"""Byte-level BPE against the public library and by round trip."""

import random
from hashlib import sha256

import numpy as np
import tiktoken

from presflow.llm import bpe

PARTS = ["a", "b", " ", "  ", "\n", "\t", " 's", "'ll", "é", "1", "23", "!", "?!", "　", "\xa0", "日本", "aaaa", "the", " The", "\r\n", "😀"]


def library():
    codec = bpe.Codec.of(bpe.RANKS, bpe.PATTERN)
    return codec, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_same_ids_as_the_library():
    codec, own = library()
    rng = random.Random(4)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(4000)] + ["", "x" * 5000, "ab" * 3000, " " * 300, "Zz" + "q" * 70 + " tail"]
    for text, packed in zip(texts, codec.encode_many(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == own.encode_ordinary(text), text
        assert codec.decode(packed) == text.encode()


def test_one_tree_and_many_agree():
    codec, _ = library()
    rng = random.Random(5)
    pieces = ["".join(rng.choices("abcdefghé ", k=rng.randint(2, 20))).encode()[:32] for _ in range(500)]
    pieces = [p for p in pieces if p not in codec.ranks and len(p) > 1]
    packed = bpe.merge_many(pieces, codec.ranks, codec.pairs, 32)
    for piece, got in zip(pieces, packed):
        assert np.frombuffer(got, "<u4").tolist() == bpe.merge(piece, codec.ranks)


def test_tables_stay_bounded(monkeypatch):
    codec = bpe.Codec()
    monkeypatch.setattr(bpe, "TABLE_ENTRIES", 50)
    for at in range(5):
        codec.encode_many([" ".join(f"w{at}x{i}" for i in range(100)) + " " + "y" * 100])
        assert len(codec.spaced) <= 50


def test_query_on_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "Hello  world", 3), (3, "Hello  world", 3), (None, "x", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = bpe.digests(df).collect()
    assert len(got) == 5
    for r in got:
        if r.doc_id in (1, 2):
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, sha256(b"").hexdigest(), sha256(b"").hexdigest())
        if r.doc_id == 3:
            assert r.decoded_sha256 == sha256(b"Hello  world").hexdigest()
    assert bpe.digests(df.limit(0)).count() == 0
