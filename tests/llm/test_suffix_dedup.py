"""Removal of repeated passages against brute force."""

import random
from hashlib import sha256

import numpy as np
import pytest

from presflow.llm import phrases, suffix_dedup

SCHEMA = "doc_id bigint, text string"


def brute(rows, match):
    """(id, n_bytes, n_removed, n_spans, digest) of each row; first document of each string by a dictionary."""
    first = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - match + 1 if doc_id is not None else 0):
            piece = raw[i : i + match]
            first[piece] = min(first.get(piece, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - match + 1 if doc_id is not None else 0):
            if first[raw[i : i + match]] < doc_id:
                gone[i : i + match] = b"\1" * match
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(raw), sum(gone), spans, sha256(bytes(b for b, x in zip(raw, gone) if not x)).hexdigest()))
    return sorted(out, key=str)


def corpus(rng, n):
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rng.choices(words, k=rng.randint(3, 30))) for _ in range(12)] + ["a" * 130, "ab" * 90, "=" * 49, "=" * 50]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            text = rng.choice(rows)[1]
        elif kind < 0.25:
            text = rng.choice([None, "", "short", "x" * 50])
        else:
            parts = [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(rng.randint(1, 5))]
            for _ in range(rng.randint(0, 3)):
                parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
            text = rng.choice([" ", "", "\n"]).join(parts)
        rows.append((i * 3 - 40, text))
    return rows


@pytest.mark.parametrize("seed, blocks", [(1, 6 << 20), (2, 900), (3, 300)])
def test_against_brute_force(spark, monkeypatch, seed, blocks):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", max(4000, blocks))
    rng = random.Random(seed)
    rows = corpus(rng, 250)
    rng.shuffle(rows)
    got = suffix_dedup.digests(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 50)


def test_repeated_ids_nulls_extra_columns(spark):
    text = "the same long passage of words, over and over again, until it is long enough"
    rows = [(5, text, 1, "a"), (5, text, 1, "a"), (5, "x" + text, 2, "b"), (None, text, 3, "c"), (3, None, 4, "d"), (7, text + "!", 5, "e")]
    df = spark.createDataFrame(rows, SCHEMA + ", bucket int, payload string")
    got = sorted(map(tuple, suffix_dedup.digests(df).collect()), key=str)
    assert got == brute([r[:2] for r in rows], 50)
    assert suffix_dedup.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_kept_texts(spark):
    passage = "a passage that two documents share, which is longer than fifty bytes for sure"
    rows = [(1, "One. " + passage), (2, passage + " Two."), (3, "nothing shared")]
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "One. " + passage, 2: " Two.", 3: "nothing shared"}


def test_texts_longer_than_places_hold(monkeypatch):
    rng = np.random.default_rng(4)
    passage, long = rng.integers(0, 256, 300, dtype=np.uint8), rng.integers(0, 256, 6000, dtype=np.uint8)
    long[5500:5800] = passage
    data, ends = np.r_[long, passage], np.array([6000, 6300])
    want = phrases.parse(data, ends, 50)
    monkeypatch.setattr(phrases, "_PLACE", np.uint64((1 << 10) - 1))
    monkeypatch.setattr(phrases, "LIMIT", 1 << 9)
    got = phrases.parse(data, ends, 50)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    text, _, _, trigger, phrase = got
    inner = phrase[text == 1][1:-1]  # the passage's ends lie in phrases of other bytes
    assert len(inner) > 5 and np.isin(inner, phrase[text == 0]).all()
