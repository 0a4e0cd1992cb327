"""Fingerprints: edited texts, equality, order, and a plain model of the selection."""

import random
from hashlib import sha256

import xxhash
from pyspark.sql import functions as F

from presflow.llm import order_minhash as O


def test_edited_texts_and_likeness(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijé", k=rng.randint(2, 8))) for _ in range(800)]
    rows = [(i * 7 - 30, rng.choice([None, "", "short", "é" * rng.randint(0, 300), " ".join(rng.choices(words, k=rng.randint(1, 400)))])) for i in range(60)]
    rows += [(3000, rows[-1][1]), (3001, "x" * 4000), (3002, "ab" * 3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("sig", F.lit(1))
    got = {r.doc_id: r for r in O.fingerprints(df.repartition(3)).collect()}
    ordered = sorted(rows)
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(ordered):
        text, other = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == text:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    by_text = {}
    for doc_id, text in rows:
        by_text.setdefault(text or "", set()).add(got[doc_id].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for d, r in got.items() if r.n_chars > 600 and d < 3000]
    assert sum(r.near_edited for r in long) > 3 * sum(r.near_next for r in long)


def test_order_matters_and_small_edits_hardly(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    text = " ".join(words)
    swapped = " ".join(words[200:] + words[:200])
    touched = " ".join(words[:50] + ["zzz"] + words[51:])
    row = spark.createDataFrame([(text, swapped, touched)], "a string, b string, c string")
    sig = row.select(*[O.signature(F.col(c)).alias(c) for c in "abc"])
    near = sig.select(O.likeness(F.col("a"), F.col("b")), O.likeness(F.col("a"), F.col("c"))).first()
    assert near[1] > 0.85 and near[0] < near[1] - 0.2


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "some text that is repeated"), (1, "some text that is repeated"), (2, "another text altogether"), (None, "no id here")]
    got = O.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 4 and [r.near_next for r in got if r.doc_id is None] == [None]
    assert O.fingerprints(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def model(text):
    """Every bin's least of all numbered k-mers of a text."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    spark_hash = lambda raw, seed=42: xxhash.xxh64_intdigest(raw, seed)
    b, seen, bins = text.encode(), {}, {}
    for at in range(max(len(b) - O.K + 1, min(len(b), 1))):
        h = spark_hash(b[at : at + O.K])
        seen[h] = t = seen.get(h, -1) + 1
        g = signed(spark_hash(t.to_bytes(4, "little"), spark_hash(h.to_bytes(8, "little"))))
        bins.setdefault(g % O.BINS, []).append((signed(h), at, g))
    out = []
    for of, rows in sorted(bins.items()):
        h = 42
        for _, _, g in sorted(sorted(rows)[: O.PER_BIN], key=lambda r: r[1]):
            h = spark_hash((g & (1 << 64) - 1).to_bytes(8, "little"), h)
        out.append(of << 32 | h & 0xFFFFFFFF)
    return out


def test_every_bin_takes_its_least_of_the_whole_text(spark):
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    texts = ["", "short", "é" * 40, "x" * 3000, "ab" * 1500] + [prose(n) for n in (11, 12, 13, 100, 300, 511, 540, 700, 1100, 5000, 20000)]
    texts += [prose(3000) + "same line again\n" * 300, " " * 2000 + prose(1500)] + [prose(2500) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    got = {r.i: list(r.sig) for r in df.select("i", O.signature(F.col("text")).alias("sig")).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != model(t)] == []
    assert all(len(got[i]) == O.BINS for i, t in enumerate(texts) if len(t) >= 1100)
