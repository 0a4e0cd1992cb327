"""Training order: a permutation, every slot against it, whole documents, reading from a slot on."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from presflow.llm import bpe, queries, training_order

MARK = b"\xff"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(n):
    slots = training_order.permute(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 60:
        other = training_order.permute(np.arange(n), n, key=7)
        assert (slots != np.arange(n)).mean() > 0.9 and (slots != other).mean() > 0.9


def tables():
    rng = random.Random(8)
    return [(i * 5 - 20, rng.choice([None, "", "é" * rng.randint(0, 90), "x" * rng.randint(0, 200), "y" * 16])) for i in range(120)] + [(15, "twice"), (15, "twice"), (None, "no id"), (None, "no id" * 30), (-1, "minus one"), (7, "z" * 40_000)]


def written(spark, rows, parts=3, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("slot", F.lit(1)).repartition(parts)
    return training_order.materialise(df, F.col("text").cast("binary"), 1, 0xFF, length=16, **more)


def test_every_slot_and_every_document(spark):
    rows = tables()
    records = written(spark, rows)
    got = sorted(training_order.read(records, 1, 16).collect())
    assert [r.slot for r in got] == list(range(len(got)))
    # slots are the ranks of the permuted places of where sequences begin
    low, high, most = -20, 575, max(len((t or "").encode()) for _, t in rows) + 1
    span = high - low + 2
    starts = [(span - 1 if r.docs[0].doc_id is None else r.docs[0].doc_id - low) * most + r.docs[0].offset for r in got]
    places = training_order.permute(np.array(starts), span * most)
    whole = [bytes(r.ids).ljust(16, MARK) for r in got]
    order = [(int(p), zlib.crc32(b)) for p, b in zip(places, whole, strict=True)]
    assert order == sorted(order) and len({s for s, _ in order}) > 0.9 * len(got)
    # every document, end to end, with its mark
    found = []
    pieces = {}
    for r in got:
        for d, stop in zip(r.docs, [x.at for x in r.docs[1:]] + [r.n_tokens], strict=True):
            pieces.setdefault(d.doc_id, []).append((d.offset, bytes(r.ids[d.at : stop])))
    for i, some in pieces.items():
        while some:  # documents that share an id: any whose pieces fit
            at, text = 0, b""
            while not text.endswith(MARK):
                piece = next(x for x in some if x[0] == at)
                some.remove(piece)
                text += piece[1]
                at = len(text)
            found.append((i, text[:-1]))
    single = [(i, (t or "").encode()) for i, t in rows if sum(j == i for j, _ in rows) == 1]
    assert sorted(x for x in found if x[0] in dict(single)) == sorted(single)
    assert sum(len(t) for _, t in found) == sum(len((t or "").encode()) for _, t in rows) and len(found) == len(rows)
    # at most one record a task is filled up
    assert sum(r.n_tokens < 16 for r in got) <= 3
    assert written(spark, rows[:0]).count() == 0


def test_shards_are_files_of_fixed_stride(spark):
    records = written(spark, [(i, "x" * (i % 50)) for i in range(400)])
    rows = sorted(records.collect())
    files = {r.path for r in rows}
    assert len(files) == len({r.shard for r in rows}) > 1
    for r in training_order.read(records, 1, 16).collect():
        raw = open(rows[r.slot].path.removeprefix("file:"), "rb").read()
        assert len(raw) % 16 == 0 and raw[r.byte_offset : r.byte_offset + 16] == bytes(r.ids).ljust(16, MARK)
    first = min(r.slot for r in rows if r.shard == 2)
    for r in rows:
        if r.shard < 2 and os.path.exists(r.path.removeprefix("file:")):
            os.remove(r.path.removeprefix("file:"))  # what lies before a slot is not read
    assert sorted(r.slot for r in training_order.read(records, 1, 16, first).collect()) == list(range(first, len(rows)))
    folder = os.path.dirname(rows[0].path.removeprefix("file:"))
    open(f"{folder}/left-behind", "w").close()
    training_order.discard(records)
    assert not os.path.exists(folder)


def test_ids_are_those_of_op1(spark, tmp_path):
    rows = [(1, "some words of a text " * 300), (2, "short"), (3, None), (4, "a" * 9000 + " " * 5000 + "b"), (5, "ñandú <|endoftext|> 12345\n\n  x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    own = {r.doc_id: bytes(r.tokens) for r in training_order.encode(df).collect()}
    want = {r.doc_id: np.frombuffer(bytes(r.token_bytes), "<u4").astype("<u2").tobytes() for r in bpe.encode(df).collect()}
    assert own == want
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_training_order(spark, str(tmp_path)).agg(F.sum("n_tokens")).first()[0]
    assert got == sum(len(x) // 2 + 1 for x in want.values())
