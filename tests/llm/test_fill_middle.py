"""Fill-in-the-middle against a plain model, and boundary lists against the boundaries."""

import random
import re
from hashlib import sha256

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presflow.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def model(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.text(alphabet="ab \t\n\x0b\x85é\U0001f600<P>", max_size=60))
def test_token_ends(text):
    ends, at = [], 0
    for token in TOKEN.findall(text):
        at += len(token)
        ends.append(at)
    assert fill_middle.token_ends(text).tolist() == ends


@given(st.lists(st.integers(0, 5000), unique=True, max_size=300), st.integers(1, 100_000))
def test_boundaries_select(values, room):
    values = np.array(sorted(values), np.int64)
    limit = int(values[-1]) + room if len(values) else room
    kept = fill_middle.Boundaries(values, limit)
    assert [kept.select(i) for i in range(kept.n)] == values.tolist()
    if kept.n:
        assert 8 * kept.size <= kept.n * (3 + np.log2(max(2, limit / kept.n))) + 16  # two bits a number and its low bits


def test_every_case(spark):
    random.seed(3)
    texts = [None, "", " ", "\n\t ", "one", " one ", "a <P> b c d", "x<S", "<M>", "é\U0001f600 \x85x  y", "tail  \n"]
    texts += [" ".join(random.choice(["a", "bb", "<", "S>", "", "ccc\n"]) for _ in range(random.randint(1, 40))) for _ in range(150)]
    texts += ["word " * 60_000, "x" * 300_000]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(7, texts[5], "again", 0)] * 2 + [(None, texts[20], "", 1), (None, None, "", 1), (-3, texts[20], "", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string, n int").repartition(3)
    made = fill_middle.fill_in_middle(df).withColumn("restored", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made], key=key)
    assert got == sorted([(r[0], *model(r[0], r[1])) for r in rows], key=key)
    assert sorted(r.restored for r in made) == sorted(t[1] or "" for t in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fill_middle.digests(df.limit(0)).count() == 0


def test_crowds_and_equal_digests(spark, monkeypatch):
    """A text that fills a third of the rows, groups in parts, and different texts whose digests are the same."""
    monkeypatch.setattr(fill_middle, "CROWD", 5)
    monkeypatch.setattr(fill_middle, "GATHERED", 2000)
    grouped = list(fill_middle._grouped(iter(spark.createDataFrame([(i, "same text here" if i % 3 == 0 else f"text {i % 50} is here") for i in range(600)], "doc_id bigint, text string").toArrow().to_batches())))
    parts = [p for b in grouped for p, ids in zip(b.column("part").to_pylist(), b.column("ids").to_pylist()) if len(ids) > 5]
    assert parts and 0 not in parts and len(set(parts)) > 1
    assert sorted(i for b in grouped for ids in b.column("ids").to_pylist() for i in ids) == list(range(600))
    cut = fill_middle._cut(42, 50, 80)
    rows = [{"key": b"k", "part": 0, "text": t, "ids": [i]} for i, t in enumerate(["a b c", "d e f g", "a b c", "d e f g h"])]
    import pyarrow as pa

    out = [r for b in cut(iter([pa.RecordBatch.from_pylist(rows, fill_middle._GROUP)])) for r in b.to_pylist()]
    assert [(r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out] == [model(i, r["text"]) for i, r in enumerate(rows)]
