"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

from presflow.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall(text.translate(LOWER)) if text else []


def model(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    n_docs = sum(1 for _, c in docs if c)
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for i, c in docs:
            if c:
                m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
                if s > 0:
                    scored.append((-s, i is None, i or 0, i))
        out += [(item_id, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def tables(n=600, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["ÉTÉ", "Zürich", "the"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    say = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    rows = [(i * 3 % 1801, say(rng.choice([0, 1, 5, 30, 80]))) for i in range(n)]
    rows += [(5000 + i, "the same W7 text w9") for i in range(n // 2)] + [(9000, None), (9001, ""), (9002, "?"), (None, "w7 w9 w9"), (5000, "the same W7 text w9"), (9003, say(30_000))]
    items = [(i, say(rng.choice([1, 3, 12, 40]))) for i in range(25)] + [(30, "same text w9 w9"), (31, None), (32, "absent"), (33, ""), (0, "W9 été"), (34, "w7"), (34, "w7")]
    return rows, items


def got(df):
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()], key=str)


def test_against_plain_scores(spark, monkeypatch):
    rows, items = tables()
    want = model(rows, items, 7)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, score int").repartition(3)
    queries = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, doc_id int")
    monkeypatch.setattr(lexical, "BLOCK", 8)
    monkeypatch.setattr(lexical, "RUN", 50)
    assert got(lexical.rank(docs, queries, 7)) == want
    monkeypatch.setattr(lexical, "SHARD_DOCS", 90)
    monkeypatch.setattr(lexical, "QUERY_BYTES", 300)  # several blocks of queries, over an index of all terms
    assert got(lexical.rank(docs, queries, 7)) == want
    assert lexical.rank(docs.limit(0), queries).count() == 0 and lexical.rank(docs, queries.limit(0)).count() == 0


def test_blocks_are_skipped(monkeypatch):
    """One document far above the rest: what can't reach it is not decompressed."""
    monkeypatch.setattr(lexical, "RUN", 16)
    rng = random.Random(2)
    shard = lexical.Shard(None)
    texts = [b"rare common w1" if i == 3 else b"common " + b" ".join(b"w%d" % rng.randint(2, 400) for _ in range(30 + i % 7)) for i in range(20_000)]
    for i, t in enumerate(texts):
        shard.add(i, t)
    n_docs, n_terms = len(texts), sum(len(t.split()) for t in texts)
    row = dict(zip(lexical._INDEX.names, shard.row(n_docs, n_terms), strict=True))
    searcher = lexical.Searcher(row, n_docs, n_terms)
    weights = {t: lexical.weight(n_docs, df) for t, df in zip(row["terms"], row["dfs"], strict=True) if t in (b"rare", b"common", b"w9")}
    best, scores = searcher.top(weights, 1)
    assert best.tolist() == [3] and len(scores) == 1
    assert searcher.opened < 12 < len(searcher.maxima[searcher.firsts[searcher.term[b"common"]] : searcher.firsts[searcher.term[b"common"] + 1]])
    assert [searcher.top({b"common": 5}, 3)[0].tolist()] == [sorted(range(20_000), key=lambda i: (len(texts[i].split()) if i != 3 else 3, i))[:3]]
