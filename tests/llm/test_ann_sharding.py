"""Nearest neighbours and sharding against brute force."""

import numpy as np
from pyspark.sql import functions as F

from presflow.llm import ann, sharding


def brute(ids, x, k, query):
    out = {}
    for q in np.flatnonzero(query(ids)):
        s = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 700)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 24))
    x = (centres[rng.integers(0, 30, 2000)] + 0.4 * rng.standard_normal((2000, 24))).astype(np.float32).astype(float)
    x[5::40] = x[5]  # many equal vectors
    ids = np.arange(2000) * 2
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>, rank int")
    got = ann.search(df, F.col("vec_id") % 20 == 0, 10).toPandas()
    want = brute(ids, x, 10, lambda i: i % 20 == 0)
    hits = sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hits / sum(map(len, want.values())) >= 0.95 and len(got) == 10 * len(want)
    place = {int(i): n for n, i in enumerate(ids)}
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert np.allclose(g.score, [(x[place[v]] * x[place[q]]).sum() for v in g.vec_id], atol=1e-12)
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 20 == 0, 20).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got)] == [(0, 1, 1), (0, 2, 9), (0, 3, 20), (20, 1, 1), (20, 2, 9), (20, 3, 0)]
    assert ann.search(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_flow_fills_every_shard():
    rng = np.random.default_rng(1)
    points, owner = sharding.ring(7, 16)
    for n in (0, 1, 6, 500):
        counts = np.bincount(rng.integers(0, len(points), n), minlength=len(points)).tolist()
        runs = sharding.flow(counts, owner, sharding.bounds(n, 7))
        assert sum(b - a for _, a, b, _, _ in runs) == n
        seen = sorted((arc, r) for arc, a, b, _, _ in runs for r in range(a, b))
        assert seen == [(arc, r) for arc, c in enumerate(counts) for r in range(c)]


def test_shards(spark):
    rows = [(i, None if i % 7 == 0 else "é" * (i % 50), i) for i in range(3000)] + [(5, "again", 1), (5, "again", 1), (None, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    got = sharding.shard(df, shards=10).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 10
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert set(got[got.doc_id == 8]["size"]) == {16 + 16} and set(got[got.doc_id == 7]["size"]) == {16}
    more = sharding.shard(df, shards=11).toPandas().merge(got, on="doc_id", suffixes=("_new", "_old"))
    assert (more.shard_new != more.shard_old).mean() < 0.35
    assert sharding.shard(df.limit(0), shards=10).count() == 0


def test_walk_around_the_ring():
    """Every key goes to its point's shard while that has room; those left over go on clockwise, in order, to the first shard with room."""
    rng = np.random.default_rng(5)
    points, owner = sharding.ring(6, 8)
    keys = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, 200, dtype=np.int64))
    arcs = np.searchsorted(points, keys) % len(points)
    counts = np.bincount(arcs, minlength=len(points)).tolist()
    room = sharding.bounds(len(keys), 6)
    free, at_home, waiting, placed = room[:], [], [], {}
    for arc, n in enumerate(counts):
        for rank in range(n):
            if free[owner[arc]]:
                free[owner[arc]] -= 1
                placed[arc, rank] = owner[arc]
                at_home.append((arc, rank))
            else:
                waiting.append((arc, rank))
    # the walk: pass each arc twice, taking up those that wait and come from an arc before it
    queue, coming = [], {a: [k for k in waiting if k[0] == a] for a in range(len(points))}
    for lap in range(2):
        for arc in range(len(points)):
            while queue and free[owner[arc]]:
                placed[queue.pop(0)] = owner[arc]
                free[owner[arc]] -= 1
            if lap == 0:
                queue += coming[arc]
    runs = sharding.flow(counts, owner, room)
    assert {(arc, r): s for arc, a, b, s, _ in runs for r in range(a, b)} == placed and not queue
