"""Passes over all pairs of vectors, block by block, against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from presflow.operators import audits, graphs, intervals
from presflow.operators import vectors as V


def rows(spark, n, dim, groups, spread, seed, parts=7):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((groups, dim))[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    more = [(n, [0.0] * dim), (n + 1, None), (n + 2, [None, *[1.0] * (dim - 1)])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + more, "vec_id bigint, embedding array<double>")
    return x, df.repartition(parts)


def roots(links, nodes):
    at = {i: i for i in nodes}
    find = lambda i: i if at[i] == i else find(at[i])
    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def clusters(near, least):
    """DBSCAN of a matrix of near pairs, without the diagonal."""
    core = near.sum(1) + 1 >= least
    root = roots(zip(*np.nonzero(np.triu(near & core & core[:, None]))), np.flatnonzero(core))
    for i in np.flatnonzero(~core):
        if (hubs := [root[j] for j in np.flatnonzero(near[i]) if core[j]]):
            root[i] = min(hubs)
    first = {}
    for i in sorted(root):
        first.setdefault(root[i], len(first))
    return {i: first[r] for i, r in root.items()}


def test_dbscans_without_pairs(spark):
    for n, groups, spread, radii, parts in ((500, 60, 0.3, [0.02, 0.08], 7), (300, 300, 1.0, [0.35, 0.5], 4), (90, 3, 0.05, [0.2], 1)):
        x, df = rows(spark, n, 8, groups, spread, n, parts)
        for eps, got in zip(radii, V.dbscans(df, radii, 4, graphs.components), strict=True):
            want = clusters((x @ x.T >= 1 - eps) & ~np.eye(n, dtype=bool), 4)
            assert {r.vec_id: r.cluster for r in got.collect()} == {i: want.get(i, -1) for i in range(n + 3)}
    assert {r.cluster for r in V.dbscan(df.filter("vec_id >= 90"), 0.2, 1, graphs.components).collect()} == {0, 1, 2}
    assert V.dbscan(df.limit(0), 0.2, 4, graphs.components).count() == 0


def test_links_that_connect_are_few(spark):
    x, df = rows(spark, 600, 8, 5, 0.1, 3)
    unit = df.select("vec_id", F.col("embedding").alias("u"))
    links = V.connecting(unit, "vec_id", "u", 0.9)
    pairs = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    want = roots(zip(*pairs), sorted({int(i) for i in np.concatenate(pairs)}))
    assert {r.node: r.component for r in graphs.components(links).collect()} == want
    assert links.count() <= 7 * 600 < len(pairs[0])


def test_kth_nearest(spark):
    x, df = rows(spark, 400, 8, 400, 1.0, 4)
    got = {r.vec_id: r.kth for r in V.nearest_distances(df.filter("vec_id < 400"), 6).collect()}
    want = np.sort(1 - x @ x.T, axis=1)[:, 5]
    assert len(got) == 400 and all(abs(got[i] - want[i]) < 1e-12 for i in got)
    assert V.nearest_distances(df.limit(3), 6).count() == 0 and V.nearest_distances(df.limit(0), 2).count() == 0


def test_set_similarity_by_blocks(spark):
    """Sets of several blocks, of a single row and of fewer rows than k, against products of all their rows; no join of rows with rows."""
    rng = np.random.default_rng(6)
    sets = [(t, rng.standard_normal((n, 4))) for t, n in ((0, 50), (1, 37), (2, 1), (3, 2))]
    data = [(t, 100 * t + i, v.tolist()) for t, x in sets for i, v in enumerate(x)] + [(0, 99, None), (4, 400, [None] * 4)]
    wanted = [(0, 1), (1, 0), (2, 3), (0, 0), (0, 4), (7, 1)]
    frame = spark.createDataFrame(data, "track_id bigint, vec_id bigint, u array<double>")
    out = V.set_similarity(frame, spark.createDataFrame(wanted, "track_id bigint, other bigint"), 5, block=16)
    x = dict(sets)
    want = {(a, b): float(np.sort((x[a] @ x[b].T).ravel())[-5:].mean()) for a, b in wanted if a in x and b in x}
    got = {(r.track_id, r.other): r.sim for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_adjacent_meets_in_short_bins(spark):
    """Against a loop, and with bins no longer than what an end looks at."""
    rng = np.random.default_rng(7)
    spans = [(i, int(s), int(s + d)) for i, (s, d) in enumerate(zip(rng.integers(-300, 3000, 200), rng.integers(0, 400, 200), strict=True))]
    df = spark.createDataFrame(spans, "track_id bigint, start_ms bigint, end_ms bigint")
    found = intervals.adjacent(df, df, 20)
    assert sorted(map(tuple, found.collect())) == sorted((i, j, s - e) for i, _, e in spans for j, s, _ in spans if i != j and 0 <= s - e <= 20)
    assert "21" in found._jdf.queryExecution().optimizedPlan().toString()


def test_greedy_distinct_in_several_rounds(spark, monkeypatch):
    """Against a loop, with rounds and parts of few rows, a key that is null, and rows without a whole vector; no pairs are looked for by links."""
    monkeypatch.setattr(audits, "FIRST", 8)
    monkeypatch.setattr(audits, "SPLIT", 30)
    x, df = rows(spark, 240, 6, 40, 0.4, 8)
    df = df.withColumn("track", F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 3))
    want = {240, 241, 242}
    for t in range(3):
        kept = []
        for i in range(t, 240, 3):
            if not any(x[i] @ x[j] >= 0.7 for j in kept):
                kept.append(i)
        assert len(kept) > 8
        want |= set(kept)
    monkeypatch.delattr(audits, "metric_links", raising=False)
    got = [(r.track, r.vec_id) for r in audits.greedy_distinct(df, ["track"], "vec_id", 0.7).collect()]
    assert len(got) == len(want) and {i for _, i in got} == want and all(t == (i % 3 or None) for t, i in got)
