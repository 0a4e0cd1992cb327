"""Operators that settle in rounds or by blocks, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from presflow.operators import audits, graphs, intervals, logs
from presflow.operators import vectors as V


def vectors(n, dim, clusters, seed, spread=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    x = centres[rng.integers(0, clusters, n)] / np.sqrt(dim) + spread * rng.standard_normal((n, dim)) / np.sqrt(dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("clusters, spread, eps, pruned", [(30, 0.08, 0.03, True), (3, 1.0, 0.4, False)])
def test_metric_index_is_exact(spark, clusters, spread, eps, pruned):
    x = vectors(1500, 16, clusters, 2, spread)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, u array<double>")
    figures = []
    got = {(r.a, r.b) for r in V.metric_links(df, "vec_id", "u", 1 - eps, 100, figures).collect()}
    i, j = np.nonzero(np.triu(x @ x.T >= 1 - eps, 1))
    assert got == set(zip(i.tolist(), j.tolist())) and len(got) > 50
    if pruned:
        assert figures[0][0] < 0.6 * figures[0][1], figures


def test_first_independent(spark):
    rng = random.Random(8)
    for n, m in ((12, 9), (40, 120), (1, 0)):
        edges = list({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
        kept = []
        for i in range(n):
            if not any((k, i) in edges for k in kept):
                kept.append(i)
        nodes = spark.createDataFrame([(i,) for i in range(n)], "node bigint")
        got = graphs.first_independent(nodes, spark.createDataFrame(edges, "a bigint, b bigint")).collect()
        assert sorted(r.node for r in got) == kept


def test_debounce(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(-500, 40_000)) for k in ("a", "b") for _ in range(600)] + [("c", 5), ("c", 5), ("d", None), (None, 7), (None, 9), ("e", 10**9), ("e", 3)]
    df = spark.createDataFrame(rows, "k string, at bigint")
    want = []
    for key in {r[0] for r in rows}:
        last = None
        for at in sorted({r[1] for r in rows if r[0] == key and r[1] is not None}):
            if last is None or at - last >= 30:
                last = at
                want.append((key, at))
    got = [(r.k, r.at) for r in intervals.debounce(df, ["k"], "at", 30).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_running_stats(spark):
    rng = random.Random(4)
    rows = [(k, o, rng.choice([None, rng.uniform(-5, 5)])) for k in "ab" for o in range(500)] + [("c", 1, 2.0), ("d", None, 1.0)]
    got = {r.k: r for r in logs.running_stats(spark.createDataFrame(rows, "k string, o bigint, x double"), ["k"], "o", "x", 0.3, 16, 4).collect()}
    for key in "abc":
        xs = [x for k, o, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)) if k == key and x is not None and o is not None]
        m = xs[0]
        for x in xs:
            m = 0.3 * x + 0.7 * m
        assert np.allclose([got[key].ema, got[key].n, got[key].mean, got[key].sigma], [m, len(xs), np.mean(xs), np.std(xs, ddof=1) if len(xs) > 1 else 0.0])
    assert "d" not in got


def test_consolidation_leaves_a_doubtful_name_alone(spark):
    angle = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    rows = [(1, "A", 1.0, angle(0)), (2, "A", 1.0, angle(35)), (3, "A", 1.0, angle(-35))]  # the outer two are apart
    rows += [(4, "B", 1.0, angle(0)), (5, "B", 1.0, angle(35)), (6, "B", 1.0, None), (7, "B", 0.9, angle(0)), (8, None, 1.0, angle(0)), (9, "Unknown", 1.0, angle(0)), (10, "Unknown", 1.0, angle(0))]
    rows += [(11, "C", 1.0, angle(0)), (12, "C", 1.0, angle(0)), (13, "D", 1.0, angle(0)), (14, "D", 1.0, angle(0)), (15, "D", 1.0, angle(0))]
    clusters = spark.createDataFrame(rows, "cluster_id bigint, name string, confidence double, centroid array<double>")
    cannot = spark.createDataFrame([(12, 11), (13, 14), (14, 13)], "a bigint, b bigint")
    got = sorted(map(tuple, audits.consolidate(clusters, 0.75, cannot).collect()))
    assert got == [(5, 4), (6, 4), (14, 13), (15, 13)]  # C's two are kept apart; D's third ties all three


def test_null_and_ragged_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.1]), (3, 1, None), (4, 1, [None, 1.0]), (5, 1, [0.0, 1.0]), (6, 1, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    assert [(r.a, r.b) for r in V.near_links(df, 0.1).collect()] == [(1, 2)]
    assert {r.vec_id for r in V.silhouette(df).collect()} >= {1, 2, 5}
    assert V.impurity(df, 0.5, 0.1).count() == 2 and V.nearest_distances(df, 1).count() >= 3
    bank = spark.createDataFrame([("P", 1, [1.0, 0.0]), ("P", 2, [0.0, 1.0]), ("Q", 3, None), ("R", 4, [-1.0, 0.0])], "identity string, proto_id bigint, embedding array<double>")
    sims = {(r.vec_id, r.label): round(r.sim, 6) for r in V.identity_sims(df, bank, ["vec_id"]).collect()}
    assert sims == {(1, "P"): 1.0, (1, "R"): -1.0, (2, "P"): 1.0, (2, "R"): -1.0, (5, "P"): 1.0, (5, "R"): 0.0, (6, "P"): 0.0, (6, "R"): 0.0}
    frames = df.withColumn("identity", F.lit("P"))
    assert V.frame_confidence(frames, bank, 0.5).count() == 6
    ragged = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [1.0, 0.1])], "vec_id bigint, label int, embedding array<double>")
    with pytest.raises(Exception, match="components can't be multiplied"):
        V.near_links(ragged, 0.1).collect()


def test_expanded_pairs_are_told_once(spark):
    """Against a loop, with tracks in several clusters; pairs of the others are not looked through again."""
    rng = random.Random(5)
    rows = [(t, t % 7, f"N{t % 7 % 3}") for t in range(60)] + [(t, 7 + t % 2, "N0") for t in (3, 4, 50)]
    asked = set(rng.sample(range(60), 12)) | {3}
    named = spark.createDataFrame([(*r, None) for r in rows], "track_id bigint, cluster_id bigint, name string, confidence double")
    want = {("must" if must else "cannot", min(a, b), max(a, b)) for a, c, n in rows if a in asked for b, d, m in rows if a != b for must in (True, False) if (c == d if must else n != m)}
    got = [tuple(r) for r in graphs.expanded(named, spark.createDataFrame([(t,) for t in asked], "track_id bigint")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plain = graphs.expanded(named.filter("cluster_id < 7"), spark.createDataFrame([(t,) for t in asked], "track_id bigint"))
    assert plain._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
