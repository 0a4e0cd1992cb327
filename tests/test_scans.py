"""Two-level scans and dyadic joins against plain loops, and the plans they make."""

import random

import pytest
from pyspark.sql import functions as F

from presflow.operators import intervals as I
from presflow.operators import scans


def rows(n=400, seed=3):
    rng = random.Random(seed)
    out = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 300, 7)]), i, rng.choice([None, 1, 5, 9])) for i in range(n)]
    return out + [("once", 50, n, 4)]


@pytest.mark.parametrize("width", [1, 40, 10_000])
def test_scan_against_loops(spark, width):
    data = rows()
    df = spark.createDataFrame(data, "k string, at bigint, id bigint, v bigint")
    steps = {"largest": scans.before(F.col("v")), "total": scans.upto(F.col("v")), "least_after": scans.after(F.col("v")), "next": scans.following(F.col("v")), "last": scans.preceding(F.col("id"))}
    got = {r.id: r for r in scans.scan(df, ["k"], ["at", "id"], width, **steps).collect()}
    assert len(got) == len(data)
    for key in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for i, r in enumerate(own):
            known = lambda some: [x[3] for x in some if x[3] is not None]
            want = (max(known(own[:i]), default=None), sum(known(own[: i + 1])), min(known(own[i + 1 :]), default=None), own[i + 1][3] if i + 1 < len(own) else None, own[i - 1][2] if i else None)
            g = got[r[2]]
            assert (g.largest, g.total, g.least_after, g.next, g.last) == want, r


def test_no_task_holds_a_person(spark):
    """The long side is never dealt by person alone, and both levels read one shuffle."""
    spark.createDataFrame([(i, f"P{i % 2}", i * 40, i * 40 + 60, 0.9, 0.5, 3) for i in range(2000)], "track_id bigint, person string, start_ms bigint, end_ms bigint, conf double, visible double, frames bigint").createOrReplaceTempView("tracks_of_two")
    tracks = spark.table("tracks_of_two")
    for made in (I.adaptive_merge(tracks), I.islands(tracks, ["person"], 30), I.gaps(tracks, ["person"]), I.nearest_after(tracks, ["person"], 100), I.audit_gaps(tracks, 100_000, 500)):
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "hashpartitioning(person#" not in plan and "SinglePartition" not in plan
        by_key = [line for line in plan.splitlines() if "hashpartitioning(_key#" in line and "_bin#" not in line]
        assert all("Exchange" in line for line in by_key) and "ReusedExchange" in plan  # what is dealt by key alone are bins


def test_dyadic_join(spark):
    rng = random.Random(5)
    some = lambda n: [(i, rng.choice("xy"), s := rng.randrange(0, 40_000), s + rng.choice([0, 1, 30, 600, 20_000, -5])) for i in range(n)]
    a, b = some(150) + [(999, "x", 0, 10_000_000), (1000, "y", None, 5)], some(120) + [(998, "x", -4_000, 39_000)]
    fields = "id bigint, k string, start_ms bigint, end_ms bigint"
    met = (F.col("l.start_ms") <= F.col("r.end_ms") + 7) & (F.col("r.start_ms") - 7 <= F.col("l.end_ms"))
    for on in (None, ["k"]):
        pairs = I.range_join(spark.createDataFrame(a, fields), spark.createDataFrame(b, fields), met, 20, on, 7).select("l.id", F.col("r.id").alias("other")).collect()
        # an interval that ends before it starts counts from its start on
        over = lambda x, y: x[2] <= max(y[3], y[2]) + 7 and y[2] - 7 <= max(x[3], x[2])
        want = [(x[0], y[0]) for x in a for y in b if x[2] is not None and x[2] <= y[3] + 7 and y[2] - 7 <= x[3] and over(x, y) and (on is None or x[1] == y[1])]
        assert sorted(map(tuple, pairs)) == sorted(want)


def test_a_long_interval_is_copied_to_few_nodes(spark):
    long, short = [(1, 0, 10_000_000)], [(i, i * 1000, i * 1000 + 900) for i in range(10_000)]
    l, r = (I._nodes(spark.createDataFrame(x, "id bigint, start_ms bigint, end_ms bigint"), 2_000, 0) for x in (long, short))
    levels = lambda df: sorted({x[0] for x in df.select("_level").distinct().collect()})
    assert levels(l) == [13] and levels(r) == [0]
    every = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda v: F.struct(v.alias("level"), F.lit(0).alias("tag")))
    assert I._at_levels(l, F.filter(every, lambda v: v["level"] >= F.col("_level")), 2_000).count() <= 2
    assert I._at_levels(r, every, 2_000).count() <= 2 * 14 * 10_000
    pairs = I.range_join(l, r, F.col("r.start_ms") < F.col("l.end_ms"), 2_000)
    assert pairs.count() == 10_000
