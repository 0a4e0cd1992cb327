"""The merge of a stream by batches, against the batch operator on all rows."""

import random

import pytest

from presflow.operators import intervals as I
from presflow.streaming import batches, presence

TRACK = "track_id bigint, person string, start_ms bigint, end_ms bigint, conf double, visible double, frames bigint"
COLUMNS = ["person", "start_ms", "end_ms", "conf", "visible", "frames", "members"]


@pytest.mark.parametrize("params", [I.MergeParams(gap=200, gap_max=300, conflict_guard=50), I.MergeParams(gap=200, gap_max=300, conflict_guard=50, lo_cap=150, hi_cap=280, min_visible=0.2)])
def test_merged_by_batches(spark, tmp_path, params):
    rng, rows, start = random.Random(11), [], 0
    for t in range(400):
        start += rng.choice([0, 5, 40, 120, 300])
        rows.append((t, f"P{rng.randrange(4)}", start, start + rng.choice([10, 80, 300, 5000 if t % 100 == 0 else 50]), rng.choice([0.5, 0.69, 0.7, 0.9]), rng.choice([0.1, 0.5, 0.9]), rng.randrange(1, 9)))
    want = {tuple(r) for r in I.timeline(I.adaptive_merge(spark.createDataFrame(rows, TRACK), params)).select(COLUMNS).collect()}
    local = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 3_000))
    local += [(9_000, "Q", 10_000_000, 10_000_001, 0.9, 0.9, 1)]
    run = lambda: batches.merged(presence.observations(spark, str(tmp_path / "in" / "*"), TRACK, 2), str(tmp_path / "out"), params, late_ms=4_000)
    for n, at in enumerate(range(0, len(local), 110)):
        spark.createDataFrame(local[at : at + 110], TRACK).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n:03d}"))
        if n == 1:  # started again from where it was
            assert {tuple(r) for r in run().collect()} < want
    late = (9_001, "P0", 0, 10**6, 0.9, 0.9, 1)  # comes too late
    run()
    spark.createDataFrame([late], TRACK).write.parquet(str(tmp_path / "in" / "part=999"))
    got = [tuple(r) for r in run().collect()]
    assert len(got) == len(set(got)) and set(got) == want
