"""Operators that SQL does not state, and cases of others: by plain models."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from presflow.functions import text
from presflow.operators import clustering as C
from presflow.operators import mutations as M
from presflow.operators import registry as R
from presflow.operators import tracking as T
from presflow.operators import vectors as V
from presflow.sources import readers, sinks
from presflow.streaming import presence

MEMBERS = "cluster_id bigint, track_id bigint, name string, confidence double, quality double"


def test_choice_of_a_radius():
    row = lambda eps, score, impurity=0.1, passes=True: {"eps": eps, "score": score, "impurity": impurity, "passes": passes}
    assert C.choose([row(0.3, 0.2), row(0.32, 0.4), row(0.34, 0.9, passes=False)], 0.3) == (0.32, ["score"])
    assert C.choose([row(0.3, 0.2, passes=False), row(0.32, 0.4, passes=False)], 0.3) == (0.32, ["score"])
    # impure, and the knee lies where a floor holds: the best from the floor on
    assert C.choose([row(0.3, 0.9, 0.5), row(0.32, 0.4, 0.2), row(0.34, 0.3, 0.2)], 0.29) == (0.32, ["score", "floor"])
    # still impure: the purest of what is left
    assert C.choose([row(0.3, 0.9, 0.5), row(0.32, 0.4, 0.45), row(0.34, 0.3, 0.4)], 0.29) == (0.34, ["score", "floor", "guard"])
    assert C.choose([row(0.3, 0.9, 0.5), row(0.32, 0.4, 0.2)], 0.4) == (0.32, ["score", "guard"])
    assert C.candidates(0.3)[0] == 0.25 and C.candidates(0.3)[-1] >= 0.4 and C.candidates(0.9)[0] == 0.55 and C.candidates(0.1)[0] == 0.25


def test_refinement_is_greedy_in_order(spark):
    rng = np.random.default_rng(3)
    base = np.eye(4)[[0, 0, 1, 1, 2, 3]] + rng.normal(0, 0.05, (6, 4))
    rows = [(0, c, 10 * c + i, (base[c] + rng.normal(0, 0.05, 4)).tolist()) for c in range(6) for i in range(5)] + [(0, 0, 99, [0.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "episode_id bigint, cluster_id bigint, track_id bigint, embedding array<double>")
    got = {(r.track_id): (r.cluster_id, r.into) for r in C.refine(df, 0.35, 0.35).collect()}
    assert 99 not in got and {into for _, into in got.values()} == {0, 2, 4, 5}
    assert all(into == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}[c] for c, into in got.values()) and len(got) == 30


def test_products_against_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(90, 5)), rng.normal(size=(70, 5))
    frame = lambda m, n, v: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], f"{n} bigint, {v} array<double>")
    left, right = frame(a, "i", "u"), frame(b, "j", "v")
    got = {(r.i, r.j): r.sim for r in V.products(left, right, "u", "v", block=32).collect()}
    assert len(got) == 6300 and all(abs(got[i, j] - a[i] @ b[j]) < 1e-9 for i in range(90) for j in range(70))
    near = {(r.i, r.j) for r in V.products(left, right, "u", "v", best=3, block=32).collect()}
    assert all((i, j) in near for i in range(90) for j in np.argsort(-(a[i] @ b.T))[:3])
    rows = frame(a, "vec_id", "u")
    pairs = {(r.a, r.b) for r in V.pairs(rows, "vec_id", "u", 1.0).collect()}
    assert pairs == {(i, j) for i in range(90) for j in range(i + 1, 90) if a[i] @ a[j] >= 1.0}
    assert V.products(left.limit(0), right, "u", "v").count() == 0


def test_numbers_without_gaps(spark):
    got = sorted(tuple(r) for r in V.numbered(spark.range(0, 2000, 7).repartition(5), "id", "n").collect())
    assert got == [(7 * n, n) for n in range(len(got))]


def test_moving_tracks(spark):
    df = spark.createDataFrame([(1, 10, "A", 1.0, 0.5), (2, 20, None, None, 0.3)], MEMBERS)
    assert sorted(map(tuple, M.move(df, [10], 7).collect())) == sorted(map(tuple, df.collect()))  # there is no cluster 7
    assert sorted(r.cluster_id for r in M.move(df, [10], 2).collect()) == [2, 2]
    assert sorted(r.cluster_id for r in M.move(df, [10], -1).collect()) == [2, 3]


def test_moving_a_last_frame(spark):
    members = spark.createDataFrame([(1, 10, "A", 1.0, 0.5), (2, 20, None, None, 0.3)], MEMBERS)
    tracks = spark.createDataFrame([(10, 0, 40), (20, 40, 90)], "track_id bigint, start_ms bigint, end_ms bigint")
    refs = spark.createDataFrame([(10, 1, 0), (20, 1, 1), (20, 2, 0)], "track_id bigint, frame_id bigint, det_idx int")
    m, t, r = M.move_frame(members, tracks, refs, 10, 1, 2)
    assert sorted((x.cluster_id, x.track_id) for x in m.collect()) == [(2, 20), (2, 21)]
    assert sorted(map(tuple, t.collect())) == [(20, 40, 90), (21, 0, 40)] and sorted(map(tuple, r.collect())) == [(20, 1, 1), (20, 2, 0), (21, 1, 0)]
    for track, frame, to in ((10, 9, 2), (10, 1, 5)):  # no such frame, no such cluster
        m, t, r = M.move_frame(members, tracks, refs, track, frame, to)
        assert (m.count(), sorted(map(tuple, t.collect())), sorted(map(tuple, r.collect()))) == (2, sorted(map(tuple, tracks.collect())), sorted(map(tuple, refs.collect())))


def test_standing_actions(spark):
    rng = random.Random(4)
    log = [(o, s, rng.choice(["undo", "merge", "split"])) for o in range(4) for s in range(40)]
    stacks = {o: [] for o in range(4)}
    for o, s, action in log:
        if action != "undo":
            stacks[o].append(s)
        elif stacks[o]:
            stacks[o].pop()
    got = {o: [] for o in range(4)}
    for r in M.standing(spark.createDataFrame(log, "owner int, seq int, action string"), ["owner"]).collect():
        got[r.owner].append(r.seq)
    assert {o: sorted(s) for o, s in got.items()} == stacks


def test_detectors_by_name(spark):
    T.register_detector("halves", lambda: lambda frame: pd.DataFrame({"id": frame["id"], "half": frame["id"] / 2}))
    assert T.detect_with(spark.range(4), "halves", "id bigint, half double").agg(F.sum("half")).first()[0] == 3.0


def test_registry(spark):
    tables = [spark.createDataFrame([(s, i) for s in "AB" for i in range(2)], "show_id string, n int") for _ in range(3)]
    assert [t.count() for t in R.cascade(*tables, spark.createDataFrame([("A",)], "show_id string"))] == [2, 2, 2]


def test_text(spark):
    row = spark.createDataFrame([("../up/..a b*.mp4", [1, 2, 3, 4], [7], "The  Show")], "f string, ids array<int>, one array<int>, s string")
    got = row.select(text.safe_file_name(F.col("f")), text.cluster_list(F.col("ids")), text.cluster_list(F.col("one")), text.slug(F.col("s"), {"the_show": "show"}), text.display_name(text.slug(F.col("s")))).first()
    assert tuple(got) == ("a_b_.mp4", "Clusters 1, 2 +2 more", "Cluster 7", "show", "The Show")


def test_stored_index_and_vectors(spark, tmp_path):
    vectors = spark.createDataFrame([("A", [1.0, 0.0])], "label string, embedding array<double>")
    labels = spark.createDataFrame([("A", [1.0, 0.0], 1, 0.0, 0.0)], "label string, centroid array<double>, count bigint, mean_dist double, m2 double")
    assert readers.label_index(spark, str(tmp_path / "i")) is None
    sinks.label_index(vectors, labels, str(tmp_path / "i"))
    again = readers.label_index(spark, str(tmp_path / "i"))
    assert [df.count() for df in again] == [1, 1]
    np.savez(tmp_path / "b.npz", embeddings=np.eye(2), qualities=np.array([0.5, 0.7]))
    np.save(tmp_path / "a.npy", np.ones((1, 2)))
    assert sorted(r.quality for r in readers.vectors(spark, str(tmp_path)).collect()) == [0.5, 0.7, 1.0]
    empty = readers.metrics(spark, str(tmp_path / "none"), "m array<struct<cluster_id:bigint,x:double>>", "m", "cluster_id")
    assert empty.dtypes == [("cluster_id", "bigint")]
    assert readers.parsed(spark.createDataFrame([('{"a": 1}',), ("no",)], "j string"), "j", "a int").count() == 2


def test_replaced_tables_come_back(spark, tmp_path):
    path = tmp_path / "t"
    sinks.replace(spark.range(3), str(path))
    assert not sinks.restored(spark, str(path))
    path.rename(tmp_path / "t.abc.old")  # a crash between the renames
    assert sinks.restored(spark, str(path)) and spark.read.parquet(str(path)).count() == 3


def test_progress_and_restart(spark, tmp_path):
    told = []
    listener = presence.Progress(lambda query, batch, rows, rate: told.append(rows))
    spark.streams.addListener(listener)
    for n in (5, 7):
        spark.range(n).write.mode("append").parquet(str(tmp_path / "in"))
        presence.to_table(presence.observations(spark, str(tmp_path / "in"), "id bigint"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    spark.streams.removeListener(listener)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12 and sum(told) in (0, 5, 12)


def test_tracklets_are_stitched_in(spark):
    from presflow.operators import assembly

    fields = "track_id bigint, start_ms bigint, end_ms bigint, prototype array<double>"
    tracks = spark.createDataFrame([(1, 0, 100, [1.0, 0.0]), (2, 900, 1000, [1.0, 0.0]), (5, 2000, 2100, None)], fields)
    members = spark.createDataFrame([(7, 1), (7, 2), (8, 5)], "cluster_id bigint, track_id bigint")
    found = spark.createDataFrame([("A", 700, 800, [0.0, 1.0]), ("A", 300, 500, [1.0, 0.1]), ("Z", 1, 2, [1.0, 0.0])], "person string, start_ms bigint, end_ms bigint, prototype array<double>")
    names = spark.createDataFrame([("A", 7), ("B", 8)], "person string, cluster_id bigint")
    all_, held, links = assembly.restitched(tracks, members, found, names, 500, 0.8, 0.0)
    assert sorted((r.track_id, r.start_ms) for r in all_.collect()) == [(1, 0), (2, 900), (5, 2000), (6, 300), (7, 700)]
    assert sorted(map(tuple, held.collect())) == [(7, 1), (7, 2), (7, 6), (7, 7), (8, 5)]
    assert sorted((r.track_id, r.linked_to, r.linked_from) for r in links.collect()) == [(1, 6, None), (2, None, 6), (6, 2, 1)]
