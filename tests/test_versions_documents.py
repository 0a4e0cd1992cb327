"""Versioned tables, the data source of documents, and components kept up to date."""

import json
import random
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from presflow.operators import graphs
from presflow.sources import documents, versions


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.table(spark, path) is None and versions.latest(spark, path) == 0
    assert versions.commit({"table": spark.range(3), "other": spark.range(1)}, path) == 1
    pinned = versions.table(spark, path)
    assert versions.commit({"table": pinned.unionByName(spark.range(10, 12))}, path, begun_from=1) == 2
    assert pinned.count() == 3 and versions.table(spark, path).count() == 5 and versions.table(spark, path, "other").count() == 1
    with pytest.raises(versions.Conflict):  # made of version 1, which is not the last
        versions.commit({"table": spark.range(9)}, path, begun_from=1)
    assert versions.table(spark, path, version=1).count() == 3
    assert versions.vacuum(spark, path, keep=1) == 1 and versions.latest(spark, path) == 2
    assert versions.table(spark, path).count() == 5 and versions.table(spark, path, "other").count() == 1


def test_two_writers_and_crashes(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.commit({"table": spark.range(3)}, path)
    first = versions._numbers
    # another writer commits between this one's data and its manifest
    calls = []

    def raced(s, p):
        calls.append(1)
        if len(calls) == 3:
            with mock.patch.object(versions, "_numbers", first):
                versions.commit({"table": spark.range(7)}, path)
        return first(s, p)

    with mock.patch.object(versions, "_numbers", raced), pytest.raises(versions.Conflict):
        versions.commit({"table": spark.range(9)}, path)
    assert versions.table(spark, path).count() == 7
    assert len(list((tmp_path / "t").glob("data-*"))) == 2  # the loser's folder is gone
    # a writer that ends before its manifest, and one that ends within it
    bad = spark.range(4).select(F.raise_error(F.lit("crash")).alias("x"))
    with pytest.raises(Exception):
        versions.commit({"table": bad}, path)
    (tmp_path / "t" / "manifest" / f"{3:012d}").write_text('{"tables": {"ta')
    assert versions.table(spark, path).count() == 7 and versions.latest(spark, path) == 2
    assert versions.commit({"table": spark.range(8)}, path) == 4 and versions.table(spark, path).count() == 8


def test_documents_source(spark, tmp_path):
    for i in range(4):
        refs = [{"frame_id": 1, "det_idx": 0}]
        (tmp_path / f"e{i}.json").write_text(json.dumps({"tracks": [{"track_id": 10 * i + j, "start_ms": j, "frame_refs": refs} for j in range(3)], "clusters": [{"cluster_id": i, "track_ids": [1, 2], "quality_score": 1}]}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "none.json").write_text("[]")
    np.save(tmp_path / "a.npy", np.eye(2))
    np.savez(tmp_path / "b.npz", embeddings=np.ones((3, 2)), qualities=np.array([0.1, 0.2, 0.3]))
    source = documents.register(spark).read.format("presence_documents")
    tracks = source.option("kind", "tracks").load(str(tmp_path))
    assert tracks.count() == 12 and {r.file for r in tracks.collect()} == {"e0", "e1", "e2", "e3"}
    assert tracks.select(F.from_json("frame_refs", "array<struct<frame_id:bigint,det_idx:int>>")[0]["frame_id"].alias("f")).distinct().collect()[0].f == 1
    clusters = source.option("kind", "clusters").load(str(tmp_path))
    assert sorted((r.cluster_id, r.quality_score, r.track_ids) for r in clusters.collect()) == [(i, 1.0, [1, 2]) for i in range(4)]
    vectors = source.option("kind", "vectors").load(str(tmp_path))
    assert sorted((r.file, r.row, r.quality) for r in vectors.collect()) == [("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 0.1), ("b", 1, 0.2), ("b", 2, 0.3)]


def test_filters_choose_files(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"e{i}.json").write_text(json.dumps({"tracks": [{"track_id": i}]}))
    (tmp_path / "e9.json").write_bytes(b"\xff\xfe not text, and never opened")
    source = documents.register(spark).read.format("presence_documents").load(str(tmp_path))
    some = source.filter("file in ('e1', 'e3') and track_id < 9")
    assert sorted(r.track_id for r in some.collect()) == [1, 3] and [r.track_id for r in source.filter("file = 'e4'").collect()] == [4]
    # what is pushed down is left to the source alone
    plan = source.filter("file = 'e4'")._jdf.queryExecution().optimizedPlan().toString()
    assert "e4" not in plan
    reader = documents._Reader({"path": str(tmp_path)}, [])
    list(reader.pushFilters([documents.EqualTo(("file",), "e2")]))
    assert [n for p in reader.partitions() for n in p.names] == [str(tmp_path / "e2.json")]


def test_components_after(spark):
    rng = random.Random(3)
    edges, labels = set(), spark.createDataFrame([], "node bigint, component bigint")
    frame = lambda e: spark.createDataFrame(sorted(e), "a bigint, b bigint")
    for n_new, n_lost in ((14, 0), (4, 3)):
        new = {tuple(sorted(rng.sample(range(24), 2))) for _ in range(n_new)}
        lost = set(rng.sample(sorted(edges), n_lost)) | {(0, 23)}
        labels = graphs.components_after(labels, frame(edges), frame(new), frame(lost)).checkpoint()
        edges = edges - (lost - new) | new
        known = {r.node: r.component for r in labels.collect()}
        want = {n: n for n in known}
        for _ in range(60):
            for a, b in edges:
                want[a] = want[b] = min(want[a], want[b])
        assert known == want
