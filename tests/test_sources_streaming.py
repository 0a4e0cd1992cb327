"""Readers, writers and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from presflow.sources import readers, sinks
from presflow.streaming import presence


def test_documents_lines_and_fallback(spark, tmp_path):
    path = tmp_path / "tracks.json"
    path.write_text(json.dumps({"tracks": [{"track_id": 1, "start_ms": 5, "end_ms": 9}, {"track_id": 2, "frame_refs": [{"frame_id": 3, "ts_ms": 40}, {"frame_id": 4, "ts_ms": 80}]}, {"track_id": 3}]}))
    rows = readers.repaired(readers.tracks(spark, str(path))).select("track_id", "start_ms", "end_ms").collect()
    assert sorted(map(tuple, rows)) == [(1, 5, 9), (2, 40, 80)]
    assert readers.tracks(spark, str(tmp_path / "none.json")) is None
    assert readers.metrics(spark, str(tmp_path / "none.json"), "m array<struct<person:string>>", "m", "person").columns == ["person"]
    log = tmp_path / "log.jsonl"
    log.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(log), "a bigint").collect()) == [1, 2]
    spark.range(3).write.parquet(str(tmp_path / "all"))
    assert readers.first_of(spark, str(tmp_path / "picked"), str(tmp_path / "all")).count() == 3
    assert readers.first_of(spark, str(tmp_path / "picked")) is None


def test_frames_config_files_vectors(spark, tmp_path):
    assert [tuple(r) for r in readers.sampled_frames(spark, 10, 30.0, 100).orderBy("frame_id").collect()] == [(0, 0), (3, 100), (6, 200), (9, 300)]
    assert readers.merged_config({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"c": 3}, "d": {"e": 1}}) == {"a": {"b": 1, "c": 3}, "d": {"e": 1}}
    (tmp_path / "c.json").write_text('{"x": {"y": 1}}')
    assert readers.config(spark, str(tmp_path / "c.json")) == {"x": {"y": 1}}
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.mp4").write_bytes(b"1")
    (tmp_path / "v" / "b.mp4").write_bytes(b"2")
    found = readers.new_files(spark, str(tmp_path / "v"), spark.createDataFrame([], "path string"))
    assert found.count() == 2
    assert readers.new_files(spark, str(tmp_path / "v"), found.limit(1)).count() == 1
    np.save(tmp_path / "v" / "e.npy", np.eye(2))
    assert sorted(tuple(r.embedding) for r in readers.vectors(spark, str(tmp_path / "v")).collect()) == [(0.0, 1.0), (1.0, 0.0)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    sinks.replace(df, str(tmp_path / "t"))
    sinks.replace(spark.read.parquet(str(tmp_path / "t")).filter("x = 2"), str(tmp_path / "t"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [(2, None)]
    sinks.append_lines(df, str(tmp_path / "l"))
    sinks.append_lines(df, str(tmp_path / "l"))
    assert readers.json_lines(spark, str(tmp_path / "l"), "x int, y string").count() == 4
    assert sinks.report(df, df, df, str(tmp_path / "r")) in ("csv", "xlsx")
    assert len(sinks.with_hash(df, "x", "y").first().hash) == 12


@pytest.mark.parametrize("kind", ["windows", "sessions", "identities"])
def test_streams(spark, tmp_path, kind):
    if kind == "identities":
        rows = [(0, f, t, [1.0, 0.0] if t == 1 else [0.0, 1.0]) for f in range(6) for t in (1, 2)]
        spark.createDataFrame(rows, "episode_id bigint, frame_id bigint, track_id bigint, embedding array<double>").write.parquet(str(tmp_path / "in"))
        stream = presence.observations(spark, str(tmp_path / "in"), "episode_id bigint, frame_id bigint, track_id bigint, embedding array<double>")
        out = presence.identities(stream, [("A", [1.0, 0.0]), ("B", [0.0, 1.0])])
    else:
        rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 10 + F.floor(F.col("id") / 50) * 5000).alias("ts"), (F.col("id") % 2).alias("person"), F.col("id").cast("double").alias("value"))
        rows.write.parquet(str(tmp_path / "in"))
        stream = presence.observations(spark, str(tmp_path / "in"), "ts timestamp, person bigint, value double")
        out = presence.windowed(stream, "ts", ["person"], "1 minute") if kind == "windows" else presence.sessions(stream, "ts", ["person"], "30 seconds")
    q = out.writeStream.outputMode("append" if kind == "identities" else "complete").format("memory").queryName(kind).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table(kind).collect()
    if kind == "windows":
        assert sum(r.n for r in got) == 100
    elif kind == "sessions":
        assert sorted((r.person, r.n) for r in got) == [(0, 25), (0, 25), (1, 25), (1, 25)]
    else:
        assert {(r.track_id, r.label_after) for r in got} == {(1, "A"), (2, "B")} and len(got) == 12
