"""Presence data made from the driver's tables: tracks from ``events``, detections and a bank of prototypes from ``embeddings``.

A second of event time counts as one "millisecond", which makes gaps as long as the thresholds of real episodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1704067200000000  # 2024-01-01


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, person, start_ms, end_ms, conf, visible and frames."""
    return tracks_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def track_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of the table's files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return tracks_of(spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet"))  # a pattern: the table may be one file


def tracks_of(events: DataFrame) -> DataFrame:
    events = events.select("event_id", "user_id", "ts", "value")
    start = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 1_000_000).cast("bigint")
    return events.select(
        F.col("event_id").alias("track_id"), F.format_string("P%d", F.col("user_id") % 7).alias("person"), start.alias("start_ms"),
        (start + F.floor(F.col("value") * 5).cast("bigint")).alias("end_ms"), (0.5 + (F.col("event_id") % 51) / 100.0).alias("conf"),
        ((F.col("event_id") % 11) / 10.0).alias("visible"), (F.col("event_id") % 13 + 1).alias("frames"), F.col("user_id").alias("cluster_id"),
    )


TRACKS = f"""tracks AS (
  SELECT event_id AS track_id, 'P' || (user_id % 7) AS person, s AS start_ms, s + CAST(floor(value * 5) AS BIGINT) AS end_ms,
         0.5::DOUBLE + (event_id % 51) / 100.0::DOUBLE AS conf, (event_id % 11) / 10.0::DOUBLE AS visible, event_id % 13 + 1 AS frames, user_id AS cluster_id
  FROM (SELECT *, CAST(floor((epoch_us(ts) - {EPOCH_US}) / 1000000) AS BIGINT) AS s FROM events))"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, det_idx, track_id, cluster_id, identity, box corners, conf and embedding."""
    v = F.col("vec_id")
    x, y = (v * 37) % 600, (v * 53) % 300
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.floor(v / 4).cast("bigint").alias("frame_id"), (v % 4).cast("int").alias("det_idx"), (v % 40).alias("track_id"), (v % 40 % 8).alias("cluster_id"),
        F.format_string("P%d", v % 40 % 8 % 5).alias("identity"), x.alias("x1"), y.alias("y1"), (x + 60 + (v * 7) % 90).alias("x2"), (y + 60 + (v * 11) % 90).alias("y2"),
        (0.4 + (v % 61) / 100.0).alias("conf"), F.col("embedding").cast("array<double>").alias("embedding"),
    )


DETECTIONS = """det AS (
  SELECT vec_id, vec_id // 4 AS frame_id, CAST(vec_id % 4 AS INT) AS det_idx, vec_id % 40 AS track_id, vec_id % 40 % 8 AS cluster_id, 'P' || (vec_id % 40 % 8 % 5) AS identity,
         (vec_id * 37) % 600 AS x1, (vec_id * 53) % 300 AS y1, (vec_id * 37) % 600 + 60 + (vec_id * 7) % 90 AS x2, (vec_id * 53) % 300 + 60 + (vec_id * 11) % 90 AS y2,
         0.4::DOUBLE + (vec_id % 61) / 100.0::DOUBLE AS conf, embedding::DOUBLE[] AS embedding FROM embeddings)"""


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """proto_id, identity, bin_key and embedding of every tenth vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 10 = 0")
    return rows.select(F.col("vec_id").alias("proto_id"), F.format_string("L%d", F.col("label")).alias("identity"), (F.col("vec_id") % 3).alias("bin_key"), F.col("embedding").cast("array<double>").alias("embedding"))


BANK = "bank AS (SELECT vec_id AS proto_id, 'L' || label AS identity, vec_id % 3 AS bin_key, embedding::DOUBLE[] AS embedding FROM embeddings WHERE vec_id % 10 = 0)"
