"""Queries over tracks in frame order.  SQL states what is relational; the tracker and re-identification have models in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import tracking as T
from ..operators import vectors as V
from ..sources.views import DETECTIONS, bank, detections
from .vectors import UNIT
from .registering import registry

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)


def _episodes(spark, sf_dir):
    return detections(spark, sf_dir).withColumn("episode_id", F.floor(F.col("frame_id") / 25).cast("bigint"))


@query()
def tracker(spark, sf_dir):
    return T.track(_episodes(spark, sf_dir), T.TrackerParams(match=0.2))


@query()
def hysteresis(spark, sf_dir):
    seeds = bank(spark, sf_dir).filter("bin_key = 0").select(F.col("identity").alias("label"), "embedding", "proto_id").groupBy("label").agg(F.min_by("embedding", "proto_id").alias("embedding")).orderBy("label")
    return T.reidentify(_episodes(spark, sf_dir), seeds, T.ReidParams(join=0.3, stay=0.25, spawn=0.2))


@query(
    f"""WITH {DETECTIONS}, t AS (SELECT vec_id AS track_id, frame_id * 40 AS start_ms, frame_id * 40 + (vec_id * 7) % 90 AS end_ms, {UNIT.format(v='embedding')} AS u FROM det),
 p AS (SELECT l.track_id, r.track_id AS linked_to, round(list_dot_product(l.u, r.u), 9) AS sim FROM t l JOIN t r ON (r.end_ms > l.end_ms OR r.end_ms = l.end_ms AND r.track_id > l.track_id) AND r.start_ms BETWEEN l.end_ms AND l.end_ms + 400),
 k AS (SELECT *, row_number() OVER w AS n, lead(sim) OVER w AS second FROM p WINDOW w AS (PARTITION BY track_id ORDER BY sim DESC, linked_to))
 SELECT track_id, linked_to, round(sim, 6) AS sim FROM k WHERE n = 1 AND sim >= 0.2 AND sim - coalesce(second, -1) >= 0.01"""
)
def stitch_links(spark, sf_dir):
    start = (F.col("frame_id") * 40).alias("start_ms")
    tracks = detections(spark, sf_dir).select(F.col("vec_id").alias("track_id"), start, (start + (F.col("vec_id") * 7) % 90).alias("end_ms"), V.l2_normalise("embedding").alias("prototype"))
    return T.stitch(tracks, 400, 0.2, 0.01, 1_000).withColumn("sim", F.round("sim", 6))


@query(f"WITH {DETECTIONS}, d AS (SELECT track_id, frame_id - lag(frame_id) OVER (PARTITION BY track_id ORDER BY frame_id, det_idx) AS step, frame_id FROM det) SELECT track_id, count(*) FILTER (step > 1) AS switches, round(count(*) / (max(frame_id) - min(frame_id) + 1), 3) AS stitch_score FROM d GROUP BY track_id")
def track_switches(spark, sf_dir):
    step = F.col("frame_id") - F.lag("frame_id").over(Window.partitionBy("track_id").orderBy("frame_id", "det_idx"))
    rows = detections(spark, sf_dir).select("track_id", "frame_id", step.alias("step"))
    return rows.groupBy("track_id").agg(F.count_if(F.col("step") > 1).alias("switches"), F.round(F.count("*") / (F.max("frame_id") - F.min("frame_id") + 1), 3).alias("stitch_score"))


@query(
    """WITH RECURSIVE a AS (SELECT p_partkey AS label, p_partkey // 3 AS alias FROM part WHERE p_partkey > 0 AND p_partkey % 4 <> 0), r AS (SELECT label, alias, 1 AS n FROM a UNION ALL SELECT r.label, a.alias, n + 1 FROM r JOIN a ON a.label = r.alias)
 SELECT label, max_by(alias, n) AS resolved FROM r GROUP BY label"""
)
def resolve_aliases(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return T.resolve_aliases(part.filter("p_partkey > 0 and p_partkey % 4 <> 0").select(F.col("p_partkey").alias("label"), F.floor(F.col("p_partkey") / 3).cast("bigint").alias("alias")))


@query(
    f"""WITH {DETECTIONS}, t AS (SELECT vec_id AS track_id, frame_id * 40 AS start_ms, frame_id * 40 + (vec_id * 7) % 90 AS end_ms, CASE WHEN vec_id % 3 > 0 THEN 'P' || (vec_id % 4) END AS identity, frame_id // 3 AS scene, {UNIT.format(v='embedding')} AS u FROM det),
 rules(identity, frozen, least, margin) AS (VALUES ('P1', true, NULL, NULL), ('P2', false, 0.1::DOUBLE, 0.0::DOUBLE)),
 p AS (SELECT l.track_id, l.identity, r.track_id AS linked_to, round(list_dot_product(l.u, r.u), 9) AS sim FROM t l JOIN t r ON (r.end_ms > l.end_ms OR r.end_ms = l.end_ms AND r.track_id > l.track_id) AND r.start_ms BETWEEN l.end_ms AND l.end_ms + 400
  AND (l.identity IS NULL OR r.identity IS NULL OR l.identity = r.identity) AND abs(l.scene - r.scene) <= 1),
 k AS (SELECT *, row_number() OVER w AS n, lead(sim) OVER w AS second FROM p WINDOW w AS (PARTITION BY track_id ORDER BY sim DESC, linked_to)),
 li AS (SELECT track_id, linked_to, sim FROM k LEFT JOIN rules USING (identity) WHERE n = 1 AND NOT coalesce(frozen, false) AND sim >= coalesce(least, 0.2) AND sim - coalesce(second, -1) >= coalesce(margin, 0.01)),
 b AS (SELECT linked_to AS track_id, arg_min(track_id, (-sim, track_id)) AS linked_from FROM li GROUP BY 1) SELECT track_id, linked_to, linked_from FROM (SELECT track_id, linked_to FROM li) FULL JOIN b USING (track_id)"""
)
def stitched_identities(spark, sf_dir):
    v, start = F.col("vec_id"), (F.col("frame_id") * 40).alias("start_ms")
    scene = F.floor(F.col("frame_id") / 3)
    rows = detections(spark, sf_dir).select(v.alias("track_id"), start, (start + (v * 7) % 90).alias("end_ms"), F.when(v % 3 > 0, F.format_string("P%d", v % 4)).alias("identity"), scene.alias("first_scene"), scene.alias("last_scene"), V.l2_normalise("embedding").alias("prototype"))
    rules = spark.createDataFrame([("P1", True, None, None), ("P2", False, 0.1, 0.0)], "identity string, freeze boolean, least double, margin double")
    return T.both_ways(T.stitch(rows, 400, 0.2, 0.01, 1_000, rules))


@query(
    """WITH k AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'SHOW_S' || p_size || '_E' || p_partkey WHEN 1 THEN 'SHOW-S' || p_size || '-E' || p_partkey ELSE 'SHOW' END AS key FROM part), s AS (SELECT *, CASE WHEN contains(key, '_') THEN string_split(key, '_') ELSE string_split(key, '-') END AS p FROM k)
 SELECT p_partkey, p[1] AS show, p[2] AS season, p[3] AS episode FROM s"""
)
def episode_parts(spark, sf_dir):
    k, size, n = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    key = F.when(k % 3 == 0, F.concat(F.lit("SHOW_S"), size, F.lit("_E"), n)).when(k % 3 == 1, F.concat(F.lit("SHOW-S"), size, F.lit("-E"), n)).otherwise("SHOW")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", key.alias("episode_id")).select("p_partkey", *T.episode_parts())
