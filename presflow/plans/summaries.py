"""Queries of figures, frame-level mutations and logs, each with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import mutations as M
from ..operators import summaries as S
from ..operators import tracking as T
from ..operators import vectors as V
from ..sources.views import DETECTIONS, TRACKS, detections, tracks
from .assembly import TRACK_DOCS, references, track_docs
from .records import MEMBERS, members
from .vectors import TRACK_METRICS, UNIT, _track_metrics
from .registering import registry

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)


HELD = f"{TRACK_METRICS}, mem AS (SELECT i AS track_id, i % 9 AS cluster_id, CASE WHEN i % 9 < 6 THEN 'P' || (i % 9 % 4) END AS name, (i % 9) / 16.0::DOUBLE AS quality FROM range(0, 50) t(i))"


def _held(spark):
    c = F.col("id") % 9
    return spark.range(50).select(F.col("id").alias("track_id"), c.alias("cluster_id"), F.when(c < 6, F.format_string("P%d", c % 4)).alias("name"), (c / 16.0).alias("quality"))


@query(f"{HELD} SELECT cluster_id, coalesce(name, 'Unknown') AS name, count(*) AS tracks, round(coalesce(quantile_cont(p25, 0.5), 0), 6) AS p25_median, round(coalesce(min(p25), 0), 6) AS p25_min, 0.0::DOUBLE AS contam, coalesce(max(quality), 0) AS pairwise_sim FROM mem LEFT JOIN tm USING (track_id) GROUP BY 1, 2")
def plain_clusters(spark, sf_dir):
    return S.plain_clusters(_held(spark), _track_metrics(spark, sf_dir)).withColumn("p25_median", F.round("p25_median", 6)).withColumn("p25_min", F.round("p25_min", 6))


@query(f"{HELD} SELECT name AS person, count(DISTINCT cluster_id) AS n_clusters, count(p25) AS n_tracks, round(coalesce(quantile_cont(p25, 0.5), 0), 6) AS p25_median, 0.0::DOUBLE AS contam, 0.0::DOUBLE AS margin FROM mem LEFT JOIN tm USING (track_id) WHERE name IS NOT NULL GROUP BY 1")
def plain_persons(spark, sf_dir):
    return S.plain_persons(_held(spark), _track_metrics(spark, sf_dir)).withColumn("p25_median", F.round("p25_median", 6))


@query(f"{HELD}, st AS (SELECT i AS track_id, i * 100 AS start_ms, i * 100 + 50 AS end_ms FROM range(0, 30) t(i)) SELECT track_id, cluster_id, coalesce(name, 'Unknown') AS person, n_frames, round(p25, 6) AS p25, start_ms, end_ms FROM mem JOIN tm USING (track_id) LEFT JOIN st USING (track_id)")
def flat_tracks(spark, sf_dir):
    spans = spark.range(30).select(F.col("id").alias("track_id"), (F.col("id") * 100).alias("start_ms"), (F.col("id") * 100 + 50).alias("end_ms"))
    return S.flat_tracks(_held(spark), _track_metrics(spark, sf_dir), spans).select("track_id", "cluster_id", "person", "n_frames", F.round("p25", 6).alias("p25"), "start_ms", "end_ms")


@query(
    f"""WITH {TRACKS}, c AS (SELECT cluster_id, CASE WHEN cluster_id % 5 = 0 THEN 'unassigned' WHEN cluster_id % 7 > 0 THEN person END AS person, bool_or(track_id % 97 = 0) AS dirty, count(*) AS n, avg(conf) AS mean FROM tracks GROUP BY 1, 2)
 SELECT count(*) AS clusters, count(*) FILTER (person IS NOT NULL AND person <> 'unassigned') AS assigned, count(*) FILTER (person IS NULL OR person = 'unassigned') AS unassigned, count(*) FILTER (mean < 0.74) AS low_confidence, count(*) FILTER (dirty) AS dirty, CAST(sum(n) AS BIGINT) AS tracks FROM c"""
)
def workspace_counts(spark, sf_dir):
    c = F.col("cluster_id")
    rows = tracks(spark, sf_dir).select("cluster_id", "track_id", F.when(c % 5 == 0, "unassigned").when(c % 7 > 0, F.col("person")).alias("person"), (F.col("track_id") % 97 == 0).alias("dirty"), F.col("conf").alias("confidence"))
    return S.workspace_counts(rows, 0.74)


@query(
    """WITH s AS (SELECT user_id AS episode_id, CASE event_id % 2 WHEN 0 THEN 'detection' ELSE 'tracking' END AS step, 'n' || (event_id % 3) AS name, max(event_id) AS value FROM events GROUP BY ALL),
 v AS (SELECT episode_id, coalesce(max(value) FILTER (step = 'detection' AND name = 'n0'), 0) AS d0, coalesce(max(value) FILTER (step = 'detection' AND name = 'n1'), 0) AS d1, coalesce(max(value) FILTER (step = 'tracking' AND name = 'n2'), 0) AS t2 FROM s GROUP BY 1) SELECT episode_id, d0 AS detection_n0, d1 AS detection_n1, t2 AS tracking_n2 FROM v"""
)
def episode_summary(spark, sf_dir):
    e = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("episode_id"), F.when(e % 2 == 0, "detection").otherwise("tracking").alias("step"), F.format_string("n%d", e % 3).alias("name")).agg(F.max("event_id").alias("value"))
    out = S.episode_summary(rows, {"detection": ["n0", "n1"], "tracking": ["n2"]})
    return out.select("episode_id", F.col("detection.n0").alias("detection_n0"), F.col("detection.n1").alias("detection_n1"), F.col("tracking.n2").alias("tracking_n2"))


@query(f"WITH {MEMBERS}, l AS (SELECT * FROM m WHERE cluster_id NOT IN (2, 9) AND track_id % 10 <> 0) SELECT count(DISTINCT cluster_id) AS clusters, count(DISTINCT cluster_id) FILTER (name IS NOT NULL) AS named_clusters, count(DISTINCT name) AS persons, (SELECT count(*) FROM m WHERE track_id % 10 <> 0) AS tracks, (SELECT count(*) FROM m WHERE track_id % 10 = 0) AS deleted_tracks, 2::BIGINT AS deleted_clusters FROM l")
def status_counts(spark, sf_dir):
    rows = members(spark, sf_dir)
    return S.status_counts(rows.select("track_id"), rows, rows.filter("track_id % 10 = 0").select("track_id"), spark.createDataFrame([(2,), (9,)], "cluster_id bigint"))


@query(f"WITH {TRACKS}, d AS (SELECT end_ms - start_ms AS d FROM tracks), r AS (SELECT min(d) AS a, max(d) AS b FROM d) SELECT CAST(least(floor((d - a) / ((b - a) / 10.0::DOUBLE)), 9) AS INT) AS bin, count(*) AS count FROM d, r GROUP BY 1")
def duration_histogram(spark, sf_dir):
    return S.range_histogram(tracks(spark, sf_dir).select((F.col("end_ms") - F.col("start_ms")).alias("d")), "d")


@query(f"WITH {DETECTIONS}, e AS (SELECT frame_id, vec_id % 6 > 0 AS has FROM det) SELECT count(*) AS faces, count(*) FILTER (has) AS embedded, count(*) FILTER (has) / count(*) AS success, count(*) / count(DISTINCT frame_id) AS per_frame FROM e")
def embedding_stats(spark, sf_dir):
    return S.embedding_stats(detections(spark, sf_dir).withColumn("embedding", F.when(F.col("vec_id") % 6 > 0, F.col("embedding"))))


@query(f"WITH {DETECTIONS}, t AS (SELECT frame_id // 25 AS episode_id, track_id, count(*) AS n, (max(frame_id) - min(frame_id)) * 40 AS ms FROM det GROUP BY 1, 2) SELECT episode_id, count(*) AS tracks, coalesce(avg(ms) FILTER (n > 1), 0) AS mean_ms, avg(n) AS mean_frames FROM t GROUP BY 1")
def tracker_stats(spark, sf_dir):
    rows = detections(spark, sf_dir).select(F.floor(F.col("frame_id") / 25).alias("episode_id"), "track_id", (F.col("frame_id") * 40).alias("ts_ms"))
    return T.tracker_stats(rows, ["episode_id"])


@query("WITH s AS (SELECT user_id % 7 AS ord, quantile_cont(value, 0.5) AS median, count(*) AS samples FROM events GROUP BY 1) SELECT round(sum(CASE WHEN ord = 0 THEN greatest(0.0, median - 3.5) ELSE median END), 6) AS eta_seconds, CASE WHEN min(samples) >= 3 THEN 'high' WHEN min(samples) >= 1 THEN 'low' ELSE 'none' END AS confidence FROM s")
def step_eta(spark, sf_dir):
    steps = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy((F.col("user_id") % 7).alias("ord")).agg(F.percentile("value", F.lit(0.5)).alias("median"), F.count("*").alias("samples"))
    return S.eta(steps, 3.5).withColumn("eta_seconds", F.round("eta_seconds", 6))


@query(f"WITH {DETECTIONS}, s AS (SELECT track_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM det), v AS (SELECT track_id, i, var_pop(x) AS v, count(*) AS n FROM s GROUP BY 1, 2) SELECT track_id, max(n) AS n, round(CASE WHEN max(n) < 2 THEN 0 ELSE 1 / (1 + 10 * sqrt(sum(v))) END, 6) AS quality FROM v GROUP BY 1")
def steadiness(spark, sf_dir):
    return S.steadiness(detections(spark, sf_dir), ["track_id"]).withColumn("quality", F.round("quality", 6))


IMAGE = "vec_id % 700 AS sharpness, vec_id * 7 % 256 AS brightness, vec_id * 3 % 120 AS contrast, vec_id % 101 AS coverage"


@query(f"WITH {DETECTIONS}, i AS (SELECT vec_id, {IMAGE} FROM det) SELECT vec_id, round_even(least(sharpness / 500.0::DOUBLE, 1.0) * 40 + (1 - abs(brightness - 127) / 127) * 30 + least(contrast / 100.0::DOUBLE, 1.0) * 20 + least(coverage / 100.0::DOUBLE, 1.0) * 10, 1) AS quality FROM i")
def image_quality(spark, sf_dir):
    v = F.col("vec_id")
    return detections(spark, sf_dir).select("vec_id", S.image_quality(v % 700, v * 7 % 256, v * 3 % 120, v % 101).alias("quality"))


@query(
    f"""WITH {DETECTIONS}, c AS (SELECT track_id, vec_id, conf AS fiqa, (vec_id * 13 % 150)::DOUBLE AS sharpness, y2 - y1 AS height FROM det), p AS (SELECT *, fiqa >= 0.9 AND sharpness >= 110 AS ok, max(fiqa >= 0.9 AND sharpness >= 110) OVER (PARTITION BY track_id) AS any_ FROM c)
 SELECT track_id, vec_id, round(0.5 * fiqa + 0.3 * least(sharpness / 100.0, 1.0) + 0.2 * least(height / 150.0::DOUBLE, 1.0), 6) AS score FROM p WHERE ok OR NOT any_ QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY 0.5 * fiqa + 0.3 * least(sharpness / 100.0, 1.0) + 0.2 * least(height / 150.0::DOUBLE, 1.0) DESC, vec_id) = 1"""
)
def best_stills(spark, sf_dir):
    rows = detections(spark, sf_dir).select("track_id", "vec_id", F.col("conf").alias("fiqa"), (F.col("vec_id") * 13 % 150).cast("double").alias("sharpness"), (F.col("y2") - F.col("y1")).alias("height"))
    return S.best_still(rows, "track_id", "vec_id", 0.9, 110, (0.5, 0.3, 0.2)).select("track_id", "vec_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {DETECTIONS}, g AS (SELECT vec_id, x1 + 10.0::DOUBLE AS lx, x2 - 10.0::DOUBLE AS rx, y1 + 20.0::DOUBLE AS ey, x1 + (vec_id % 50)::DOUBLE AS nx, y1 + 40.0::DOUBLE AS ny FROM det),
 f AS (SELECT *, sqrt((lx - nx) ** 2 + (ey - ny) ** 2) AS a, sqrt((rx - nx) ** 2 + (ey - ny) ** 2) AS b FROM g) SELECT vec_id, round((nx - (lx + rx) / 2) / abs(rx - lx) * 90, 6) AS yaw, round(least(a, b) / (greatest(a, b) + 1e-6), 6) AS frontalness FROM f"""
)
def face_geometry(spark, sf_dir):
    lx, rx, ey = F.col("x1") + 10.0, F.col("x2") - 10.0, F.col("y1") + 20.0
    nx, ny = F.col("x1") + (F.col("vec_id") % 50).cast("double"), F.col("y1") + 40.0
    return detections(spark, sf_dir).select("vec_id", F.round(S.yaw(lx, rx, nx), 6).alias("yaw"), F.round(S.frontalness((lx, ey), (rx, ey), (nx, ny)), 6).alias("frontalness"))


@query(f"WITH {DETECTIONS}, f AS (SELECT frame_id // 10 AS span, (frame_id * 17 % 90)::DOUBLE AS sharpness, (frame_id * 5 % 9)::DOUBLE AS motion FROM (SELECT DISTINCT frame_id FROM det)) SELECT span, count(*) AS frames, quantile_cont(sharpness, 0.5) < 40 AS blurred, quantile_cont(motion, 0.5) < 3.5 AS low_motion FROM f GROUP BY 1")
def frame_flags(spark, sf_dir):
    frames = detections(spark, sf_dir).select("frame_id").distinct().select(F.floor(F.col("frame_id") / 10).alias("span"), (F.col("frame_id") * 17 % 90).cast("double").alias("sharpness"), (F.col("frame_id") * 5 % 9).cast("double").alias("motion"))
    return S.frame_flags(frames, ["span"])


REFS = f"{TRACK_DOCS}, mm AS (SELECT i % 4 AS cluster_id, i AS track_id, 'N' || (i % 4) AS name, 1.0::DOUBLE AS confidence, 0.25::DOUBLE AS quality FROM range(0, 45) t(i))"


def _tracks_of_refs(spark, sf_dir):
    refs = references(spark, sf_dir)
    docs = track_docs(spark, sf_dir).select("track_id", "start_ms", "end_ms", "count")
    rows = docs.select((F.col("track_id") % 4).alias("cluster_id"), "track_id", F.format_string("N%d", F.col("track_id") % 4).alias("name"), F.lit(1.0).alias("confidence"), F.lit(0.25).alias("quality"))
    return rows, docs, refs


def _parts(rows, docs, refs):
    """Members, tracks and references as rows of one shape."""
    none = F.lit(None).cast("bigint")
    return (
        rows.select(F.lit("member").alias("kind"), "track_id", F.col("cluster_id").cast("bigint").alias("a"), none.alias("b"))
        .unionByName(docs.select(F.lit("track").alias("kind"), "track_id", F.col("start_ms").cast("bigint").alias("a"), F.col("end_ms").cast("bigint").alias("b")))
        .unionByName(refs.select(F.lit("ref").alias("kind"), "track_id", F.col("frame_id").alias("a"), F.col("det_idx").cast("bigint").alias("b")))
    )


@query(f"WITH {REFS} SELECT track_id, frame_id, det_idx FROM refs WHERE NOT (track_id = 4 AND frame_id = 11)")
def delete_frame(spark, sf_dir):
    return M.delete_frame(_tracks_of_refs(spark, sf_dir)[2], 4, 11).select("track_id", "frame_id", "det_idx")


@query(
    f"""WITH {REFS} SELECT 'member' AS kind, track_id, cluster_id AS a, NULL::BIGINT AS b FROM mm UNION ALL SELECT 'member', 45, 3, NULL UNION ALL SELECT 'track', track_id, start_ms, end_ms FROM docs
 UNION ALL SELECT 'track', 45, start_ms, end_ms FROM docs WHERE track_id = 4 UNION ALL SELECT 'ref', CASE WHEN track_id = 4 AND frame_id = 11 THEN 45 ELSE track_id END, frame_id, det_idx FROM refs"""
)
def move_frame(spark, sf_dir):
    return _parts(*M.move_frame(*_tracks_of_refs(spark, sf_dir), 4, 11, 3))


@query(
    f"""WITH {REFS}, took AS (SELECT * FROM refs WHERE track_id = 4 AND frame_id IN (1, 11, 21)) SELECT 'member' AS kind, track_id, cluster_id AS a, NULL::BIGINT AS b FROM mm UNION ALL SELECT 'member', 45, 2, NULL UNION ALL SELECT 'track', track_id, start_ms, end_ms FROM docs
 UNION ALL SELECT 'track', 45, min(frame_id) * 40, max(frame_id) * 40 FROM took UNION ALL SELECT 'ref', CASE WHEN track_id = 4 AND frame_id IN (1, 11, 21) THEN 45 ELSE track_id END, frame_id, det_idx FROM refs"""
)
def split_frames(spark, sf_dir):
    rows, docs, refs = _tracks_of_refs(spark, sf_dir)
    return _parts(*M.split_frames(rows, docs, refs.withColumn("ts_ms", F.col("frame_id") * 40), 4, [1, 11, 21], "N2"))


@query(
    f"""WITH {DETECTIONS}, s AS (SELECT cluster_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM (SELECT track_id % 16 AS cluster_id, embedding FROM det WHERE track_id <> 7)), v AS (SELECT cluster_id, list(m ORDER BY i) AS v, max(n) AS n FROM (SELECT cluster_id, i, avg(x) AS m, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1),
 c AS (SELECT cluster_id, n, {UNIT.format(v='v')} AS c FROM v), p AS (SELECT a.cluster_id AS a, b.cluster_id AS b, list_dot_product(a.c, b.c) AS sim, a.n + b.n AS combined_size FROM c a JOIN c b ON a.cluster_id < b.cluster_id), r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, a, b) AS rank FROM p WHERE sim >= 0.05 ORDER BY rank LIMIT 100)
 SELECT a, b, round(sim, 4) AS sim, combined_size, rank FROM r WHERE a % 5 > 0 AND b % 5 > 0"""
)
def suggestions_again(spark, sf_dir):
    """Suggestions after a track was deleted, of clusters whose quality is good enough."""
    held = detections(spark, sf_dir).filter("track_id <> 7").withColumn("cluster_id", F.col("track_id") % 16)
    clusters = V.centroid(held, ["cluster_id"]).withColumnRenamed("n", "size")
    quality = clusters.select("cluster_id", F.when(F.col("cluster_id") % 5 > 0, 0.7).otherwise(0.5).alias("quality"))
    return C.sound(C.suggestions(clusters, 0.05), quality).withColumn("sim", F.round("sim", 4))


UNDO = """l AS (SELECT user_id AS owner, event_id AS seq, CASE WHEN event_type = 'view' THEN 'undo' ELSE event_type END AS action FROM events), s AS (SELECT *, sum(CASE WHEN action = 'undo' THEN -1 ELSE 1 END) OVER (PARTITION BY owner ORDER BY seq) AS t FROM l),
 v AS (SELECT *, t - least(0, min(t) OVER (PARTITION BY owner ORDER BY seq)) AS level FROM s)"""


@query(f"WITH {UNDO} SELECT owner, seq, action FROM v a WHERE action <> 'undo' AND NOT EXISTS (SELECT 1 FROM v b WHERE b.owner = a.owner AND b.seq > a.seq AND b.level < a.level)")
def standing_actions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "undo").otherwise(F.col("event_type")).alias("action"))
    return M.standing(rows, ["owner"])


@query(f"WITH {UNDO}, k AS (SELECT owner, seq, action FROM v a WHERE action <> 'undo' AND NOT EXISTS (SELECT 1 FROM v b WHERE b.owner = a.owner AND b.seq > a.seq AND b.level < a.level)) SELECT owner, seq, row_number() OVER (PARTITION BY owner ORDER BY seq DESC) AS nth FROM k QUALIFY nth <= 10")
def undoable_actions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "undo").otherwise(F.col("event_type")).alias("action"))
    return M.undoable(rows, ["owner"]).select("owner", "seq", F.col("nth").cast("bigint").alias("nth"))


@query("WITH l AS (SELECT event_id AS seq, event_type AS action FROM events WHERE user_id > 3) SELECT seq, action FROM l UNION ALL SELECT (SELECT max(seq) FROM l) + 1 + i, 'move' FROM range(0, 5) t(i)")
def action_log(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id > 3").select(F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("event_type").alias("action"), F.lit("x").alias("target"), F.lit(True).alias("done"))
    new = spark.range(5).select(F.col("id").alias("nth"), F.lit("move").alias("action"), F.lit("y").alias("target"), F.lit(True).alias("done"))
    return M.logged(log, new, F.lit("2024-02-01").cast("timestamp_ntz")).select("seq", "action")


@query(
    """WITH e AS (SELECT o_orderkey AS episode_id, o_orderkey % 10 AS clusters_at, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 8 END AS totals_at FROM orders), m AS (SELECT DISTINCT o_orderkey AS episode_id FROM orders WHERE o_orderkey % 6 = 1)
 SELECT episode_id, m.episode_id IS NOT NULL AS is_dirty, CASE WHEN m.episode_id IS NOT NULL THEN 'moved' ELSE '' END AS reason, m.episode_id IS NULL AND coalesce(totals_at > clusters_at, false) AS is_fresh FROM e LEFT JOIN m USING (episode_id)"""
)
def analytics_freshness(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("episode_id"), (k % 10).alias("clusters_at"), F.when(k % 3 > 0, k % 8).alias("totals_at"))
    return M.freshness(rows, rows.filter("episode_id % 6 = 1").select("episode_id", F.lit("moved").alias("reason")))
