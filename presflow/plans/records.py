"""Queries over mutations, logs and scalar functions, each with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import logs
from ..operators import mutations as M
from ..sources.views import TRACKS, tracks
from .registering import registry

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)


MEMBERS = """m AS (SELECT user_id % 12 AS cluster_id, event_id AS track_id, CASE WHEN user_id % 12 < 6 THEN 'N' || (user_id % 12 % 4) END AS name,
  CASE WHEN user_id % 12 < 3 THEN 1.0::DOUBLE END AS confidence, (user_id % 12) / 16.0::DOUBLE AS quality FROM events)"""


def members(spark, sf_dir):
    c = F.col("user_id") % 12
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return rows.select(c.alias("cluster_id"), F.col("event_id").alias("track_id"), F.when(c < 6, F.format_string("N%d", c % 4)).alias("name"), F.when(c < 3, F.lit(1.0)).alias("confidence"), (c / 16.0).alias("quality"))


@query(
    f"""WITH {MEMBERS} SELECT CASE WHEN cluster_id IN (2, 7) THEN 2 ELSE cluster_id END AS cluster_id, track_id, CASE WHEN cluster_id IN (2, 7) THEN 'Z' ELSE name END AS name, CASE WHEN cluster_id IN (2, 7) THEN 1.0 ELSE confidence END AS confidence,
 CASE WHEN cluster_id IN (2, 7) THEN round((SELECT avg(quality) FROM m WHERE cluster_id IN (2, 7)), 9) ELSE quality END AS quality FROM m"""
)
def merge_clusters(spark, sf_dir):
    return M.merge(members(spark, sf_dir), 2, 7, "Z").withColumn("quality", F.round("quality", 9))


@query(f"WITH {MEMBERS} SELECT CASE WHEN cluster_id = 3 THEN CASE WHEN track_id IN (5, 17, 100, 412) THEN 12 ELSE 13 END ELSE cluster_id END AS cluster_id, track_id, CASE WHEN cluster_id <> 3 THEN name END AS name, CASE WHEN cluster_id <> 3 THEN confidence END AS confidence, quality FROM m")
def split_cluster(spark, sf_dir):
    return M.split(members(spark, sf_dir), 3, [5, 17, 100, 412])


@query(f"WITH {MEMBERS} SELECT cluster_id, track_id, CASE WHEN cluster_id = 8 THEN 'NEW' ELSE name END AS name, CASE WHEN cluster_id = 8 THEN 1.0 ELSE confidence END AS confidence, quality FROM m")
def assign_name(spark, sf_dir):
    return M.assign_name(members(spark, sf_dir), 8, "NEW")


@query(f"WITH {MEMBERS}, x AS (SELECT *, track_id IN (1, 2, 3, 50) AS h FROM m) SELECT CASE WHEN h THEN 12 ELSE cluster_id END AS cluster_id, track_id, CASE WHEN NOT h THEN name END AS name, CASE WHEN NOT h THEN confidence END AS confidence, CASE WHEN h THEN 0.5 ELSE quality END AS quality FROM x")
def move_tracks_to_new(spark, sf_dir):
    return M.move(members(spark, sf_dir), [1, 2, 3, 50], -1)


@query(f"WITH {MEMBERS}, x AS (SELECT *, track_id IN (1, 2, 3, 50) AS h FROM m) SELECT CASE WHEN h THEN 4 ELSE cluster_id END AS cluster_id, track_id, CASE WHEN h THEN 'N0' ELSE name END AS name, CASE WHEN NOT h THEN confidence END AS confidence, CASE WHEN h THEN 0.25 ELSE quality END AS quality FROM x")
def move_tracks(spark, sf_dir):
    return M.move(members(spark, sf_dir), [1, 2, 3, 50], 4)


@query(f"WITH {MEMBERS} SELECT * FROM m WHERE track_id NOT IN (9, 10, 11)")
def delete_tracks(spark, sf_dir):
    return M.delete_tracks(members(spark, sf_dir), [9, 10, 11])


@query(f"WITH {MEMBERS} SELECT * FROM m WHERE track_id NOT IN (4, 6, 123456789) UNION ALL SELECT 2, t, 'N2', 1.0, 0.125 FROM (VALUES (4), (6), (123456789)) v(t)")
def assign_tracks_to_identity(spark, sf_dir):
    return M.assign_tracks(members(spark, sf_dir), [4, 6, 123456789], "N2")


@query(f"WITH {MEMBERS} SELECT cluster_id, name, list(track_id ORDER BY track_id) AS track_ids, CAST(count(*) AS INT) AS size FROM m WHERE cluster_id NOT IN (1, 5) AND track_id % 3 <> 0 GROUP BY 1, 2")
def visible_clusters(spark, sf_dir):
    gone = spark.createDataFrame([(1,), (5,)], "cluster_id bigint")
    return M.visible(members(spark, sf_dir), gone, members(spark, sf_dir).filter("track_id % 3 = 0").select("track_id"))


@query(
    f"""WITH {MEMBERS}, c AS (SELECT cluster_id, coalesce(name, 'Unknown') AS name, avg(quality) AS quality, coalesce(bool_and(confidence = 1.0), false) AS locked FROM m GROUP BY 1, 2),
 g AS (SELECT name, min(cluster_id) AS cluster_id, round_even(avg(quality), 6) AS quality, bool_and(locked) AS all_locked, count(*) AS clusters, name = 'Unknown' AS unknown FROM c GROUP BY name)
 SELECT g.*, t.track_ids FROM g JOIN (SELECT coalesce(name, 'Unknown') AS name, list(track_id ORDER BY track_id) AS track_ids FROM m GROUP BY 1) t USING (name)"""
)
def group_by_identity(spark, sf_dir):
    return M.by_identity(members(spark, sf_dir))


LOG = "log AS (SELECT event_id, user_id AS label, CASE event_type WHEN 'view' THEN 'drop' WHEN 'click' THEN 'reattach' ELSE event_type END AS decision, epoch_us(ts) // 1000000 AS frame FROM events)"


def _log(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    decision = F.when(F.col("event_type") == "view", "drop").when(F.col("event_type") == "click", "reattach").otherwise(F.col("event_type"))
    return rows.select("event_id", F.col("user_id").alias("label"), decision.alias("decision"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("frame"))


@query(f"WITH {LOG}, s AS (SELECT label, decision, frame, lag(decision) OVER w AS b, lag(frame) OVER w AS f FROM log WHERE decision IN ('drop', 'reattach') WINDOW w AS (PARTITION BY label ORDER BY frame, event_id)) SELECT label, frame, frame - f AS latency FROM s WHERE decision = 'reattach' AND b = 'drop'")
def reattach_latency(spark, sf_dir):
    return logs.reattachments(_log(spark, sf_dir))


EVENTS = """ev AS (SELECT event_id, epoch_us(ts) // 1000000 AS frame, CASE WHEN event_id % 11 = 0 THEN 'UNK' ELSE 'N' || (user_id % 40) END AS label_before, CASE WHEN event_id % 13 = 0 THEN 'UNK' ELSE 'N' || (user_id % 40) END AS label_after,
 CASE event_id % 6 WHEN 0 THEN 'join_confirmed' WHEN 1 THEN 'promote_confirm' WHEN 2 THEN 'reattach' WHEN 3 THEN 'drop_exit' WHEN 4 THEN 'switch' ELSE 'assign_provisional' END AS reason FROM events)"""


@query(
    f"""WITH {EVENTS}, l AS (SELECT event_id, frame, CASE WHEN reason = 'drop_exit' THEN label_before ELSE label_after END AS label, reason FROM ev WHERE reason = 'drop_exit' AND label_before <> 'UNK' OR reason = 'reattach' AND label_after <> 'UNK'),
 b AS (SELECT *, lag(reason) OVER w AS r, lag(frame) OVER w AS f FROM l WINDOW w AS (PARTITION BY label ORDER BY frame, event_id)), d AS (SELECT avg(frame - f) AS latency_mean, quantile_cont((frame - f)::DOUBLE, 0.95) AS latency_p95 FROM b WHERE reason = 'reattach' AND r = 'drop_exit'),
 s AS (SELECT count(*) AS events, count(*) FILTER (reason IN ('join_confirmed', 'promote_confirm', 'reattach') AND label_after <> 'UNK') AS tp, count(*) FILTER (reason = 'switch') AS fp, count(*) FILTER (reason = 'drop_exit') AS fn, (max(frame) - min(frame)) / 1800.0::DOUBLE AS m FROM ev)
 SELECT events, round_even(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS id_f1, round_even(tp / (tp + fp), 4) AS precision, round_even(tp / (tp + fn), 4) AS recall, round_even(fp / m, 4) AS switches_per_min, latency_mean, latency_p95 FROM s, d"""
)
def id_metrics(spark, sf_dir):
    e, label = F.col("event_id"), F.format_string("N%d", F.col("user_id") % 40)
    reasons = F.array(*[F.lit(r) for r in ("join_confirmed", "promote_confirm", "reattach", "drop_exit", "switch", "assign_provisional")])
    unless = lambda n: F.when(e % n == 0, "UNK").otherwise(label)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("frame"), unless(11).alias("label_before"), unless(13).alias("label_after"), F.get(reasons, (e % 6).cast("int")).alias("reason"))
    return logs.identity_metrics(rows)


@query(
    """WITH w AS (SELECT user_id, event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING)) AS v FROM events), n AS (SELECT *, len(v) AS n, 0.9::DOUBLE * (len(v) + 1) AS pos FROM w), j AS (SELECT *, least(greatest(CAST(floor(pos) AS INT), 1), n - 1) AS j FROM n)
 SELECT user_id, event_id, CAST(n AS INT) AS samples, (v[(n + 1) // 2] + v[n // 2 + 1]) / 2 AS median, CASE WHEN n < 3 THEN v[n] ELSE v[j] + (v[j + 1] - v[j]) * (pos - j) END AS p90 FROM j"""
)
def rolling_samples(spark, sf_dir):
    return logs.rolling(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


@query(
    """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), e AS (SELECT user_id, n, value AS m FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, 0.3::DOUBLE * o.value + 0.7::DOUBLE * e.m FROM e JOIN o ON o.user_id = e.user_id AND o.n = e.n + 1)
 SELECT user_id, CAST(floor(max_by(m, n) * 1000 + 0.00001) AS BIGINT) AS ema_milli, (SELECT count(*) FROM o WHERE o.user_id = e.user_id) AS n, CAST(floor((SELECT avg(value) FROM o WHERE o.user_id = e.user_id) * 1000 + 0.00001) AS BIGINT) AS mean_milli,
  CAST(floor((SELECT stddev_samp(value) FROM o WHERE o.user_id = e.user_id) * 1000 + 0.00001) AS BIGINT) AS sigma_milli FROM e GROUP BY user_id"""
)
def running_stats(spark, sf_dir):
    got = logs.running_stats(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], "event_id", "value", 0.3)
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.00001).cast("bigint")
    return got.select("user_id", milli("ema").alias("ema_milli"), "n", milli("mean").alias("mean_milli"), milli("sigma").alias("sigma_milli"))


@query(f"WITH {TRACKS} SELECT CAST(least(floor((conf - 0.0) / 0.1::DOUBLE), 9) AS INT) AS bin, count(*) AS count FROM tracks GROUP BY 1")
def confidence_histogram(spark, sf_dir):
    return logs.histogram(tracks(spark, sf_dir), F.col("conf"), F.lit(0.0), F.lit(1.0), 10)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def audit_tail(spark, sf_dir):
    return logs.tail(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type"), "event_id")


@query("WITH u AS (SELECT o_orderkey AS upload_id, o_orderkey % 9 AS chunks FROM orders), r AS (SELECT l_orderkey AS upload_id, l_linenumber - 1 AS chunk FROM lineitem) SELECT upload_id, i AS chunk FROM u, range(0, 10) t(i) WHERE i < chunks AND NOT EXISTS (SELECT 1 FROM r WHERE r.upload_id = u.upload_id AND r.chunk = i)")
def missing_chunks(spark, sf_dir):
    uploads = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("upload_id"), (F.col("o_orderkey") % 9).alias("chunks"))
    received = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("upload_id"), (F.col("l_linenumber") - 1).alias("chunk"))
    return logs.missing_chunks(uploads, received)


@query(
    """WITH u AS (SELECT o_orderkey AS upload_id, 1 + o_orderkey % 3 AS chunks FROM orders), r AS (SELECT l_orderkey AS upload_id, l_linenumber - 1 AS chunk, l_partkey || ':' || l_suppkey AS data FROM lineitem),
 told AS (SELECT upload_id, sha256(max(data)) AS told FROM r WHERE chunk = 0 GROUP BY 1), kept AS (SELECT upload_id, chunk, max(data) AS data FROM r GROUP BY 1, 2),
 came AS (SELECT upload_id, count(*) AS n, string_agg(data, '' ORDER BY chunk) AS whole FROM kept JOIN u USING (upload_id) WHERE chunk < chunks GROUP BY 1)
 SELECT u.upload_id, CASE WHEN n = chunks THEN CAST(strlen(whole) AS BIGINT) END AS n_bytes, CASE WHEN n = chunks THEN sha256(whole) END AS sha256, CASE WHEN n IS DISTINCT FROM chunks THEN 'missing' WHEN told <> sha256(whole) THEN 'mismatch' ELSE 'ok' END AS status
 FROM u LEFT JOIN came USING (upload_id) LEFT JOIN told USING (upload_id)"""
)
def assembled_uploads(spark, sf_dir):
    chunks = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("upload_id"), (F.col("l_linenumber") - 1).alias("chunk"), F.lit(0).alias("at"), F.concat_ws(":", "l_partkey", "l_suppkey").alias("data"))
    told = chunks.filter("chunk = 0").groupBy("upload_id").agg(F.sha2(F.max("data"), 256).alias("sha256"))
    uploads = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("upload_id"), (1 + F.col("o_orderkey") % 3).alias("chunks")).join(told, "upload_id", "left")
    return logs.assembled(uploads, chunks)


@query("SELECT user_id AS step, CASE WHEN user_id % 4 > 0 THEN max(event_id) FILTER (event_id % 5 <> 0) END IS NULL OR coalesce(max(event_id) > CASE WHEN user_id % 4 > 0 THEN max(event_id) FILTER (event_id % 5 <> 0) END, false) AS needed FROM events GROUP BY user_id")
def needs_step(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("step"))
    steps = rows.agg(F.max(F.when((F.col("event_id") % 5 != 0) & (F.col("user_id") % 4 > 0), F.col("event_id"))).alias("output_at"), F.collect_list("event_id").alias("inputs"))
    return logs.needs_step(steps)


@query("SELECT event_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 14 DAY")
def retention_sweep(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("ts").alias("changed"))
    return logs.expired(files, F.lit("2024-01-31").cast("timestamp_ntz"), 14).select("event_id", "event_type")


RAW_ID = "'Show ' || p_name || '_ S' || (p_partkey % 12) || '--x!'"


@query(
    f"""WITH n AS (SELECT p_partkey, {RAW_ID} AS raw FROM part), a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(raw), '[ _]', '-', 'g'), '[^A-Z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS id FROM n)
 SELECT p_partkey, id, regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug, list_filter([CASE WHEN length(raw) < 3 THEN 'too_short' END, CASE WHEN length(raw) > 100 THEN 'too_long' END, CASE WHEN NOT regexp_matches(raw, '^[A-Z0-9-]*$') THEN 'characters' END,
  CASE WHEN contains(raw, '--') THEN 'double_hyphen' END, CASE WHEN starts_with(raw, '-') OR ends_with(raw, '-') THEN 'edge_hyphen' END], lambda x: x IS NOT NULL) AS errors FROM a"""
)
def normalise_ids(spark, sf_dir):
    raw = F.concat(F.lit("Show "), F.col("p_name"), F.lit("_ S"), (F.col("p_partkey") % 12).cast("string"), F.lit("--x!"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.normalise_id(raw).alias("id"), T.slug(raw).alias("slug"), T.id_errors(raw).alias("errors"))


@query(
    f"""WITH {TRACKS} SELECT track_id, printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS clock,
 (start_ms // 1000) || '.' || (start_ms // 100 % 10) || 's - ' || (end_ms // 1000) || '.' || (end_ms // 100 % 10) || 's' AS shown,
 CASE WHEN frames * 977 >= 3600 THEN (frames * 977 // 3600) || 'h ' || (frames * 977 // 60 % 60) || 'm' WHEN frames * 977 >= 60 THEN (frames * 977 // 60 % 60) || 'm ' || (frames * 977 % 60) || 's' ELSE (frames * 977) || 's' END AS eta, start_ms AS parsed FROM tracks"""
)
def format_times(spark, sf_dir):
    ms = F.col("start_ms")
    again = F.concat_ws(":", F.floor(ms / 60_000).cast("string"), F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return tracks(spark, sf_dir).select("track_id", T.clock(ms).alias("clock"), T.seconds_range(ms, F.col("end_ms")).alias("shown"), T.duration(F.col("frames") * 977).alias("eta"), T.parse_minutes(again).alias("parsed"))
