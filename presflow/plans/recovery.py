"""Queries of what looks for missed and misplaced presence, each with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import recovery as R
from ..operators import vectors as V
from ..sources.views import BANK, DETECTIONS, TRACKS, bank, detections, tracks
from .intervals import ISLANDS, merged_at_300
from .vectors import UNIT
from .registering import registry

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)


GAPS = f"{ISLANDS}, g AS (SELECT person, end_ms AS a, lead(start_ms) OVER (PARTITION BY person ORDER BY start_ms, end_ms) AS b FROM merged)"


@query(f"{GAPS} SELECT person, greatest(a - 300, 0) AS start_ms, b + 300 AS end_ms FROM g WHERE b - a > 0 AND b - a <= 700")
def post_label_windows(spark, sf_dir):
    return I.gap_windows(merged_at_300(spark, sf_dir), 700, 300)


@query(f"{GAPS} SELECT person, a AS start_ms, b AS end_ms, b - a AS gap FROM g WHERE b - a > 1000")
def large_gaps(spark, sf_dir):
    return I.large_gaps(merged_at_300(spark, sf_dir), 1000)


@query(
    f"""{GAPS}, rare AS (SELECT person FROM tracks GROUP BY 1 HAVING count(*) < 1400), s AS (SELECT person, min(start_ms) AS a, max(end_ms) AS b FROM merged JOIN rare USING (person) GROUP BY 1)
 SELECT person, greatest(a - 200, 0) AS start_ms, b + 200 AS end_ms, 'gap' AS reason FROM g WHERE b - a > 0 AND b - a <= 500 UNION ALL SELECT person, a + 60000 * i, least(a + 60000 * i + 30000, b), 'sparse' FROM s, range(0, 1000) t(i) WHERE a + 60000 * i < b"""
)
def recall_windows(spark, sf_dir):
    return I.recall_windows(merged_at_300(spark, sf_dir), tracks(spark, sf_dir), 500, 200, 1400, 30_000)


SPANS = f"""{DETECTIONS}, {BANK}, named AS (SELECT 'L' || (track_id % 12) AS person, * FROM det), span AS (SELECT person, track_id * 3 AS first_frame, track_id * 3 + 1 AS last_frame, track_id FROM named GROUP BY ALL),
 w AS (SELECT person, track_id AS before_id, lead(track_id) OVER o AS after_id, last_frame AS gap_first, lead(first_frame) OVER o AS gap_last FROM span WINDOW o AS (PARTITION BY person ORDER BY first_frame, last_frame, track_id)),
 gaps AS (SELECT *, (gap_last - gap_first) * 33 AS gap_ms FROM w WHERE (gap_last - gap_first) * 33 >= 500),
 ends AS (SELECT g.person, before_id, after_id, {UNIT.format(v='d.embedding')} AS u FROM gaps g JOIN named d ON d.track_id = before_id AND d.frame_id >= gap_first - 5 OR d.track_id = after_id AND d.frame_id <= gap_last + 5),
 prox AS (SELECT e.person, before_id, after_id, greatest(0.0, max(list_dot_product(u, b.embedding))) AS proximity FROM ends e JOIN bank b ON b.identity = e.person GROUP BY 1, 2, 3),
 cand AS (SELECT gaps.*, proximity, gap_ms * proximity AS score FROM gaps JOIN prox USING (person, before_id, after_id) WHERE proximity >= 0.2)"""


def _candidates(spark, sf_dir):
    faces = detections(spark, sf_dir)
    spans = faces.select("track_id").distinct().select("track_id", F.format_string("L%d", F.col("track_id") % 12).alias("person"), (F.col("track_id") * 3).alias("first_frame"), (F.col("track_id") * 3 + 1).alias("last_frame"))
    return R.gap_candidates(spans, faces.select("track_id", "frame_id", "vec_id", "embedding"), bank(spark, sf_dir), 33, 500, 0.2, 5)


@query(f"WITH {SPANS} SELECT person, before_id, after_id, gap_ms, round(proximity, 6) AS proximity, round(score, 6) AS score FROM cand")
def gap_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("person", "before_id", "after_id", "gap_ms", F.round("proximity", 6).alias("proximity"), F.round("score", 6).alias("score"))


CHOSEN = f"{SPANS}, top AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY person ORDER BY score DESC, before_id) <= 1 ORDER BY score DESC, person, before_id LIMIT 4)"


@query(f"WITH {CHOSEN} SELECT person, before_id, gap_ms FROM top")
def gaps_to_scan(spark, sf_dir):
    return R.gaps_to_scan(_candidates(spark, sf_dir)).select("person", "before_id", "gap_ms")


@query(f"WITH {CHOSEN} SELECT person, count(*) AS gaps, CAST(sum(gap_ms) AS BIGINT) AS total_ms FROM top GROUP BY 1")
def recall_stats(spark, sf_dir):
    return R.recall_stats(R.gaps_to_scan(_candidates(spark, sf_dir)))


@query(f"{ISLANDS}, t AS (SELECT person, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, max(end_ms) AS last_ms FROM merged GROUP BY 1) SELECT person, total_ms, round_even(total_ms / (SELECT max(last_ms) FROM t) * 100, 2) AS percent FROM t")
def totals_again(spark, sf_dir):
    """Totals from a timeline alone: the duration is the last time that anyone is seen."""
    rows = merged_at_300(spark, sf_dir)
    return I.totals(rows, rows.agg(F.max("end_ms")).first()[0]).select("person", "total_ms", "percent")


@query(f"{GAPS}, t AS (SELECT *, b - a AS gap, row_number() OVER (PARTITION BY person ORDER BY b - a DESC, a) AS nth FROM g WHERE b - a > 300 QUALIFY nth <= 3) SELECT person, a AS start_ms, gap, CAST(80 // count(*) OVER (PARTITION BY person) AS INT) AS frames FROM t")
def gap_frame_budgets(spark, sf_dir):
    return R.top_gap_frames(I.large_gaps(merged_at_300(spark, sf_dir), 300), 80).select("person", "start_ms", "gap", "frames")


WHO = f"{DETECTIONS}, {BANK}, f AS (SELECT vec_id, 'L' || (vec_id % 9) AS who, track_id, {UNIT.format(v='embedding')} AS u FROM det)"


def _who(spark, sf_dir):
    return detections(spark, sf_dir).withColumn("who", F.format_string("L%d", F.col("vec_id") % 9))


@query(
    f"""WITH {WHO}, s AS (SELECT f.vec_id, max(list_dot_product(u, embedding)) FILTER (identity = who) AS sim, coalesce(max(list_dot_product(u, embedding)) FILTER (identity <> who), -1) AS second FROM f, bank GROUP BY 1)
 SELECT vec_id, round(sim, 6) AS sim FROM s WHERE sim >= 0.15 AND sim - second >= -0.05"""
)
def verified_faces(spark, sf_dir):
    return R.verified(_who(spark, sf_dir).select("vec_id", "who", "embedding"), bank(spark, sf_dir), "who", "vec_id", 0.15, -0.05).select("vec_id", F.round("sim", 6).alias("sim"))


SEED = f"""{DETECTIONS}, {BANK}, seed AS (SELECT {UNIT.format(v='embedding')} AS s FROM det WHERE vec_id = 8), u AS (SELECT vec_id, frame_id, track_id, {UNIT.format(v='embedding')} AS u FROM det),
 acc AS (SELECT u.vec_id, u.frame_id * 40 AS ts_ms, u.u, list_dot_product(u.u, s) AS sim, greatest(-1, (SELECT max(list_dot_product(u.u, embedding)) FROM bank)) AS other FROM u, seed), ok AS (SELECT * FROM acc WHERE sim >= 0.1 AND sim - other >= -0.2)"""


def _entrance(spark, sf_dir):
    faces = detections(spark, sf_dir)
    seed = faces.filter("vec_id = 8").select(F.col("embedding").alias("seed"))
    return R.entrance_accepted(faces, seed, bank(spark, sf_dir), 0.1, -0.2)


@query(f"WITH {SEED} SELECT vec_id, round(sim, 6) AS sim, round(other, 6) AS other FROM ok")
def entrance_accepted(spark, sf_dir):
    return _entrance(spark, sf_dir).select("vec_id", F.round("sim", 6).alias("sim"), F.round("other", 6).alias("other"))


@query(
    f"""WITH {SEED}, st AS (SELECT track_id, min(frame_id) * 40 + 24000 AS start_ms FROM det GROUP BY 1), near AS (SELECT track_id, start_ms - (SELECT max(ts_ms) FROM ok) AS gap FROM st WHERE gap BETWEEN 0 AND 100000),
 p AS (SELECT near.track_id, gap, list_dot_product(ok.u, u.u) AS s, row_number() OVER (PARTITION BY near.track_id ORDER BY list_dot_product(ok.u, u.u) DESC) AS k FROM near JOIN u USING (track_id), ok),
 m AS (SELECT track_id, gap, avg(s) AS sim FROM p WHERE k <= 5 GROUP BY 1, 2), b AS (SELECT * FROM m WHERE sim > 0 ORDER BY sim DESC, track_id LIMIT 1)
 SELECT track_id AS target, round(sim, 6) AS sim, gap, coalesce(sim >= 0.2, false) AS success FROM (SELECT 1 AS one) LEFT JOIN b ON true"""
)
def entrance_bridge(spark, sf_dir):
    faces = detections(spark, sf_dir).select("track_id", "vec_id", "frame_id", V.l2_normalise("embedding").alias("u"))
    entrance = faces.join(_entrance(spark, sf_dir).select("vec_id"), "vec_id").select("vec_id", (F.col("frame_id") * 40).alias("ts_ms"), "u")
    starts = faces.groupBy("track_id").agg((F.min("frame_id") * 40 + 24_000).alias("start_ms"))
    return R.bridge(entrance, starts, faces, 100_000, 5, 0.2).withColumn("sim", F.round("sim", 6))


@query()
def entrance_seed(spark, sf_dir):
    faces = detections(spark, sf_dir).select("vec_id", (F.col("frame_id") * 40).alias("ts_ms"), "embedding")
    return R.entrance_seed(faces, 0.65, 4, 600)


@query(
    f"""WITH {WHO}, sp AS (SELECT track_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM det), md AS (SELECT track_id, list(m ORDER BY i) AS v FROM (SELECT track_id, i, quantile_cont(x, 0.5) AS m FROM sp GROUP BY 1, 2) GROUP BY 1),
 r AS (SELECT track_id, 'L' || (track_id % 9) AS person, {UNIT.format(v='v')} AS u FROM md), s AS (SELECT track_id, person, identity, max(list_dot_product(u, {UNIT.format(v='embedding')})) AS sim FROM r, bank GROUP BY 1, 2, 3),
 o AS (SELECT track_id, person, coalesce(max(sim) FILTER (identity = person), 0) AS own, greatest(0.0, max(sim) FILTER (identity <> person)) AS other, arg_max(identity, sim) FILTER (identity <> person) AS to_ FROM s GROUP BY 1, 2)
 SELECT track_id, person, to_ AS "to", round(other - own, 6) AS gain FROM o WHERE other - own >= 0.1"""
)
def probed_tracks(spark, sf_dir):
    rows = detections(spark, sf_dir)
    members = rows.select("track_id").distinct().select("track_id", F.format_string("L%d", F.col("track_id") % 9).alias("person"))
    return R.probed(members, rows, bank(spark, sf_dir), 0.1).withColumn("gain", F.round("gain", 6))


@query(
    f"""WITH {WHO}, s AS (SELECT track_id, 'L' || (track_id % 9) AS person, vec_id, identity, max(list_dot_product(u, {UNIT.format(v='embedding')})) AS sim FROM f, bank GROUP BY ALL),
 b AS (SELECT track_id, person, vec_id, arg_max(identity, sim) AS best, max(sim) AS s, coalesce(max(sim) FILTER (identity = person), 0) AS own FROM s GROUP BY ALL), e AS (SELECT track_id, person, best, count(*) AS n, count(*) FILTER (s - own >= 0.25) AS bad FROM b WHERE best <> person GROUP BY ALL)
 SELECT track_id, person, CAST(sum(bad) AS BIGINT) AS frames, CAST(sum(n) AS BIGINT) AS "of", round(sum(bad) / sum(n) * 100, 6) AS percent, max((n, best)) FILTER (bad > 0)[2] AS "to" FROM e GROUP BY 1, 2 HAVING sum(bad) >= 6 OR sum(bad) / sum(n) * 100 >= 25"""
)
def contaminated_tracks(spark, sf_dir):
    faces = detections(spark, sf_dir).withColumn("person", F.format_string("L%d", F.col("track_id") % 9))
    return R.contaminated_tracks(faces.select("track_id", "person", "vec_id", "embedding"), bank(spark, sf_dir), 0.25, 6).withColumn("percent", F.round("percent", 6))


AUDITED = f"""{DETECTIONS}, u AS (SELECT vec_id, cluster_id, track_id, row_number() OVER (PARTITION BY track_id ORDER BY vec_id) - 1 AS at_, {UNIT.format(v='embedding')} AS u FROM det),
 ms AS (SELECT a.cluster_id, a.vec_id, round(sum(list_dot_product(a.u, b.u)) - 1, 9) AS score FROM u a JOIN u b USING (cluster_id) GROUP BY 1, 2), md AS (SELECT cluster_id, vec_id FROM ms QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, vec_id) = 1),
 ctr AS (SELECT u.cluster_id AS other, u.u AS m FROM md JOIN u USING (cluster_id, vec_id)), s AS (SELECT u.vec_id, u.cluster_id, u.track_id, u.at_, max(list_dot_product(u, m)) FILTER (other = cluster_id) AS sim, max(list_dot_product(u, m)) FILTER (other <> cluster_id) AS rs, arg_max(other, list_dot_product(u, m)) FILTER (other <> cluster_id) AS ro FROM u, ctr GROUP BY ALL),
 med AS (SELECT track_id, quantile_cont(sim, 0.5) AS m FROM s GROUP BY 1), mad AS (SELECT track_id, quantile_cont(abs(sim - m), 0.5) AS d FROM s JOIN med USING (track_id) GROUP BY 1),
 far AS (SELECT s.* FROM s JOIN med USING (track_id) JOIN mad USING (track_id) WHERE sim < -0.1 OR d > 0 AND abs(sim - m) > 2 * d)"""


def _samples(spark, sf_dir):
    return detections(spark, sf_dir).select("cluster_id", "track_id", F.floor(F.col("vec_id") / 40).alias("at"), "vec_id", "embedding", "conf")


@query(f"WITH {AUDITED} SELECT track_id, vec_id FROM far")
def outlier_faces(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    unit = rows.select("cluster_id", "track_id", "vec_id", V.l2_normalise("embedding").alias("u"))
    centres = unit.join(V.medoid(rows, ["cluster_id"], "vec_id").select("cluster_id", "vec_id"), ["cluster_id", "vec_id"]).select("cluster_id", F.col("u").alias("m"))
    return R.outliers(unit.join(centres, "cluster_id").withColumn("sim", V.dot("u", "m")), ["track_id"], -0.1, 2.0).select("track_id", "vec_id")


@query(
    f"""WITH {AUDITED}, cr AS (SELECT vec_id, cluster_id, track_id, at_, greatest(rs, 0) - sim AS gain, CASE WHEN rs > 0 THEN ro END AS other FROM s WHERE greatest(rs, 0) - sim >= 0.3),
 ev AS (SELECT e.*, cr.gain, cr.other FROM (SELECT cluster_id, track_id, at_ FROM far UNION SELECT cluster_id, track_id, at_ FROM cr) e LEFT JOIN cr USING (cluster_id, track_id, at_)), pl AS (SELECT *, at_ - row_number() OVER (PARTITION BY track_id ORDER BY at_) AS run FROM ev)
 SELECT cluster_id, track_id, min(at_) AS first_at, max(at_) AS last_at, count(*) AS n, CASE WHEN coalesce(max(gain), 0) > 0 THEN 'cross_identity' ELSE 'outlier' END AS reason, round(coalesce(max(gain), 0), 6) AS strength, arg_max(other, gain) AS other,
  CASE WHEN coalesce(max(gain), 0) >= 0.35 AND arg_max(other, gain) IS NOT NULL THEN 'split_to_' || arg_max(other, gain) ELSE 'split_to_unknown' END AS action FROM pl GROUP BY cluster_id, track_id, run HAVING count(*) >= 2"""
)
def contamination_audit(spark, sf_dir):
    return R.contamination_audit(_samples(spark, sf_dir), -0.1, 2.0, 0.3, 2, 0.35).withColumn("strength", F.round("strength", 6))


MIXED = f"""{DETECTIONS}, sp AS (SELECT cluster_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM det), ce AS (SELECT cluster_id, list(m ORDER BY i) AS v FROM (SELECT cluster_id, i, avg(x) AS m FROM sp GROUP BY 1, 2) GROUP BY 1), c AS (SELECT cluster_id, {UNIT.format(v='v')} AS c FROM ce),
 va AS (SELECT cluster_id, count(*) AS faces, avg(1 - list_dot_product({UNIT.format(v='embedding')}, c)) AS variance, avg((conf < 0.7)::INT) * 100 AS low_conf FROM det JOIN c USING (cluster_id) GROUP BY 1), se AS (SELECT a.cluster_id, least(1.0, min(1 - list_dot_product(a.c, b.c))) AS separation FROM c a JOIN c b ON a.cluster_id <> b.cluster_id GROUP BY 1),
 tr AS (SELECT cluster_id, track_id, (max(frame_id) - min(frame_id)) * 90 AS ms FROM det GROUP BY 1, 2), lo AS (SELECT cluster_id, count(*) FILTER (ms > 10000) AS long_tracks, max(ms) AS longest_ms FROM tr GROUP BY 1)"""


@query(
    f"""WITH {MIXED} SELECT cluster_id, faces, round(variance, 6) AS variance, round(separation, 6) AS separation, round(low_conf, 6) AS low_conf, long_tracks, longest_ms,
 list_filter([CASE WHEN variance > 0.35 THEN printf('high_variance:%.3f', variance) END, CASE WHEN separation < 0.15 THEN printf('low_separation:%.3f', separation) END, CASE WHEN long_tracks > 0 THEN printf('long_tracks:%d', long_tracks) END, CASE WHEN low_conf > 40 THEN printf('low_conf:%.1f%%', low_conf) END], lambda x: x IS NOT NULL) AS reasons
 FROM va JOIN se USING (cluster_id) JOIN lo USING (cluster_id)"""
)
def mixed_clusters(spark, sf_dir):
    rows = detections(spark, sf_dir)
    spans = rows.groupBy("track_id").agg((F.min("frame_id") * 90).alias("start_ms"), (F.max("frame_id") * 90).alias("end_ms"))
    r = lambda c: F.round(c, 6).alias(c)
    return R.mixed_clusters(rows, spans).select("cluster_id", "faces", r("variance"), r("separation"), r("low_conf"), "long_tracks", "longest_ms", "reasons")


@query(f"WITH {TRACKS}, one AS (SELECT track_id, end_ms, person FROM tracks WHERE conf > 0.98), n AS (SELECT o.track_id, arg_min(t.track_id, (t.start_ms - o.end_ms) * 1000000 + t.track_id) AS linked_to, min(t.start_ms - o.end_ms) AS gap FROM one o JOIN tracks t ON t.person = o.person AND t.start_ms > o.end_ms AND t.start_ms - o.end_ms <= 1000 GROUP BY 1) SELECT one.track_id, linked_to, gap FROM one LEFT JOIN n USING (track_id)")
def injected_tracks(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    return R.injected(rows.filter("conf > 0.98").select("track_id"), I.nearest_after(rows, ["person"], 1000))




@query(f"{ISLANDS} SELECT a.person AS person_a, b.person AS person_b, greatest(a.start_ms, b.start_ms) AS start_ms, least(a.end_ms, b.end_ms) AS end_ms, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS shared_ms FROM merged a JOIN merged b ON a.person < b.person AND least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms)")
def overlaps(spark, sf_dir):
    return I.overlaps(merged_at_300(spark, sf_dir), 5_000)


@query(
    f"""WITH {DETECTIONS}, o AS (SELECT track_id AS source, frame_id, CASE WHEN frame_id - lag(frame_id) OVER (PARTITION BY track_id ORDER BY frame_id) <= 10 THEN 0 ELSE 1 END AS opens FROM (SELECT DISTINCT track_id, frame_id FROM det WHERE vec_id % 7 <> 3)),
 p AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY frame_id) AS run FROM o), r AS (SELECT source, min(frame_id) AS first_at, max(frame_id) AS last_at, count(*) AS n FROM p GROUP BY source, run HAVING count(*) >= 3)
 SELECT 9999 + row_number() OVER (ORDER BY source, first_at) AS track_id, * FROM r"""
)
def tracklets(spark, sf_dir):
    rows = detections(spark, sf_dir).filter("vec_id % 7 <> 3").select(F.col("track_id").alias("source"), "frame_id").distinct()
    return I.tracklets(rows, ["source"], "frame_id", 10, 3)


@query(
    f"""WITH {DETECTIONS}, r AS (SELECT identity, embedding, row_number() OVER (PARTITION BY identity ORDER BY conf * sqrt((x2 - x1) * (y2 - y1)) DESC, vec_id) AS k FROM det), s AS (SELECT identity, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM r WHERE k <= 10),
 m AS (SELECT identity, i, quantile_cont(x, 0.5) AS m FROM s GROUP BY 1, 2) SELECT identity, list(m ORDER BY i) AS template FROM m GROUP BY 1"""
)
def best_templates(spark, sf_dir):
    return V.best_template(detections(spark, sf_dir), ["identity"])
