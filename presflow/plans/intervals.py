"""Queries of the interval family over the presence views, each with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..sources.views import TRACKS, tracks
from .registering import registry

QUERIES: dict = {}
SQL: dict[str, str] = {}
LENGTH = 2_600_000  # of the "episode", past the last track
TRUTH = [("P0", 1_400_000), ("P1", 1_250_000), ("P2", 1_400_000), ("P3", 900_000), ("P9", 5_000)]
query = registry(QUERIES, SQL)


ISLANDS = f"""WITH {TRACKS},
 before AS (SELECT *, max(end_ms) OVER (PARTITION BY person ORDER BY start_ms, track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM tracks),
 placed AS (SELECT *, sum(CASE WHEN b IS NULL OR start_ms - b > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY person ORDER BY start_ms, track_id) AS island FROM before),
 merged AS (SELECT person, island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS members, max(conf) AS conf FROM placed GROUP BY person, island)"""


def merged_at_300(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fixed_gap_merge(tracks(spark, sf_dir), ["person"], 300, tie="track_id")


@query(f"{ISLANDS} SELECT person, start_ms, end_ms, members, conf FROM merged")
def fixed_gap_timeline(spark, sf_dir):
    return merged_at_300(spark, sf_dir).drop("island").select("person", "start_ms", "end_ms", "members", "conf")


@query(
    f"""{ISLANDS} SELECT person, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, round_even(sum(end_ms - start_ms) / 1000, 1) AS total_sec, count(*) AS appearances, min(start_ms) AS first_ms,
 max(end_ms) AS last_ms, round_even(avg(conf), 3) AS mean_confidence, round_even(sum(end_ms - start_ms) / {LENGTH} * 100, 2) AS percent FROM merged GROUP BY person"""
)
def totals_by_person(spark, sf_dir):
    return I.totals(merged_at_300(spark, sf_dir), LENGTH)


_P = I.MergeParams()


def _merge_sql(p: I.MergeParams, only: str = "true") -> str:
    """The adaptive merge as a recursion over each person's intervals in order, of the tracks that meet a condition."""
    quality = "(s.conf + x.conf) / 2"
    threshold = (
        f"least(CASE WHEN {quality} >= {p.min_quality} THEN {p.hi_cap} ELSE {p.lo_cap} END, {p.gap_max})"
        if p.caps
        else f"CASE WHEN s.conf >= {p.min_quality} AND x.conf >= {p.min_quality} THEN {p.gap_max} ELSE {p.gap} END"
    )
    invisible = f"WHEN s.visible < {p.visibility} OR x.visible < {p.visibility} THEN 'invisible'" if p.visibility else ""
    step = f"CASE WHEN x.gap < 0 THEN 'overlap' WHEN {p.edge_epsilon} > 0 AND x.gap <= {p.edge_epsilon} THEN 'edge' WHEN x.gap > {threshold} THEN 'clamped' {invisible} WHEN x.conflict THEN 'blocked' ELSE 'merged' END"
    merges = f"({step}) IN ('overlap', 'edge', 'merged')"
    bump = f"CASE WHEN {quality} >= {p.min_quality} THEN 'bump' ELSE 'lo_cap' END" if p.caps else f"CASE WHEN s.conf >= {p.min_quality} AND x.conf >= {p.min_quality} THEN 'bump' END"
    bump = f"CASE WHEN ({step}) NOT IN ('overlap', 'edge') THEN {bump} END"
    return f"""WITH RECURSIVE {TRACKS},
 chosen AS (SELECT * FROM tracks WHERE {only}),
 before AS (SELECT *, max(end_ms) OVER (PARTITION BY person ORDER BY start_ms, track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gs,
   row_number() OVER (PARTITION BY person ORDER BY start_ms, track_id) AS n FROM chosen),
 hits AS (SELECT DISTINCT l.track_id FROM before l JOIN chosen r ON l.person <> r.person AND r.conf >= {p.conflict_conf} AND l.start_ms - l.gs > {p.conflict_guard}
   AND r.start_ms < l.start_ms AND r.end_ms > l.gs AND least(r.end_ms, l.start_ms) - greatest(r.start_ms, l.gs) >= {p.conflict_guard}),
 placed AS (SELECT b.*, b.start_ms - b.gs AS gap, h.track_id IS NOT NULL AS conflict FROM before b LEFT JOIN hits h USING (track_id)),
 state AS (SELECT person, n, start_ms, end_ms, conf, visible, frames, 1::BIGINT AS members, 1::BIGINT AS g, 'first' AS step, NULL::VARCHAR AS quality, NULL::BIGINT AS gap, NULL::BIGINT AS gs, track_id FROM placed WHERE n = 1
  UNION ALL
  SELECT x.person, x.n, CASE WHEN {merges} THEN s.start_ms ELSE x.start_ms END, CASE WHEN {merges} THEN greatest(s.end_ms, x.end_ms) ELSE x.end_ms END,
   CASE WHEN {merges} THEN greatest(s.conf, x.conf) ELSE x.conf END, CASE WHEN {merges} THEN 0.0 ELSE x.visible END, CASE WHEN {merges} THEN 0 ELSE x.frames END,
   CASE WHEN {merges} THEN s.members + 1 ELSE 1 END, CASE WHEN {merges} THEN s.g ELSE s.g + 1 END, {step}, {bump}, x.gap, x.gs, x.track_id
  FROM state s JOIN placed x ON x.person = s.person AND x.n = s.n + 1)"""


_LAST = "SELECT person, g, max_by(start_ms, n) AS start_ms, max_by(end_ms, n) AS end_ms, max_by(conf, n) AS conf, max_by(visible, n) AS visible, max_by(frames, n) AS frames, max_by(members, n) AS members FROM state GROUP BY person, g"


@query(f"{_merge_sql(_P)} SELECT person, start_ms, end_ms, conf, visible, frames, members FROM ({_LAST})")
def adaptive_merge(spark, sf_dir):
    return I.timeline(I.adaptive_merge(tracks(spark, sf_dir), _P))


_CAPPED = I.MergeParams(lo_cap=900, hi_cap=1800, min_visible=0.3)


@query(f"{_merge_sql(_CAPPED)} SELECT person, start_ms, end_ms, conf, visible, frames, members FROM ({_LAST})")
def adaptive_merge_capped(spark, sf_dir):
    return I.timeline(I.adaptive_merge(tracks(spark, sf_dir), _CAPPED))


_COUNTS = ", ".join(f"count(*) FILTER (step = '{s}') AS {s}" for s in ("overlap", "edge", "merged", "blocked", "clamped", "invisible"))


_STATS = f"SELECT person, count(*) FILTER (step <> 'first') AS gaps_seen, count(*) FILTER (step IN ('overlap', 'edge', 'merged')) AS gaps_merged, {_COUNTS}, count(*) FILTER (quality = 'bump') AS quality_bumps, count(*) FILTER (quality = 'lo_cap') AS lo_caps FROM state GROUP BY person"


@query(f"{_merge_sql(_P)} {_STATS}")
def merge_stats(spark, sf_dir):
    return I.merge_stats(I.adaptive_merge(tracks(spark, sf_dir), _P))


@query(f"{_merge_sql(_CAPPED)} {_STATS}")
def merge_stats_capped(spark, sf_dir):
    return I.merge_stats(I.adaptive_merge(tracks(spark, sf_dir), _CAPPED))


@query(f"{_merge_sql(_CAPPED)} SELECT person, gs AS start_ms, gs + gap AS end_ms, gap, track_id AS next_track FROM state WHERE step = 'invisible'")
def visibility_audit(spark, sf_dir):
    return I.visibility_audit(I.adaptive_merge(tracks(spark, sf_dir), _CAPPED))


@query(
    f"""{ISLANDS} SELECT a.person AS person_a, b.person AS person_b, count(*) AS times, CAST(sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) AS BIGINT) AS shared_ms
 FROM merged a JOIN merged b ON a.person < b.person AND least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms) GROUP BY 1, 2"""
)
def co_appearance(spark, sf_dir):
    return I.co_appearance(merged_at_300(spark, sf_dir), 5_000)


@query(
    f"""WITH {TRACKS},
 g AS (SELECT *, lead(start_ms) OVER w AS ns, lead(conf) OVER w AS nc FROM tracks WINDOW w AS (PARTITION BY person ORDER BY start_ms, track_id)),
 safe AS (SELECT person, ns - end_ms AS gap FROM g WHERE ns - end_ms > 0 AND conf >= 0.7 AND nc >= 0.7
   AND NOT EXISTS (SELECT 1 FROM tracks r WHERE r.person <> g.person AND r.end_ms >= g.end_ms - 20 AND r.start_ms <= g.ns + 20)),
 s AS (SELECT person, count(*) AS safe_gaps, quantile_cont(gap, 0.8) AS p80, quantile_cont(gap, 0.5) AS median, avg(gap) AS mean FROM safe GROUP BY person)
 SELECT person, coalesce(safe_gaps, 0) AS safe_gaps, CAST(trunc(coalesce(greatest(60.0, least(500.0, p80 * 1.2)), 60.0)) AS BIGINT) AS cap_ms, CAST(trunc(coalesce(p80, 0)) AS BIGINT) AS p80_ms,
  CAST(trunc(coalesce(median, 0)) AS BIGINT) AS median_ms, CAST(trunc(coalesce(mean, 0)) AS BIGINT) AS mean_ms FROM (SELECT DISTINCT person FROM tracks) LEFT JOIN s USING (person)"""
)
def auto_caps(spark, sf_dir):
    return I.auto_caps(tracks(spark, sf_dir), 20, 60, 500, bin_ms=2_000)


AUDIT = f"""{ISLANDS},
 n AS (SELECT *, lead(start_ms) OVER w AS nx, row_number() OVER w AS k FROM merged WINDOW w AS (PARTITION BY person ORDER BY start_ms, end_ms)),
 gaps AS (SELECT person, 'start' AS kind, 0::BIGINT AS start_ms, start_ms AS end_ms FROM n WHERE k = 1 AND start_ms > 3000
  UNION ALL SELECT person, 'between', end_ms, nx FROM n WHERE nx - end_ms > 0 AND nx - end_ms <= 3000
  UNION ALL SELECT person, 'tail', end_ms, {LENGTH} FROM n WHERE nx IS NULL AND {LENGTH} - end_ms > 0 AND {LENGTH} - end_ms <= 3000),
 win AS (SELECT person, kind, greatest(start_ms - 200, 0) AS start_ms, least(end_ms + 200, {LENGTH}) AS end_ms FROM gaps),
 num AS (SELECT *, row_number() OVER () AS i FROM win),
 cov AS (SELECT w.person, w.kind, w.start_ms, w.end_ms, CAST(coalesce(sum(least(t.end_ms, w.end_ms) - greatest(t.start_ms, w.start_ms)), 0) AS BIGINT) AS covered_ms, count(t.track_id) AS tracks, round(coalesce(avg(t.conf), 0), 9) AS mean_conf
   FROM num w LEFT JOIN tracks t ON t.start_ms < w.end_ms AND t.end_ms > w.start_ms GROUP BY w.i, w.person, w.kind, w.start_ms, w.end_ms)"""


@query(f"""{AUDIT} SELECT *, covered_ms / (end_ms - start_ms) AS ratio, CASE WHEN covered_ms / (end_ms - start_ms) < 0.2 THEN 'high' WHEN covered_ms / (end_ms - start_ms) < 0.5 THEN 'medium' ELSE 'low' END AS priority FROM cov""")
def gap_audit(spark, sf_dir):
    found = I.audit_gaps(merged_at_300(spark, sf_dir), LENGTH, 3000)
    windows = found.select("person", "kind", F.greatest(F.col("start_ms") - 200, F.lit(0)).alias("start_ms"), F.least(F.col("end_ms") + 200, F.lit(LENGTH)).alias("end_ms"))
    covered = I.coverage(windows, tracks(spark, sf_dir).select("start_ms", "end_ms", "conf"), 5_000)
    return covered.drop("window_id").withColumn("priority", I.priority(F.col("ratio"))).withColumn("mean_conf", F.round("mean_conf", 9))


@query(
    f"""{ISLANDS},
 n AS (SELECT *, lead(start_ms) OVER (PARTITION BY person ORDER BY start_ms, end_ms) AS nx FROM merged),
 win AS (SELECT person, greatest(end_ms - 300, 0) AS start_ms, nx + 300 AS end_ms FROM n WHERE nx - end_ms > 0 AND nx - end_ms <= 2000),
 cov AS (SELECT w.*, least(1.0, coalesce((SELECT sum(least(m.end_ms, w.end_ms) - greatest(m.start_ms, w.start_ms)) FROM merged m WHERE m.person = w.person AND m.start_ms < w.end_ms AND m.end_ms > w.start_ms), 0)
   / (w.end_ms - w.start_ms)) AS ratio FROM win w)
 SELECT person, start_ms, end_ms, ratio FROM cov WHERE ratio < 0.4"""
)
def densify_windows(spark, sf_dir):
    merged = merged_at_300(spark, sf_dir).select("person", "start_ms", "end_ms", "conf", F.col("start_ms").alias("track_id"))
    found = I.gaps(merged, ["person"], "end_ms").filter((F.col("gap") > 0) & (F.col("gap") <= 2000))
    windows = found.select("person", F.greatest(F.col("end_ms") - 300, F.lit(0)).alias("start_ms"), (F.col("next_start") + 300).alias("end_ms"))
    covered = I.coverage(windows, merged.select("person", "start_ms", "end_ms", "conf"), 5_000, on=["person"])
    return covered.withColumn("ratio", F.least(F.lit(1.0), "ratio")).filter("ratio < 0.4").select("person", "start_ms", "end_ms", "ratio")


@query(
    f"""{ISLANDS}, s AS (SELECT person, min(start_ms) AS a, max(end_ms) AS b FROM merged GROUP BY person)
 SELECT person, a + 60000 * i AS start_ms, least(a + 60000 * i + 30000, b) AS end_ms FROM s, range(0, 100) t(i) WHERE a + 60000 * i < b"""
)
def recall_scan_windows(spark, sf_dir):
    spans = merged_at_300(spark, sf_dir).groupBy("person").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    starts = F.explode(F.sequence("a", F.col("b") - 1, F.lit(60_000).cast("bigint"))).alias("start_ms")
    return spans.select("person", "b", starts).select("person", "start_ms", F.least(F.col("start_ms") + 30_000, F.col("b")).alias("end_ms"))


@query(f"WITH {TRACKS}, m AS (SELECT max(end_ms) AS n FROM tracks) SELECT i * 5000 AS start_ms, least(i * 5000 + 5000, n) AS end_ms FROM m, range(0, 100000) t(i) WHERE i * 5000 < n")
def tumbling_windows(spark, sf_dir):
    length = tracks(spark, sf_dir).agg(F.max("end_ms").alias("n"))
    return length.select(F.explode(I.tumbling(F.col("n"), 5000)).alias("w")).select("w.start_ms", "w.end_ms")


@query(
    f"""{ISLANDS}, o AS (SELECT person, start_ms AS a, end_ms AS b FROM merged WHERE end_ms - start_ms > 2000),
 w AS (SELECT person, a + 500 * i AS start_ms, b FROM o, range(0, 100000) t(i) WHERE a + 500 * i < b), p AS (SELECT *, row_number() OVER (PARTITION BY person, b, start_ms + 3000 > b ORDER BY start_ms) AS k FROM w)
 SELECT person, start_ms, least(start_ms + 3000, b) AS end_ms, start_ms + 3000 > b AS partial FROM p WHERE start_ms + 3000 <= b OR k = 1"""
)
def sliding_windows(spark, sf_dir):
    long = merged_at_300(spark, sf_dir).filter("end_ms - start_ms > 2000")
    return long.select("person", F.explode(I.sliding(F.col("start_ms"), F.col("end_ms"), 3000, 500)).alias("w")).select("person", "w.start_ms", "w.end_ms", "w.partial")


@query(
    f"""WITH {TRACKS}, g AS (SELECT *, lead(start_ms) OVER (PARTITION BY person ORDER BY start_ms, track_id) AS ns FROM tracks),
 w AS (SELECT person, CASE WHEN track_id % 2 = 0 THEN 'gap' ELSE 'sparse' END AS reason, end_ms - 150 AS start_ms, ns + 150 AS end_ms FROM g WHERE ns - end_ms > 0),
 b AS (SELECT *, max(end_ms) OVER (ORDER BY start_ms, reason, person ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM w WHERE person = 'P3'),
 p AS (SELECT *, sum(CASE WHEN e IS NULL OR start_ms - e > 0 THEN 1 ELSE 0 END) OVER (ORDER BY start_ms, reason, person ROWS UNBOUNDED PRECEDING) AS k FROM b)
 SELECT 'P3' AS lane, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CASE WHEN count(DISTINCT reason) = 1 THEN min(reason) ELSE min_by(reason, start_ms * 10 + (reason = 'sparse')::INT) || '+' ||
  CASE min_by(reason, start_ms * 10 + (reason = 'sparse')::INT) WHEN 'gap' THEN 'sparse' ELSE 'gap' END END AS reasons, min(person) AS person FROM p GROUP BY k"""
)
def merged_windows(spark, sf_dir):
    found = I.gaps(tracks(spark, sf_dir), ["person"]).filter((F.col("gap") > 0) & (F.col("person") == "P3"))
    windows = found.select(F.lit("P3").alias("lane"), "person", F.when(F.col("track_id") % 2 == 0, "gap").otherwise("sparse").alias("reason"), (F.col("end_ms") - 150).alias("start_ms"), (F.col("next_start") + 150).alias("end_ms"))
    return I.merge_windows(windows, ["lane"])


@query(
    f"""{ISLANDS}, g AS (SELECT person, end_ms AS a, lead(start_ms) OVER (PARTITION BY person ORDER BY start_ms, end_ms) AS b FROM merged),
 t AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY b - a DESC, a) AS k FROM g WHERE b - a > 300)
 SELECT person, k AS gap_rank, (a + b) // 2 - 1500 + 100 * i AS at_ms FROM t, range(0, 31) r(i) WHERE k <= 3 AND (a + b) // 2 - 1500 + 100 * i BETWEEN a AND b"""
)
def spotcheck_samples(spark, sf_dir):
    merged = merged_at_300(spark, sf_dir)
    found = I.gaps(merged.withColumn("track_id", F.col("end_ms")), ["person"]).filter("gap > 300")
    top = found.withColumn("gap_rank", F.row_number().over(I.ordered(["person"]).orderBy(F.desc("gap"), "end_ms"))).filter("gap_rank <= 3")
    middle = F.floor((F.col("end_ms") + F.col("next_start")) / 2).cast("bigint")
    at = top.select("person", "gap_rank", "end_ms", "next_start", F.explode(F.sequence(middle - 1500, middle + 1500, F.lit(100).cast("bigint"))).alias("at_ms"))
    return at.filter("at_ms between end_ms and next_start").select("person", F.col("gap_rank").cast("bigint").alias("gap_rank"), "at_ms")


@query(
    f"""{ISLANDS}, g AS (SELECT person, end_ms AS a, lead(start_ms) OVER (PARTITION BY person ORDER BY start_ms, end_ms) AS b FROM merged)
 SELECT person, a AS gap_start, side, CASE side WHEN 'before' THEN a - 1500 ELSE b END + 100 * i AS at_ms FROM g, (VALUES ('before'), ('after')) s(side), range(0, 15) r(i) WHERE b - a > 300"""
)
def boundary_samples(spark, sf_dir):
    found = I.gaps(merged_at_300(spark, sf_dir).withColumn("track_id", F.col("end_ms")), ["person"]).filter("gap > 300")
    sides = F.explode(F.array(F.struct(F.lit("before").alias("side"), (F.col("end_ms") - 1500).alias("a")), F.struct(F.lit("after").alias("side"), F.col("next_start").alias("a")))).alias("s")
    rows = found.select("person", F.col("end_ms").alias("gap_start"), sides)
    return rows.select("person", "gap_start", "s.side", F.explode(F.sequence("s.a", F.col("s.a") + 1499, F.lit(100).cast("bigint"))).alias("at_ms"))


def _runs_sql(step: int, keys: str) -> str:
    return f"""WITH {TRACKS}, o AS (SELECT {keys}, start_ms, CASE WHEN start_ms - lag(start_ms) OVER w <= {step} THEN 0 ELSE 1 END AS opens FROM (SELECT DISTINCT {keys}, start_ms FROM tracks) WINDOW w AS (PARTITION BY {keys} ORDER BY start_ms)),
 p AS (SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY start_ms) AS run FROM o)"""


@query(f"{_runs_sql(400, 'person')} SELECT person, CAST(run AS BIGINT) AS run, min(start_ms) AS first_at, max(start_ms) AS last_at, count(*) AS n, count(*) >= 3 AS accepted FROM p GROUP BY person, run")
def consecutive_runs(spark, sf_dir):
    return I.runs(tracks(spark, sf_dir).select("person", "start_ms").distinct(), ["person"], "start_ms", 400, 3)


@query(f"{_runs_sql(900, 'person')} SELECT person, min(start_ms) AS first_at, max(start_ms) AS last_at, max(start_ms) - min(start_ms) AS span_ms FROM p GROUP BY person, run HAVING max(start_ms) - min(start_ms) >= 2000")
def temporal_segments(spark, sf_dir):
    found = I.runs(tracks(spark, sf_dir).select("person", "start_ms").distinct(), ["person"], "start_ms", 900, 1)
    return found.select("person", "first_at", "last_at", (F.col("last_at") - F.col("first_at")).alias("span_ms")).filter("span_ms >= 2000")


@query(
    f"""WITH {TRACKS}, s AS (SELECT person, frames, track_id - row_number() OVER (PARTITION BY person, frames ORDER BY track_id) AS k, track_id FROM (SELECT 'all' AS person, 0 AS frames, track_id FROM tracks WHERE conf >= 0.6))
 SELECT person, min(track_id) AS first_at, max(track_id) AS last_at, count(*) AS n FROM s GROUP BY person, k HAVING count(*) >= 4"""
)
def contiguous_spans(spark, sf_dir):
    return I.contiguous(tracks(spark, sf_dir).filter("conf >= 0.6").select(F.lit("all").alias("person"), "track_id"), ["person"], "track_id", 4)


@query(f"{ISLANDS} SELECT person, min(start_ms) AS first_ms FROM merged GROUP BY person")
def first_appearance(spark, sf_dir):
    return merged_at_300(spark, sf_dir).groupBy("person").agg(F.min("start_ms").alias("first_ms"))


@query(
    f"""{ISLANDS}, t AS (SELECT person, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms FROM merged GROUP BY person), truth(person, truth_ms) AS (VALUES {", ".join(f"('{p}', {n}::BIGINT)" for p, n in TRUTH)}),
 j AS (SELECT person, truth_ms, coalesce(total_ms, 0) AS total_ms FROM truth LEFT JOIN t USING (person))
 SELECT *, total_ms - truth_ms AS delta_ms, CASE WHEN abs(total_ms - truth_ms) / truth_ms * 100 <= 5 THEN 'PASS' WHEN abs(total_ms - truth_ms) / truth_ms * 100 <= 10 THEN 'WARN' ELSE 'FAIL' END AS percent_status,
  CASE WHEN abs(total_ms - truth_ms) <= 4500 THEN 'PASS' ELSE 'FAIL' END AS status FROM j"""
)
def delta_table(spark, sf_dir):
    truth = spark.createDataFrame(TRUTH, "person string, truth_ms bigint")
    return I.absolute_error(I.totals(merged_at_300(spark, sf_dir)), truth)


@query(
    f"""{ISLANDS}, g AS (SELECT person, conf, members, lead(start_ms) OVER (PARTITION BY person ORDER BY start_ms, end_ms) - end_ms AS gap FROM merged)
 SELECT person, CAST(coalesce(sum(gap) FILTER (gap > 0 AND gap < 5000), 0) AS BIGINT) AS small_gap_ms, coalesce(max(gap), 0) AS largest_gap_ms, round_even(avg(conf), 6) AS mean_conf, CAST(sum(members) AS BIGINT) AS tracks,
  concat_ws(',', CASE WHEN coalesce(max(gap), 0) > 1000 THEN 'large_gap' END, CASE WHEN avg(conf) < 0.85 THEN 'low_quality' END, CASE WHEN sum(members) < 1500 THEN 'few_tracks' END) AS causes FROM g GROUP BY person"""
)
def undercount(spark, sf_dir):
    found = I.gaps(merged_at_300(spark, sf_dir).withColumn("track_id", F.col("end_ms")), ["person"])
    stats = found.groupBy("person").agg(
        F.coalesce(F.sum(F.when((F.col("gap") > 0) & (F.col("gap") < 5000), F.col("gap"))), F.lit(0).cast("bigint")).alias("small_gap_ms"),
        F.coalesce(F.max("gap"), F.lit(0).cast("bigint")).alias("largest_gap_ms"), F.avg("conf").alias("c"), F.sum("members").alias("tracks"),
    )
    cause = lambda name, c: F.when(c, name)
    causes = F.array_compact(F.array(cause("large_gap", F.col("largest_gap_ms") > 1000), cause("low_quality", F.col("c") < 0.85), cause("few_tracks", F.col("tracks") < 1500)))
    return stats.select("person", "small_gap_ms", "largest_gap_ms", F.bround("c", 6).alias("mean_conf"), "tracks", F.array_join(causes, ",").alias("causes"))


@query(
    f"""WITH {TRACKS}, j AS (SELECT a.track_id, b.track_id AS next_id, b.start_ms - a.end_ms AS gap, row_number() OVER (PARTITION BY a.track_id ORDER BY b.start_ms - a.end_ms, b.track_id) AS k
  FROM tracks a JOIN tracks b ON a.person = b.person AND b.start_ms > a.end_ms AND b.start_ms - a.end_ms <= 1000)
 SELECT track_id, next_id, gap FROM j WHERE k = 1"""
)
def nearest_downstream(spark, sf_dir):
    return I.nearest_after(tracks(spark, sf_dir), ["person"], 1000)


@query(
    f"""WITH RECURSIVE {TRACKS}, c AS (SELECT person, start_ms, row_number() OVER (PARTITION BY person ORDER BY start_ms) AS n FROM (SELECT DISTINCT person, start_ms FROM tracks WHERE conf > 0.8)),
 s AS (SELECT person, n, start_ms AS last, true AS kept FROM c WHERE n = 1
  UNION ALL SELECT c.person, c.n, CASE WHEN c.start_ms - s.last >= 5000 THEN c.start_ms ELSE s.last END, c.start_ms - s.last >= 5000 FROM s JOIN c ON c.person = s.person AND c.n = s.n + 1)
 SELECT person, last AS boundary_ms FROM s WHERE kept"""
)
def scene_debounce(spark, sf_dir):
    return I.debounce(tracks(spark, sf_dir).filter("conf > 0.8"), ["person"], "start_ms", 5000).withColumnRenamed("start_ms", "boundary_ms")
