"""Queries of the audits, each with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as A
from ..operators import vectors as V
from ..operators.graphs import components
from ..sources.views import BANK, DETECTIONS, bank, detections
from .vectors import NAMED, TRACK_METRICS, UNIT, _centroids, _named, _track_metrics
from .registering import registry

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)


HITS = f"""WITH {DETECTIONS}, {_centroids('cluster_id', 'det')}, u AS (SELECT vec_id, cluster_id, vec_id // 40 * 5 + vec_id % 40 // 8 AS at_, {UNIT.format(v='embedding')} AS u FROM det),
 s AS (SELECT u.vec_id, u.cluster_id, u.at_, c.cluster_id AS other, list_dot_product(u.u, c.centroid) AS s FROM u, centres c),
 b AS (SELECT vec_id, cluster_id, at_, max(s) FILTER (other = cluster_id) AS own, greatest(0.0, max(s) FILTER (other <> cluster_id)) AS best, arg_max(other, s) FILTER (other <> cluster_id) AS o FROM s GROUP BY 1, 2, 3),
 hits AS (SELECT vec_id, cluster_id, at_, best - own AS strength, CASE WHEN best > 0 THEN o END AS other FROM b WHERE best - own >= -0.12)"""


def _hits(spark, sf_dir):
    rows = detections(spark, sf_dir)
    centres = V.centroid(rows, ["cluster_id"]).select(F.col("cluster_id").alias("other"), "centroid")
    at = (F.floor(F.col("vec_id") / 40) * 5 + F.floor(F.col("vec_id") % 40 / 8)).cast("bigint")
    frames = rows.select(F.col("vec_id").alias("item"), "cluster_id", at.alias("at"), V.l2_normalise("embedding").alias("u"))
    return A.cross_contamination(frames, centres, -0.12)


@query(f"{HITS} SELECT vec_id AS item, cluster_id, round(strength, 6) AS strength, other FROM hits")
def cross_contamination(spark, sf_dir):
    return _hits(spark, sf_dir).select("item", "cluster_id", F.round("strength", 6).alias("strength"), "other")


@query(
    f"""{HITS}, r AS (SELECT *, at_ - row_number() OVER (PARTITION BY cluster_id ORDER BY at_) AS run FROM hits)
 SELECT cluster_id, min(at_) AS first_at, max(at_) AS last_at, count(*) AS n, round(avg(strength), 6) AS strength, CASE WHEN min(other) = max(other) THEN 'split_to_' || min(other) WHEN min(other) IS NULL THEN 'split_to_unknown' ELSE 'flag' END AS action
 FROM r GROUP BY cluster_id, run HAVING count(*) >= 2"""
)
def contamination_spans(spark, sf_dir):
    return A.contamination_spans(_hits(spark, sf_dir), 2).withColumn("strength", F.round("strength", 6))


@query(
    f"""WITH {BANK}, s AS (SELECT a.proto_id, a.identity, max(list_dot_product(a.embedding, b.embedding)) FILTER (a.identity = b.identity) AS own, max(list_dot_product(a.embedding, b.embedding)) FILTER (a.identity <> b.identity) AS rival
  FROM bank a JOIN bank b ON a.proto_id <> b.proto_id GROUP BY 1, 2), g AS (SELECT identity, count(*) AS prototypes, list(own ORDER BY own) FILTER (own IS NOT NULL) AS own, avg((coalesce(rival, -1) > 0.25)::INT) AS contam FROM s GROUP BY identity)
 SELECT identity, prototypes, round(own[CAST(floor(len(own) * 0.25) AS INT) + 1], 6) AS p25, round(contam, 6) AS contam FROM g"""
)
def bank_metrics(spark, sf_dir):
    return A.bank_metrics(bank(spark, sf_dir), 0.25).select("identity", "prototypes", F.round("p25", 6).alias("p25"), F.round("contam", 6).alias("contam"))


@query(
    f"""{TRACK_METRICS} SELECT track_id, list_filter([CASE WHEN p25 < 0.15 THEN printf('LOW p25 %.2f', p25) END, CASE WHEN conflict_frac >= 0.9 THEN printf('HIGH conflict %.2f', conflict_frac) END], lambda x: x IS NOT NULL) AS reasons
 FROM tm WHERE p25 < 0.15 OR conflict_frac >= 0.9"""
)
def doubtful_tracks(spark, sf_dir):
    rows = _track_metrics(spark, sf_dir).select("track_id", A.reasons(F.col("p25"), F.col("conflict_frac"), 0.15, 0.9).alias("reasons"))
    return rows.filter(F.size("reasons") > 0)


@query(
    f"""WITH {DETECTIONS} SELECT vec_id, CASE WHEN abs((vec_id % 21 - 10) / 12.0::DOUBLE) > 0.5 THEN 'profile' WHEN abs((vec_id % 21 - 10) / 12.0::DOUBLE) > 0.25 THEN 'three_quarter' ELSE 'frontal' END || CASE WHEN greatest(x2 - x1, y2 - y1) < 100 THEN '_small' ELSE '_large' END AS bin FROM det"""
)
def pose_bins(spark, sf_dir):
    size = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return detections(spark, sf_dir).select("vec_id", A.pose_bin((F.col("vec_id") % 21 - 10) / 12.0, size).alias("bin"))


@query(f"WITH {DETECTIONS} SELECT identity, vec_id, y2 - y1 AS height, conf FROM det QUALIFY row_number() OVER (PARTITION BY identity ORDER BY y2 - y1 DESC, conf DESC, vec_id) = 1")
def best_seeds(spark, sf_dir):
    rows = detections(spark, sf_dir).select("identity", "vec_id", (F.col("y2") - F.col("y1")).alias("height"), "conf")
    return A.best_of(rows, ["identity"], "vec_id", "height", "conf")


@query(
    f"""WITH RECURSIVE {NAMED}, fm AS (SELECT cluster_id, min(track_id) AS node FROM named GROUP BY 1), l AS (SELECT x.node AS a, y.node AS b FROM fm x JOIN fm y ON y.cluster_id = x.cluster_id + 1 WHERE x.cluster_id % 4 < 2),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT DISTINCT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
 comp AS (SELECT node, min(root) AS component FROM r GROUP BY node), small AS (SELECT cluster_id, name, min(track_id) AS node FROM named GROUP BY 1, 2), tied AS (SELECT component, cluster_id, name FROM small JOIN comp USING (node)),
 f AS (SELECT component, arg_min(cluster_id, (name IS NULL)::INT * 1000000 + cluster_id) AS to_, arg_min(coalesce(name, ''), (name IS NULL)::INT * 1000000 + cluster_id) AS to_name FROM tied GROUP BY 1), m AS (SELECT cluster_id, to_, nullif(to_name, '') AS to_name FROM tied JOIN f USING (component))
 SELECT coalesce(to_, n.cluster_id) AS cluster_id, track_id, CASE WHEN to_ IS NOT NULL THEN to_name ELSE name END AS name FROM named n LEFT JOIN m USING (cluster_id)"""
)
def enforce_must_links(spark, sf_dir):
    named = _named(spark, sf_dir).select("cluster_id", "track_id", "name")
    first = named.groupBy("cluster_id").agg(F.min("track_id").alias("node"))
    following = first.select((F.col("cluster_id") - 1).alias("cluster_id"), F.col("node").alias("b"))
    links = first.filter("cluster_id % 4 < 2").join(following, "cluster_id").select(F.col("node").alias("a"), "b")
    return A.enforce_must(named, components(links))


GUARD = -0.12
#: Pairs of clusters that must stay apart: one pair of N1, and all of N2 but two pairs that do not meet.
APART = [(1, 13), (2, 8), (2, 26), (8, 32), (26, 32), (14, 2), (14, 8), (14, 26), (14, 32), (2, 38), (14, 38), (8, 38), (26, 38), (32, 38)]


@query(
    f"""WITH RECURSIVE {DETECTIONS}, {_centroids('track_id', 'det')}, c AS (SELECT track_id AS cluster_id, 'N' || (track_id % 6) AS name, CASE WHEN track_id % 5 = 0 THEN 0.5 ELSE 1.0 END AS confidence, track_id % 7 > 0 AS has, centroid FROM centres),
 k AS (SELECT * FROM c WHERE confidence = 1.0), far AS (SELECT DISTINCT x.name FROM k x JOIN k y ON x.name = y.name AND x.cluster_id < y.cluster_id AND x.has AND y.has AND list_dot_product(x.centroid, y.centroid) < {GUARD}),
 e AS (SELECT x.cluster_id AS a, y.cluster_id AS b FROM k x JOIN k y ON x.name = y.name AND x.cluster_id <> y.cluster_id AND x.name NOT IN (FROM far) AND NOT (least(x.cluster_id, y.cluster_id), greatest(x.cluster_id, y.cluster_id)) IN ({", ".join(str((min(p), max(p))) for p in APART)})),
 r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node AS cluster_id, min(root) AS target FROM r GROUP BY node HAVING min(root) < node"""
)
def consolidate_names(spark, sf_dir):
    t = F.col("track_id")
    rows = V.centroid(detections(spark, sf_dir), ["track_id"]).select(t.alias("cluster_id"), F.format_string("N%d", t % 6).alias("name"), F.when(t % 5 == 0, 0.5).otherwise(1.0).alias("confidence"), F.when(t % 7 > 0, F.col("centroid")).alias("centroid"))
    return A.consolidate(rows, GUARD, spark.createDataFrame(APART, "a bigint, b bigint"))


@query(
    f"""WITH RECURSIVE {DETECTIONS}, o AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY vec_id) - 1 AS n, {UNIT.format(v='embedding')} AS u FROM det), near AS (SELECT a.track_id, a.n AS a, b.n AS b FROM o a JOIN o b ON a.track_id = b.track_id AND a.n < b.n AND list_dot_product(a.u, b.u) >= 0.2),
 s AS (SELECT DISTINCT track_id, -1::BIGINT AS n, []::BIGINT[] AS kept FROM o
  UNION ALL SELECT s.track_id, s.n + 1, CASE WHEN EXISTS (SELECT 1 FROM near x WHERE x.track_id = s.track_id AND x.b = s.n + 1 AND list_contains(s.kept, x.a)) THEN s.kept ELSE list_append(s.kept, s.n + 1) END FROM s WHERE EXISTS (SELECT 1 FROM o WHERE o.track_id = s.track_id AND o.n = s.n + 1))
, f AS (SELECT track_id, arg_max(kept, n) AS kept FROM s GROUP BY 1),
 v AS (SELECT track_id, vec_id, row_number() OVER (PARTITION BY track_id ORDER BY vec_id) - 1 AS n FROM det)
 SELECT v.track_id, vec_id FROM v JOIN f ON f.track_id = v.track_id AND list_contains(kept, n)"""
)
def greedy_distinct(spark, sf_dir):
    return A.greedy_distinct(detections(spark, sf_dir), ["track_id"], "vec_id", 0.2)


@query(
    f"""WITH {DETECTIONS}, {_centroids('cluster_id', 'det')}, f AS (SELECT d.cluster_id, list_dot_product({UNIT.format(v='d.embedding')}, c.centroid) AS sim, conf FROM det d JOIN centres c USING (cluster_id))
 SELECT cluster_id, count(*) AS n, round(avg(sim), 6) AS mean_sim, round(min(sim), 6) AS least_sim, round(avg((conf < 0.7)::INT), 6) AS doubtful FROM f GROUP BY 1"""
)
def cluster_audit(spark, sf_dir):
    rows = detections(spark, sf_dir)
    frames = rows.join(V.centroid(rows, ["cluster_id"]).select("cluster_id", "centroid"), "cluster_id").select("cluster_id", V.dot(V.l2_normalise("embedding"), "centroid").alias("sim"), "conf")
    r = lambda c: F.round(c, 6).alias(c)
    return A.cluster_audit(frames).select("cluster_id", "n", r("mean_sim"), r("least_sim"), r("doubtful"))
