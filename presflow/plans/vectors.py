"""Queries over vectors, matching, confidence and clustering, each with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graphs
from ..operators import vectors as V
from ..sources.views import BANK, DETECTIONS, bank, detections
from .registering import registry

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The test vectors carry no signal, so thresholds are where their similarities lie.
LEAST, MARGIN = 0.2, 0.02
query = registry(QUERIES, SQL)


UNIT = "list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"
EMB = f"emb AS (SELECT vec_id, label, {UNIT.format(v='embedding')} AS u FROM (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings))"


def _embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def _centroids(keys: str, source: str) -> str:
    """CTE of unit centroids by a key."""
    return f"""spread AS (SELECT {keys}, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM {source}), means AS (SELECT {keys}, i, avg(x) AS m, count(*) AS n FROM spread GROUP BY {keys}, i),
 raw AS (SELECT {keys}, max(n) AS n, list(m ORDER BY i) AS v FROM means GROUP BY {keys}), centres AS (SELECT {keys}, n, {UNIT.format(v='v')} AS centroid FROM raw)"""


@query(f"WITH {DETECTIONS}, {_centroids('track_id', 'det')} SELECT track_id, n, list_transform(centroid, lambda x: round_even(x, 6)) AS centroid FROM centres")
def track_centroids(spark, sf_dir):
    return V.centroid(detections(spark, sf_dir), ["track_id"]).select("track_id", "n", F.transform("centroid", lambda x: F.bround(x, 6)).alias("centroid"))


@query(f"WITH {DETECTIONS}, s AS (SELECT identity, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM det), m AS (SELECT identity, i, quantile_cont(x, 0.5) AS m FROM s GROUP BY identity, i) SELECT identity, list(m ORDER BY i) AS template FROM m GROUP BY identity")
def median_templates(spark, sf_dir):
    return V.median_template(detections(spark, sf_dir), ["identity"])


@query(
    f"""WITH {DETECTIONS}, u AS (SELECT cluster_id, vec_id, {UNIT.format(v='embedding')} AS u FROM det),
 s AS (SELECT a.cluster_id, a.vec_id, round(sum(list_dot_product(a.u, b.u)) - 1, 9) AS score FROM u a JOIN u b USING (cluster_id) GROUP BY 1, 2)
 SELECT cluster_id, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, vec_id) = 1"""
)
def medoids(spark, sf_dir):
    return V.medoid(detections(spark, sf_dir), ["cluster_id"], "vec_id").withColumn("score", F.round("score", 6))


BEST = f"""WITH {DETECTIONS}, {BANK}, {_centroids('cluster_id', 'det')},
 sims AS (SELECT cluster_id, identity AS label, max(list_dot_product(centroid, embedding)) AS sim FROM centres, bank GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY sim DESC, label) AS k FROM sims),
 best AS (SELECT cluster_id, max(label) FILTER (k = 1) AS best, max(sim) FILTER (k = 1) AS best_sim, coalesce(max(sim) FILTER (k = 2), 0) AS second_sim FROM r GROUP BY cluster_id)"""


@query(f"{BEST} SELECT cluster_id, best, round(best_sim, 6) AS best_sim, round(best_sim - second_sim, 6) AS margin, CASE WHEN best_sim >= {LEAST} AND best_sim - second_sim >= {MARGIN} THEN best ELSE 'unknown' END AS assigned FROM best")
def open_set(spark, sf_dir):
    centres = V.centroid(detections(spark, sf_dir), ["cluster_id"])
    best = V.best_two(V.identity_sims(centres, bank(spark, sf_dir), ["cluster_id"], "centroid"), ["cluster_id"], "label")
    return V.open_set(best, LEAST, MARGIN).select("cluster_id", "best", F.round("best_sim", 6).alias("best_sim"), F.round("margin", 6).alias("margin"), "assigned")


@query(
    f"""WITH {DETECTIONS}, {BANK}, {_centroids('track_id', 'det')}, sims AS (SELECT track_id, n, identity, max(list_dot_product(centroid, embedding)) AS sim FROM centres, bank WHERE n >= 5 GROUP BY 1, 2, 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY sim DESC, identity) AS k FROM sims), b AS (SELECT track_id, max(identity) FILTER (k = 1) AS best, max(sim) FILTER (k = 1) AS s1, coalesce(max(sim) FILTER (k = 2), 0) AS s2 FROM r GROUP BY 1)
 SELECT track_id, best, round(s1, 6) AS best_sim, CASE WHEN s1 < {LEAST} THEN 'none' WHEN s1 - s2 >= {MARGIN} THEN 'assign' ELSE 'queue' END AS decision FROM b"""
)
def bootstrap_labels(spark, sf_dir):
    centres = V.centroid(detections(spark, sf_dir), ["track_id"]).filter("n >= 5")
    best = V.best_two(V.identity_sims(centres, bank(spark, sf_dir), ["track_id"], "centroid"), ["track_id"], "label")
    decision = F.when(F.col("best_sim") < LEAST, "none").when(F.col("margin") >= MARGIN, "assign").otherwise("queue")
    return best.select("track_id", "best", F.round("best_sim", 6).alias("best_sim"), decision.alias("decision"))


@query(
    f"""WITH {DETECTIONS}, {_centroids('track_id', 'det')}, p AS (SELECT a.track_id AS a, b.track_id AS b, list_dot_product(a.centroid, b.centroid) AS sim, a.n + b.n AS combined_size FROM centres a JOIN centres b ON a.track_id < b.track_id)
 SELECT a, b, round(sim, 6) AS sim, combined_size, row_number() OVER (ORDER BY sim DESC, a, b) AS rank FROM p WHERE sim >= 0.15 ORDER BY rank LIMIT 100"""
)
def merge_suggestions(spark, sf_dir):
    centres = V.centroid(detections(spark, sf_dir), ["track_id"])
    size = lambda c: centres.select(F.col("track_id").alias(c), F.col("n").alias(f"n_{c}"))
    found = V.pairs(centres, "track_id", "centroid", 0.15).join(size("a"), "a").join(size("b"), "b")
    top = found.orderBy(F.desc("sim"), "a", "b").limit(100)
    rank = F.row_number().over(Window.orderBy(F.desc("sim"), "a", "b")).cast("bigint")  # a hundred rows
    return top.select("a", "b", F.round("sim", 6).alias("sim"), (F.col("n_a") + F.col("n_b")).alias("combined_size"), rank.alias("rank"))


FRAMES = f"""WITH {DETECTIONS}, {BANK}, named AS (SELECT *, 'L' || (vec_id % 40 % 12) AS who FROM det), {_centroids('cluster_id', 'named')},
 sims AS (SELECT d.vec_id, d.track_id, d.who, d.cluster_id, {UNIT.format(v='d.embedding')} AS u, b.identity, max(list_dot_product({UNIT.format(v='d.embedding')}, {UNIT.format(v='b.embedding')})) AS sim FROM named d, bank b GROUP BY ALL),
 f AS (SELECT vec_id, track_id, coalesce(max(sim) FILTER (identity = who), max(list_dot_product(u, centroid)), 0.0) AS frame_conf, max(sim) FILTER (identity <> who) AS other FROM sims JOIN centres USING (cluster_id) GROUP BY 1, 2),
 frames AS (SELECT vec_id, track_id, frame_conf, frame_conf - coalesce(other, 0.0) AS frame_margin, frame_conf < 0.2 AS frame_low, other IS NOT NULL AND frame_conf - other < 0.08 AS frame_conflict FROM f)"""


def _frames(spark, sf_dir):
    named = detections(spark, sf_dir).withColumn("identity", F.format_string("L%d", F.col("vec_id") % 40 % 12))
    named = named.join(V.centroid(named, ["cluster_id"]).select("cluster_id", "centroid"), "cluster_id")
    return V.frame_confidence(named, bank(spark, sf_dir), 0.2).withColumn("track_id", F.col("vec_id") % 40)


@query(f"{FRAMES} SELECT vec_id, round(frame_conf, 6) AS frame_conf, round(frame_margin, 6) AS frame_margin, frame_low, frame_conflict FROM frames")
def frame_confidence(spark, sf_dir):
    return _frames(spark, sf_dir).select("vec_id", F.round("frame_conf", 6).alias("frame_conf"), F.round("frame_margin", 6).alias("frame_margin"), "frame_low", "frame_conflict")


TRACK_METRICS = f"""{FRAMES}, tm AS (SELECT track_id, coalesce(n, 0) AS n_frames, coalesce(p25, 0.0) AS p25, coalesce(mean, 0.0) AS mean, coalesce(cf, 0.0) AS conflict_frac, coalesce(mg, 0.0) AS margin, coalesce(v, 0.0) AS var, coalesce(low, 0) AS low
 FROM (SELECT i AS track_id FROM range(0, 45) t(i)) LEFT JOIN (SELECT track_id, count(*) AS n, quantile_cont(frame_conf, 0.25) AS p25, avg(frame_conf) AS mean, avg(frame_conflict::INT) AS cf, avg(frame_margin) AS mg, var_pop(frame_conf) AS v,
  count(*) FILTER (frame_low) AS low FROM frames GROUP BY track_id) USING (track_id))"""


def _track_metrics(spark, sf_dir):
    return V.track_confidence(spark.range(45).withColumnRenamed("id", "track_id"), _frames(spark, sf_dir))


@query(f"{TRACK_METRICS} SELECT track_id, n_frames, round(p25, 6) AS p25, round(mean, 6) AS mean, round(var, 6) AS var, round(margin, 6) AS margin, round(conflict_frac, 6) AS conflict_frac, low FROM tm")
def track_confidence(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return _track_metrics(spark, sf_dir).select("track_id", "n_frames", r("p25"), r("mean"), r("var"), r("margin"), r("conflict_frac"), "low")


MEMBERS = "mem AS (SELECT i AS track_id, i % 8 AS cluster_id, CASE WHEN i % 8 < 6 THEN 'P' || (i % 8 % 5) END AS name FROM range(0, 45) t(i))"
CLUSTERS = f"""{MEMBERS}, tc AS (SELECT track_id % 8 AS cluster_id, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS i FROM ({{centres}})), sq AS (SELECT cluster_id, i, sum(x) AS s, count(*) AS n FROM tc GROUP BY 1, 2),
 sim AS (SELECT cluster_id, CASE WHEN max(n) = 1 THEN 1.0 ELSE (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) END AS pairwise FROM sq GROUP BY 1),
 c AS (SELECT cluster_id, coalesce(name, 'Unknown') AS name, count(*) AS tracks, quantile_cont(p25, 0.5) AS p25_median, min(p25) AS p25_min, CASE WHEN sum(n_frames) > 0 THEN sum(conflict_frac * n_frames) / sum(n_frames) ELSE 0 END AS contam FROM mem JOIN tm USING (track_id) GROUP BY 1, 2)"""
TRACK_CENTRES = f"""SELECT track_id, {UNIT.format(v='v')} AS centroid FROM (SELECT track_id, list(m ORDER BY i) AS v FROM (SELECT track_id, i, avg(x) AS m FROM (SELECT track_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM det) GROUP BY 1, 2) GROUP BY 1)"""
CLUSTERS = CLUSTERS.format(centres=TRACK_CENTRES)


def _members(spark):
    c = F.col("id") % 8
    return spark.range(45).select(F.col("id").alias("track_id"), c.alias("cluster_id"), F.when(c < 6, F.format_string("P%d", c % 5)).alias("name"))


@query(f"{TRACK_METRICS}, {CLUSTERS} SELECT cluster_id, name, tracks, round(p25_median, 6) AS p25_median, round(p25_min, 6) AS p25_min, round(contam, 6) AS contam, round(coalesce(pairwise, 0), 6) AS pairwise_sim, p25_median < 0.2 OR contam >= 0.8 AS is_low FROM c LEFT JOIN sim USING (cluster_id)")
def cluster_metrics(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    rows = V.cluster_confidence(_members(spark), _track_metrics(spark, sf_dir), V.centroid(detections(spark, sf_dir), ["track_id"]))
    return rows.select("cluster_id", "name", "tracks", r("p25_median"), r("p25_min"), r("contam"), r("pairwise_sim"), ((F.col("p25_median") < 0.2) | (F.col("contam") >= 0.8)).alias("is_low"))


@query(
    f"""{TRACK_METRICS}, {MEMBERS} SELECT name AS person, count(DISTINCT cluster_id) AS n_clusters, count(*) AS n_tracks, round(quantile_cont(p25, 0.5), 6) AS p25_median, round(sum(conflict_frac * n_frames) / sum(n_frames), 6) AS contam,
 round(coalesce(quantile_cont(margin, 0.5) FILTER (n_frames > 0), 0), 6) AS margin FROM mem JOIN tm USING (track_id) WHERE name IS NOT NULL GROUP BY 1"""
)
def person_metrics(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return V.person_confidence(_members(spark), _track_metrics(spark, sf_dir)).select("person", "n_clusters", "n_tracks", r("p25_median"), r("contam"), r("margin"))


IOU = "(SELECT CASE WHEN u > 0 THEN i / u ELSE 0 END FROM (SELECT i, (l.x2 - l.x1) * (l.y2 - l.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - i AS u FROM (SELECT greatest(least(l.x2, r.x2) - greatest(l.x1, r.x1), 0) * greatest(least(l.y2, r.y2) - greatest(l.y1, r.y1), 0) AS i)))"


@query(
    f"""WITH {DETECTIONS} SELECT vec_id, frame_id, greatest(x2 - x1, y2 - y1) AS face_size FROM det l WHERE vec_id % 9 >= 2 AND conf >= 0.6 AND greatest(x2 - x1, y2 - y1) >= 80
 AND NOT EXISTS (SELECT 1 FROM det r WHERE r.frame_id = l.frame_id AND (r.x1 <> l.x1 OR r.y1 <> l.y1 OR r.x2 <> l.x2 OR r.y2 <> l.y2) AND {IOU} > 0.1)"""
)
def face_samples(spark, sf_dir):
    return V.face_samples(detections(spark, sf_dir).withColumn("sharpness", F.col("vec_id") % 9), 0.6, 80, 0.1, 2).select("vec_id", "frame_id", "face_size")


QUALITY = "0.6 * greatest(0.0, (conf - 0.5) / 0.5) + 0.3 * least(greatest((greatest(x2 - x1, y2 - y1) - 72) / 228.0, 0.0), 1.0) + 0.1 * 0.5"


@query(f"WITH {DETECTIONS}, q AS (SELECT track_id, vec_id, {QUALITY} AS quality FROM det) SELECT track_id, vec_id, round(quality, 6) AS quality, row_number() OVER (PARTITION BY track_id ORDER BY quality DESC, vec_id) AS nth FROM q QUALIFY nth <= 10")
def topk_per_track(spark, sf_dir):
    scored = detections(spark, sf_dir).withColumn("quality", V.sample_quality(F.col("conf"), F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), F.lit(0.5)))
    return V.top_k(scored, ["track_id"], 10, F.desc("quality"), F.col("vec_id")).select("track_id", "vec_id", F.round("quality", 6).alias("quality"), F.col("nth").cast("bigint").alias("nth"))


@query(
    f"""WITH {EMB}, s AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - list_dot_product(a.u, b.u)) AS d, count(*) AS n FROM emb a, emb b WHERE a.vec_id <> b.vec_id GROUP BY 1, 2, 3)
 SELECT vec_id, label, round((b - a) / greatest(a, b), 6) AS silhouette FROM (SELECT vec_id, label, max(d / n) FILTER (other = label) AS a, min(d / n) FILTER (other <> label) AS b FROM s GROUP BY 1, 2)"""
)
def silhouette(spark, sf_dir):
    return V.silhouette(_embeddings(spark, sf_dir)).withColumn("silhouette", F.round("silhouette", 6))


@query(
    f"""WITH {EMB}, {_centroids('label', '(SELECT label, embedding::DOUBLE[] AS embedding FROM embeddings)')}, m AS (SELECT e.vec_id, e.label, max(list_dot_product(u, centroid)) FILTER (c.label = e.label) AS own,
  greatest(0.0, max(list_dot_product(u, centroid)) FILTER (c.label <> e.label)) AS other FROM emb e, centres c GROUP BY 1, 2)
 SELECT label, count(*) AS n, count(*) FILTER (own < 0.1) AS outliers, count(*) FILTER (other - own >= 0.05) AS "cross", (count(*) FILTER (own < 0.1) + count(*) FILTER (other - own >= 0.05)) / count(*) AS impurity FROM m GROUP BY label"""
)
def impurity(spark, sf_dir):
    return V.impurity(_embeddings(spark, sf_dir), 0.1, 0.05)


KTH = f"WITH {EMB}, d AS (SELECT a.vec_id, 1 - list_dot_product(a.u, b.u) AS d, b.vec_id AS other FROM emb a, emb b), k AS (SELECT vec_id, greatest(0.0, d) AS kth FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, other) = 6)"


@query(
    f"""{KTH}, p AS (SELECT count(*) AS n, quantile_cont(kth, 0.25) AS p25, quantile_cont(kth, 0.5) AS p50, quantile_cont(kth, 0.75) AS p75, quantile_cont(kth, 0.9) AS p90 FROM k)
 SELECT n, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(p90, 6) AS p90, (SELECT count(*) FROM k, p WHERE kth < p75) AS knee_index, round(least(0.5, greatest(0.4, p75)), 6) AS eps FROM p"""
)
def knn_knee(spark, sf_dir):
    tuned = V.tuned_radius(_embeddings(spark, sf_dir))
    return tuned.select("n", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75", "p90")], "knee_index", F.round("eps", 6).alias("eps"))


@query(
    f"""WITH RECURSIVE {EMB}, l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM emb a JOIN emb b ON a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 1 - 0.65),
 core AS (SELECT a FROM l GROUP BY a HAVING count(*) + 1 >= 4), ce AS (SELECT l.a, l.b FROM l WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
 reach AS (SELECT a AS node, a AS root FROM core UNION SELECT ce.b, r.root FROM reach r JOIN ce ON ce.a = r.node), comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
 mem AS (SELECT node AS vec_id, root FROM comp UNION ALL SELECT l.a, min(comp.root) FROM l JOIN comp ON comp.node = l.b WHERE l.a NOT IN (SELECT a FROM core) GROUP BY l.a),
 num AS (SELECT root, row_number() OVER (ORDER BY min(vec_id)) - 1 AS cluster FROM mem GROUP BY root)
 SELECT e.vec_id, coalesce(cluster, -1) AS cluster FROM emb e LEFT JOIN mem USING (vec_id) LEFT JOIN num USING (root)"""
)
def dbscan(spark, sf_dir):
    return V.dbscan(_embeddings(spark, sf_dir), 0.65, 4, graphs.components)


@query(
    f"""WITH RECURSIVE {EMB}, l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM emb a JOIN emb b ON a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.36),
 reach AS (SELECT DISTINCT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM reach r JOIN l ON l.a = r.node) SELECT node, min(root) AS component FROM reach GROUP BY node"""
)
def link_components(spark, sf_dir):
    unit = _embeddings(spark, sf_dir).select("vec_id", V.l2_normalise("embedding").alias("u"))
    return graphs.components(V.connecting(unit, "vec_id", "u", 0.36))


NAMED = """named AS (SELECT event_id AS track_id, user_id AS cluster_id, CASE WHEN user_id % 7 < 5 THEN 'N' || (user_id % 7 % 3) END AS name,
 CASE WHEN user_id % 7 = 4 THEN 0.8::DOUBLE WHEN user_id % 7 = 1 THEN NULL ELSE 1.0::DOUBLE END AS confidence FROM events),
 cannot AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS b FROM events)"""


def _named(spark, sf_dir):
    c = F.col("user_id") % 7
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    name = F.when(c < 5, F.format_string("N%d", c % 3))
    return rows.select(F.col("event_id").alias("track_id"), F.col("user_id").alias("cluster_id"), name.alias("name"), F.when(c == 4, F.lit(0.8)).when(c == 1, F.lit(None).cast("double")).otherwise(F.lit(1.0)).alias("confidence"))


def _cannot(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return rows.select(F.col("event_id").alias("a"), F.lead("event_id").over(Window.partitionBy(F.col("user_id") % 50).orderBy("event_id")).alias("b")).filter("b is not null")


HAND = "h AS (SELECT * FROM named WHERE name IS NOT NULL AND (confidence IS NULL OR confidence = 1.0)), n AS (SELECT name, min(track_id) AS a FROM h GROUP BY 1)"
LINKS = f"""{NAMED}, {HAND}, links AS (SELECT 'must' AS kind, (SELECT min(track_id) FROM h f WHERE f.cluster_id = h.cluster_id) AS a, track_id AS b FROM h WHERE a < b UNION ALL SELECT 'cannot', least(l.a, r.a), greatest(l.a, r.a) FROM n l JOIN n r ON l.a < r.a)"""


@query(f"WITH {LINKS} SELECT * FROM links")
def must_cannot_links(spark, sf_dir):
    return graphs.must_cannot(_named(spark, sf_dir))


@query(f"WITH {NAMED}, {HAND}, q AS (SELECT * FROM h WHERE track_id % 1000 = 0) SELECT DISTINCT CASE WHEN q.cluster_id = h.cluster_id THEN 'must' ELSE 'cannot' END AS kind, least(q.track_id, h.track_id) AS a, greatest(q.track_id, h.track_id) AS b FROM q JOIN h ON q.track_id <> h.track_id AND (q.cluster_id = h.cluster_id OR q.name <> h.name)")
def constraint_pairs(spark, sf_dir):
    named = _named(spark, sf_dir)
    return graphs.expanded(named, named.filter("track_id % 1000 = 0").select("track_id"))


@query(f"WITH {LINKS}, s AS (SELECT kind, a AS t FROM links UNION ALL SELECT kind, b FROM links) SELECT (SELECT count(*) FROM links WHERE kind = 'must') AS must_links, (SELECT count(*) FROM links WHERE kind = 'cannot') AS cannot_links, count(DISTINCT t) AS tracks, count(DISTINCT t) FILTER (kind = 'must') AS must_tracks FROM s")
def constraint_counts(spark, sf_dir):
    return graphs.constraint_counts(graphs.must_cannot(_named(spark, sf_dir)))


@query(f"WITH {LINKS} SELECT DISTINCT * FROM (SELECT * FROM links UNION ALL SELECT 'cannot', least(a, b), greatest(a, b) FROM cannot WHERE b IS NOT NULL)")
def all_constraints(spark, sf_dir):
    return graphs.all_constraints(graphs.must_cannot(_named(spark, sf_dir)), _cannot(spark, sf_dir).withColumn("kind", F.lit("cannot")))


@query(
    f"""WITH {NAMED}, hit AS (SELECT DISTINCT l.cluster_id, unnest([a, b]) AS track_id FROM cannot JOIN named l ON l.track_id = a JOIN named r ON r.track_id = b WHERE l.cluster_id = r.cluster_id AND l.name IS NULL),
 new AS (SELECT cluster_id, (SELECT max(cluster_id) FROM named) + row_number() OVER (ORDER BY cluster_id) AS new_id FROM (SELECT DISTINCT cluster_id FROM hit))
 SELECT CASE WHEN hit.track_id IS NOT NULL THEN new_id ELSE n.cluster_id END AS cluster_id, n.track_id, n.name FROM named n LEFT JOIN hit USING (cluster_id, track_id) LEFT JOIN new USING (cluster_id)"""
)
def enforce_cannot_links(spark, sf_dir):
    return graphs.enforce_cannot(_named(spark, sf_dir).select("cluster_id", "track_id", "name"), _cannot(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {DETECTIONS}, b AS (SELECT *, vec_id // 50 AS tile, row_number() OVER (PARTITION BY vec_id // 50 ORDER BY conf DESC, vec_id) AS n FROM det),
 over AS (SELECT l.tile, l.n AS a, r.n AS b FROM b l JOIN b r ON l.tile = r.tile AND l.n < r.n AND {IOU} > 0.3),
 s AS (SELECT DISTINCT tile, 0::BIGINT AS n, []::BIGINT[] AS kept FROM b
  UNION ALL SELECT s.tile, s.n + 1, CASE WHEN EXISTS (SELECT 1 FROM over o WHERE o.tile = s.tile AND o.b = s.n + 1 AND list_contains(s.kept, o.a)) THEN s.kept ELSE list_append(s.kept, s.n + 1) END FROM s WHERE EXISTS (SELECT 1 FROM b WHERE b.tile = s.tile AND b.n = s.n + 1)),
 f AS (SELECT tile, arg_max(kept, n) AS kept FROM s GROUP BY 1) SELECT b.tile, b.vec_id FROM b JOIN f ON f.tile = b.tile AND list_contains(f.kept, b.n)"""
)
def nms(spark, sf_dir):
    return V.nms(detections(spark, sf_dir).withColumn("tile", F.floor(F.col("vec_id") / 50)), ["tile"], "vec_id", 0.3)


@query(
    f"""WITH {EMB}, q AS (SELECT * FROM emb WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, e.label, list_dot_product(q.u, e.u) AS score, e.vec_id FROM q, emb e),
 t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 12), l AS (SELECT query_id, label, max(score) AS score FROM t GROUP BY 1, 2)
 SELECT query_id, label, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS nth FROM l QUALIFY nth <= 3"""
)
def index_search(spark, sf_dir):
    unit = _embeddings(spark, sf_dir).select("vec_id", "label", V.l2_normalise("embedding").alias("u"))
    queries = unit.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("u").alias("q"))
    scored = V.products(queries, unit, "q", "u", best=12).withColumnRenamed("sim", "score")
    near = V.top_k(scored, ["query_id"], 12, F.desc("score"), F.col("vec_id")).groupBy("query_id", "label").agg(F.max("score").alias("score"))
    return V.top_k(near, ["query_id"], 3, F.desc("score"), F.col("label")).select("query_id", "label", F.round("score", 6).alias("score"), F.col("nth").cast("bigint").alias("nth"))


@query("WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) SELECT doc_id, source FROM d WHERE n = 1")
def dedup_exact(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return docs.select("doc_id", "source").join(first, "doc_id", "left_semi")
