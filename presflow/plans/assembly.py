"""Queries of the joins and filters between tracks, clusters and detections, each with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A
from ..operators import intervals as I
from ..operators import tracking as T
from ..operators import vectors as V
from ..sources.views import BANK, DETECTIONS, TRACKS, bank, detections, tracks
from .vectors import TRACK_METRICS, UNIT, _track_metrics
from .registering import registry

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)


#: Tracks of detections as documents have them: 45 tracks, of which five refer to faces that others refer to as well; every third has no
#: times, and one has no references.
TRACK_DOCS = f"""{DETECTIONS}, refs AS (SELECT vec_id % 40 AS track_id, vec_id // 40 AS ord, frame_id, det_idx, conf FROM det UNION ALL SELECT 40 + vec_id % 4, vec_id // 40, frame_id, det_idx, conf FROM det WHERE vec_id % 9 = 0),
 manifest AS (SELECT DISTINCT frame_id, frame_id * 40 AS ts_ms, frame_id % 3 <> 1 AS sampled FROM det),
 docs AS (SELECT t.i AS track_id, CASE WHEN t.i % 3 > 0 THEN min(frame_id) * 40 END AS start_ms, CASE WHEN t.i % 3 > 0 THEN max(frame_id) * 40 END AS end_ms, CASE WHEN t.i % 4 > 0 THEN count(frame_id) END AS count, avg(conf) AS mean_confidence
  FROM range(0, 45) t(i) LEFT JOIN refs ON refs.track_id = t.i GROUP BY t.i),
 mem AS (SELECT i AS track_id, i % 8 AS cluster_id FROM range(0, 45) t(i)), names AS (SELECT i AS cluster_id, CASE i WHEN 6 THEN 'SKIP' WHEN 7 THEN NULL ELSE 'P' || (i % 4) END AS person FROM range(0, 8) t(i)),
 rules(person, frozen, min_frames, min_visible, visible_conf) AS (VALUES ('P0', false, 14, NULL, NULL), ('P1', false, NULL, 0.5::DOUBLE, 0.7::DOUBLE), ('P2', true, 1000, 1.0::DOUBLE, 0.9::DOUBLE))"""


def references(spark, sf_dir):
    det = detections(spark, sf_dir)
    ref = lambda track: (track.alias("track_id"), F.floor(F.col("vec_id") / 40).cast("int").alias("ord"), "frame_id", "det_idx", "conf")
    return det.select(*ref(F.col("vec_id") % 40)).unionByName(det.filter("vec_id % 9 = 0").select(*ref(40 + F.col("vec_id") % 4)))


def manifest(spark, sf_dir):
    frames = detections(spark, sf_dir).select("frame_id").distinct()
    return frames.select("frame_id", (F.col("frame_id") * 40).alias("ts_ms"), (F.col("frame_id") % 3 != 1).alias("sampled"))


def track_docs(spark, sf_dir):
    t, stats = F.col("track_id"), references(spark, sf_dir).groupBy("track_id").agg(F.min("frame_id").alias("a"), F.max("frame_id").alias("b"), F.count("*").alias("n"), F.avg("conf").alias("mean_confidence"))
    rows = spark.range(45).withColumnRenamed("id", "track_id").join(stats, "track_id", "left")
    timed = lambda c: F.when(t % 3 > 0, F.col(c) * 40)
    return rows.select("track_id", timed("a").alias("start_ms"), timed("b").alias("end_ms"), F.when(t % 4 > 0, F.coalesce("n", F.lit(0))).cast("bigint").alias("count"), "mean_confidence")


def cluster_docs(spark):
    return spark.range(45).groupBy((F.col("id") % 8).alias("cluster_id")).agg(F.sort_array(F.collect_list("id")).alias("track_ids"))


def names(spark):
    c = F.col("id")
    return spark.range(8).select(c.alias("cluster_id"), F.when(c == 6, "SKIP").when(c < 6, F.format_string("P%d", c % 4)).alias("person"))


def rules(spark):
    return spark.createDataFrame([("P0", False, 14, None, None), ("P1", False, None, 0.5, 0.7), ("P2", True, 1000, 1.0, 0.9)], "person string, freeze boolean, min_frames int, min_visible double, visible_conf double")


@query(f"WITH {TRACK_DOCS}, l AS (SELECT frame_id, det_idx, max(track_id) AS track_id FROM refs GROUP BY 1, 2) SELECT vec_id, l.track_id FROM det JOIN l USING (frame_id, det_idx)")
def detections_of_tracks(spark, sf_dir):
    return A.of_tracks(detections(spark, sf_dir), references(spark, sf_dir)).select("vec_id", "track_id")


@query(f"WITH {TRACK_DOCS}, d AS (SELECT vec_id // 3 AS vec_id, frame_id // 2 AS frame_id, det_idx FROM det), f AS (SELECT frame_id, det_idx, min(vec_id) AS vec_id FROM d GROUP BY 1, 2) SELECT r.track_id, r.ord, f.vec_id FROM refs r JOIN f USING (frame_id, det_idx)")
def first_detections(spark, sf_dir):
    half = detections(spark, sf_dir).select(F.floor(F.col("vec_id") / 3).alias("vec_id"), F.floor(F.col("frame_id") / 2).alias("frame_id"), "det_idx", "track_id", "conf")
    return A.looked_up(half, references(spark, sf_dir), "vec_id").select("track_id", "ord", "vec_id")


RAW = f"""WITH {TRACK_DOCS}, ts AS (SELECT r.*, ts_ms FROM refs r JOIN manifest USING (frame_id)), seen AS (SELECT track_id, min(ts_ms) AS a, max(ts_ms) AS b FROM ts GROUP BY 1),
 known AS (SELECT person, d.track_id, coalesce(d.start_ms, a) AS start_ms, coalesce(d.end_ms, b) AS end_ms, d.start_ms IS NULL OR d.end_ms IS NULL AS rebuilt, mean_confidence AS conf, d.count, frozen, min_frames, min_visible, coalesce(visible_conf, 0.7) AS vc
  FROM mem JOIN names USING (cluster_id) JOIN docs d USING (track_id) LEFT JOIN seen USING (track_id) LEFT JOIN rules USING (person) WHERE person IS NOT NULL AND person <> 'SKIP'),
 counted AS (SELECT k.*, (SELECT count(*) FROM refs r WHERE r.track_id = k.track_id) AS n, (SELECT count(*) FROM refs r WHERE r.track_id = k.track_id AND r.conf >= vc) AS sure FROM known k WHERE start_ms IS NOT NULL),
 sized AS (SELECT *, CASE WHEN count > 0 THEN count ELSE n END AS frames FROM counted), raw AS (SELECT person, track_id, start_ms, end_ms, conf, frames, CASE WHEN frames > 0 THEN sure / frames ELSE 0.0 END AS visible, rebuilt, frozen, min_frames, min_visible FROM sized),
 kept AS (SELECT * FROM raw WHERE coalesce(frozen, false) OR frames >= coalesce(min_frames, 0) AND visible >= coalesce(min_visible, 0))"""


def _raw(spark, sf_dir):
    members = A.persons(cluster_docs(spark), names(spark)).select("track_id", "person")
    return A.raw_intervals(members, track_docs(spark, sf_dir), A.stamped(references(spark, sf_dir), manifest(spark, sf_dir)), rules(spark))


@query(f"{RAW} SELECT person, track_id, start_ms, end_ms, round(conf, 9) AS conf, frames, round(visible, 9) AS visible, rebuilt FROM kept")
def raw_intervals(spark, sf_dir):
    return _raw(spark, sf_dir).withColumn("conf", F.round("conf", 9)).withColumn("visible", F.round("visible", 9))


@query(
    f"""{RAW}, b AS (SELECT *, max(end_ms) OVER (PARTITION BY person ORDER BY start_ms, track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM kept),
 p AS (SELECT *, sum(CASE WHEN e IS NULL OR start_ms - e > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY person ORDER BY start_ms, track_id) AS k FROM b), m AS (SELECT person, k, min(start_ms) AS a, max(end_ms) AS b FROM p GROUP BY 1, 2)
 SELECT person, CAST(sum(b - a) AS BIGINT) AS total_ms, count(*) AS appearances, min(a) AS first_ms, max(b) AS last_ms FROM m GROUP BY 1"""
)
def screen_time(spark, sf_dir):
    """From documents of clusters, tracks and detections to every person's total: the whole chain."""
    merged = I.fixed_gap_merge(_raw(spark, sf_dir), ["person"], 400, tie="track_id")
    return I.totals(merged).select("person", "total_ms", "appearances", "first_ms", "last_ms")


@query(f"WITH {TRACK_DOCS} SELECT track_id, count FROM docs WHERE track_id NOT IN (SELECT track_id FROM mem WHERE cluster_id < 6)")
def unclustered_tracks(spark, sf_dir):
    held = cluster_docs(spark).filter("cluster_id < 6").select(F.explode("track_ids").alias("track_id"))
    return A.unclustered(track_docs(spark, sf_dir), held).select("track_id", "count")


@query(f"WITH {TRACK_DOCS} SELECT vec_id FROM det WHERE frame_id IN (SELECT frame_id FROM refs WHERE track_id = 3)")
def faces_in_frames_of(spark, sf_dir):
    return A.in_frames_of(detections(spark, sf_dir), references(spark, sf_dir).filter("track_id = 3")).select("vec_id")


CHOICE = f"{TRACK_METRICS}, w AS (SELECT track_id, track_id % 8 AS cluster_id, 'P' || (track_id % 8 % 5) AS person, p25 AS conf, conflict_frac, n_frames AS frames FROM tm)"


@query(f"{CHOICE} SELECT 'people' AS asked, track_id FROM w WHERE person IN ('P1', 'P2') UNION ALL SELECT 'all', track_id FROM w UNION ALL SELECT 'narrow', track_id FROM w WHERE cluster_id IN (0, 1, 2, 3) AND conf BETWEEN 0.1 AND 0.5 AND conflict_frac <= 0.95 AND frames >= 2")
def chosen_tracks(spark, sf_dir):
    c = F.col("track_id") % 8
    rows = _track_metrics(spark, sf_dir).select("track_id", c.alias("cluster_id"), F.format_string("P%d", c % 5).alias("person"), F.col("p25").alias("conf"), "conflict_frac", F.col("n_frames").alias("frames"))
    asked = {"people": A.chosen(rows, people=["P1", "P2"]), "all": A.chosen(rows), "narrow": A.chosen(rows, clusters=[0, 1, 2, 3], conf=(0.1, 0.5), conflict=0.95, frames=2)}
    out = [df.select(F.lit(name).alias("asked"), "track_id") for name, df in asked.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT min(source) FROM documents)")
def from_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return A.from_sources(docs, [docs.agg(F.min("source")).first()[0]])


@query(f"WITH {TRACK_DOCS} SELECT frame_id, ts_ms FROM manifest WHERE sampled AND ts_ms BETWEEN 400 AND 4000")
def sampled_between(spark, sf_dir):
    return A.sampled_between(manifest(spark, sf_dir), 400, 4000).select("frame_id", "ts_ms")


@query(
    f"""WITH {DETECTIONS} SELECT vec_id, least(x2 - x1, y2 - y1) >= 90 AND conf >= 0.6 AS detector, least(x2 - x1, y2 - y1) >= 72 AND conf >= 0.54 AS entrance,
 (SELECT CASE WHEN i > 0 THEN i / ((x2 - x1) * (y2 - y1) + 40000 - i) ELSE 0 END FROM (SELECT greatest(least(x2, 300) - greatest(x1, 100), 0) * greatest(least(y2, 300) - greatest(y1, 100), 0) AS i)) >= 0.1 AS region FROM det"""
)
def detection_gates(spark, sf_dir):
    region = [F.lit(100), F.lit(100), F.lit(300), F.lit(300)]
    return detections(spark, sf_dir).select("vec_id", A.detector_gate(90, 0.6).alias("detector"), A.entrance_gate(90, 0.6).alias("entrance"), A.in_region(region).alias("region"))


@query(f"WITH {DETECTIONS}, m AS (SELECT *, conf >= 0.99 AS p, max(conf >= 0.99) OVER (PARTITION BY track_id) AS any_ FROM det) SELECT track_id, vec_id FROM m WHERE p OR NOT any_")
def passing_or_all(spark, sf_dir):
    return A.passing_or_all(detections(spark, sf_dir), ["track_id"], F.col("conf") >= 0.99).select("track_id", "vec_id")


CURATED = f"""WITH {DETECTIONS}, spread AS (SELECT identity, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM det), raw AS (SELECT identity, list(m ORDER BY i) AS v FROM (SELECT identity, i, avg(x) AS m FROM spread GROUP BY 1, 2) GROUP BY 1),
 s AS (SELECT d.identity, vec_id, conf AS quality, list_dot_product({UNIT.format(v='embedding')}, {UNIT.format(v='v')}) AS sim FROM det d JOIN raw USING (identity) WHERE conf >= 0.5),
 z AS (SELECT *, CASE WHEN stddev_pop(sim) OVER w = 0 THEN 0 ELSE (sim - avg(sim) OVER w) / (stddev_pop(sim) OVER w + 1e-6) END AS z FROM s WINDOW w AS (PARTITION BY identity))"""


@query(f"{CURATED} SELECT identity, vec_id, round(z, 6) AS z, row_number() OVER (PARTITION BY identity ORDER BY quality DESC, vec_id) AS nth FROM z WHERE abs(z) <= 1.5 QUALIFY nth <= 20")
def curated_bank(spark, sf_dir):
    rows = detections(spark, sf_dir)
    centred = rows.join(V.centroid(rows, ["identity"]).select("identity", "centroid"), "identity").select("identity", "vec_id", F.col("conf").alias("quality"), V.dot(V.l2_normalise("embedding"), "centroid").alias("sim"))
    return A.curated(centred, ["identity"], 0.5, 1.5, 20).select("identity", "vec_id", F.round("z", 6).alias("z"), F.col("nth").cast("bigint").alias("nth"))


@query(f"WITH {BANK}, b AS (SELECT identity, count(*) AS prototypes, 0.5::DOUBLE AS p25 FROM bank GROUP BY 1), m AS (SELECT identity, avg(bin_key) AS p25, max(proto_id) AS newest FROM bank WHERE proto_id % 20 = 0 GROUP BY 1) SELECT identity, prototypes, coalesce(m.p25, b.p25) AS p25, newest FROM b LEFT JOIN m USING (identity)")
def bank_overlay(spark, sf_dir):
    rows = bank(spark, sf_dir)
    own = rows.groupBy("identity").agg(F.count("*").alias("prototypes"), F.lit(0.5).alias("p25"))
    metrics = rows.filter("proto_id % 20 = 0").groupBy("identity").agg(F.avg("bin_key").alias("p25"), F.max("proto_id").alias("newest"))
    return A.overlaid(own, metrics, "identity")


@query(f"WITH {DETECTIONS}, g AS (SELECT track_id, list(vec_id ORDER BY vec_id) AS v, count(*) AS n FROM det GROUP BY 1) SELECT track_id, CASE WHEN n <= 5 THEN v ELSE list_transform(range(0, 5), lambda i: v[1 + i * (n - 1) // 4]) END AS sampled FROM g")
def even_samples(spark, sf_dir):
    rows = detections(spark, sf_dir).groupBy("track_id").agg(F.sort_array(F.collect_list("vec_id")).alias("v"))
    return rows.select("track_id", A.evenly(F.col("v"), 5).alias("sampled"))


@query(f"WITH {TRACKS} SELECT track_id, coalesce(CASE WHEN cluster_id % 3 = 0 THEN 'M' || cluster_id END, CASE WHEN track_id % 2 = 0 THEN person END, 'given') AS who FROM tracks")
def resolved_identities(spark, sf_dir):
    rows = tracks(spark, sf_dir).select("track_id", "cluster_id", F.when(F.col("track_id") % 2 == 0, F.col("person")).alias("person_name"), F.lit("given").alias("identity"))
    mapped = rows.select("cluster_id").distinct().filter("cluster_id % 3 = 0").select("cluster_id", F.format_string("M%d", F.col("cluster_id")).alias("mapped"))
    return A.with_identity(rows, mapped).select("track_id", "who")


INTEGRATED = f"""WITH {TRACKS}, let AS (SELECT 'P' || i AS person, 1000 * i AS start_ms, 1000 * i + 400 AS end_ms FROM range(0, 9) t(i)), f AS (SELECT person, min(cluster_id) AS cluster_id FROM tracks GROUP BY 1),
 new AS (SELECT (SELECT max(track_id) FROM tracks) + row_number() OVER (ORDER BY start_ms, end_ms, person) AS track_id, cluster_id, start_ms, end_ms FROM let JOIN f USING (person))"""


@query(f"{INTEGRATED} SELECT 'track' AS kind, track_id, start_ms AS value FROM tracks UNION ALL SELECT 'track', track_id, start_ms FROM new UNION ALL SELECT 'member', track_id, cluster_id FROM tracks UNION ALL SELECT 'member', track_id, cluster_id FROM new")
def integrated_tracklets(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    lets = spark.range(9).select(F.format_string("P%d", F.col("id")).alias("person"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 400).alias("end_ms"))
    all_tracks, members = A.integrated(rows.select("track_id", "start_ms", "end_ms", "conf"), rows.select("cluster_id", "track_id"), lets, rows.select("person", "cluster_id"))
    return all_tracks.select(F.lit("track").alias("kind"), "track_id", F.col("start_ms").alias("value")).unionByName(members.select(F.lit("member").alias("kind"), "track_id", F.col("cluster_id").alias("value")))


@query(f"WITH {TRACK_DOCS}, s AS (SELECT r.track_id, min(d.frame_id) * 40 AS a, max(d.frame_id) * 40 AS b, count(*) AS n, avg(d.conf) AS c FROM refs r JOIN det d USING (frame_id, det_idx) WHERE d.conf >= 0.6 GROUP BY 1) SELECT t.track_id, coalesce(a, start_ms) AS start_ms, coalesce(b, end_ms) AS end_ms, coalesce(n, count) AS count, round(coalesce(c, mean_confidence), 9) AS mean_confidence FROM docs t LEFT JOIN s USING (track_id)")
def mended_tracks(spark, sf_dir):
    found = detections(spark, sf_dir).filter("conf >= 0.6").withColumn("ts_ms", F.col("frame_id") * 40)
    return A.mended(track_docs(spark, sf_dir), references(spark, sf_dir), found).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query(f"WITH {TRACKS} SELECT a.track_id, b.track_id AS next_id, b.start_ms - a.end_ms AS gap FROM tracks a JOIN tracks b ON b.start_ms - a.end_ms BETWEEN 0 AND 100 AND a.track_id <> b.track_id")
def adjacent_tracks(spark, sf_dir):
    rows = tracks(spark, sf_dir).select("track_id", "start_ms", "end_ms")
    return I.adjacent(rows, rows, 100)


@query(
    f"""WITH {DETECTIONS}, r AS (SELECT track_id, embedding, row_number() OVER (PARTITION BY track_id ORDER BY conf * sqrt((x2 - x1) * (y2 - y1)) DESC, vec_id) AS k FROM det), s AS (SELECT track_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM r WHERE k <= 3),
 v AS (SELECT track_id, list(m ORDER BY i) AS v FROM (SELECT track_id, i, avg(x) AS m FROM s GROUP BY 1, 2) GROUP BY 1) SELECT track_id, list_transform({UNIT.format(v='v')}, lambda x: round_even(x, 6)) AS prototype FROM v"""
)
def track_prototypes(spark, sf_dir):
    return V.prototypes(detections(spark, sf_dir), ["track_id"], 3).select("track_id", F.transform("prototype", lambda x: F.bround(x, 6)).alias("prototype"))


@query(f"WITH {DETECTIONS} SELECT identity, bin_key, vec_id FROM (SELECT *, CASE WHEN greatest(x2 - x1, y2 - y1) < 100 THEN 'small' ELSE 'large' END AS bin_key FROM det) QUALIFY row_number() OVER (PARTITION BY identity, bin_key ORDER BY conf DESC, vec_id) <= 4")
def bank_bins(spark, sf_dir):
    rows = detections(spark, sf_dir).withColumn("bin_key", F.when(A.longer_side() < 100, "small").otherwise("large"))
    return V.top_k(rows, ["identity", "bin_key"], 4, F.desc("conf"), F.col("vec_id")).select("identity", "bin_key", "vec_id")


SETS = f"{DETECTIONS}, u AS (SELECT track_id, vec_id, {UNIT.format(v='embedding')} AS u FROM det)"


@query(
    f"""WITH {SETS}, p AS (SELECT a.track_id AS track_id, b.track_id AS other, list_dot_product(a.u, b.u) AS s, row_number() OVER (PARTITION BY a.track_id, b.track_id ORDER BY list_dot_product(a.u, b.u) DESC) AS k FROM u a JOIN u b ON b.track_id = (a.track_id + 1) % 40),
 m AS (SELECT track_id, other, avg(s) AS sim FROM p WHERE k <= 5 GROUP BY 1, 2) SELECT track_id, other, round(sim, 6) AS sim FROM m"""
)
def set_similarities(spark, sf_dir):
    rows = detections(spark, sf_dir).select("track_id", "vec_id", V.l2_normalise("embedding").alias("u"))
    wanted = spark.range(40).select(F.col("id").alias("track_id"), ((F.col("id") + 1) % 40).alias("other"))
    return V.set_similarity(rows, wanted, 5).withColumn("sim", F.round("sim", 6))


@query(
    f"""WITH {DETECTIONS}, e AS (SELECT DISTINCT frame_id // 25 AS episode_id, frame_id, track_id FROM det), fr AS (SELECT episode_id, frame_id, lead(frame_id) OVER (PARTITION BY episode_id ORDER BY frame_id) AS nx FROM (SELECT DISTINCT episode_id, frame_id FROM e))
 SELECT e.episode_id, e.frame_id, e.track_id FROM e JOIN fr USING (episode_id, frame_id) WHERE nx IS NULL OR NOT EXISTS (SELECT 1 FROM e n WHERE n.episode_id = e.episode_id AND n.frame_id = nx AND n.track_id = e.track_id)"""
)
def ended_tracks(spark, sf_dir):
    rows = detections(spark, sf_dir).withColumn("episode_id", F.floor(F.col("frame_id") / 25).cast("bigint"))
    return T.ended(rows, ["episode_id"])
