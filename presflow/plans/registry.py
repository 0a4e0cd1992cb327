"""Queries over an episode registry made of orders (episodes) and lineitem (their files)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as R
from .registering import registry

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)


EPISODES = "ep AS (SELECT o_orderkey AS episode_id, 'S' || (o_custkey % 5) AS show_id, o_orderkey % 4 AS season, o_orderkey % 7 = 0 AS archived FROM orders)"
FILES = "f AS (SELECT l_orderkey AS episode_id, md5(l_linenumber || '') AS name, l_partkey AS size, l_suppkey AS changed FROM lineitem)"


def episodes(spark, sf_dir):
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("episode_id"), F.format_string("S%d", F.col("o_custkey") % 5).alias("show_id"), (k % 4).alias("season"), (k % 7 == 0).alias("archived"))


def files(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("episode_id"), F.md5(F.col("l_linenumber").cast("string")).alias("name"), F.col("l_partkey").alias("size"), F.col("l_suppkey").alias("changed"))


@query(f"WITH {EPISODES} SELECT episode_id, show_id, season, archived FROM ep WHERE show_id = 'S2' AND season = 1 AND NOT archived")
def list_episodes(spark, sf_dir):
    return R.listed(episodes(spark, sf_dir), "S2", 1)


@query(f"WITH {EPISODES} SELECT episode_id, CASE WHEN episode_id = 12 THEN 'S9' ELSE show_id END AS show_id, CASE WHEN episode_id = 12 THEN 3 ELSE season END AS season, archived FROM ep")
def move_episode(spark, sf_dir):
    return R.moved(episodes(spark, sf_dir), 12, "S9", 3)


@query(f"WITH {EPISODES}, x AS (SELECT *, archived OR episode_id % 11 = 3 AS a FROM ep) SELECT show_id, season, count(*) AS episodes, count(*) FILTER (CASE WHEN episode_id % 13 = 0 THEN false ELSE a END) AS archived FROM x GROUP BY 1, 2")
def archive_and_restore(spark, sf_dir):
    rows = episodes(spark, sf_dir)
    gone = R.archive(rows, rows.filter("episode_id % 11 = 3"))
    return R.summary(R.archive(gone, rows.filter("episode_id % 13 = 0"), False))


@query(f"WITH {FILES} SELECT episode_id, substr(md5(string_agg(name || '::' || size || '::' || changed, '::' ORDER BY name || '::' || size || '::' || changed)), 1, 12) AS hash FROM f GROUP BY episode_id")
def episode_hashes(spark, sf_dir):
    return R.content_hash(files(spark, sf_dir))


@query(f"WITH {EPISODES} SELECT * FROM (SELECT * FROM ep WHERE episode_id % 50 <> 0 UNION ALL SELECT episode_id, 'S7', season, true FROM ep WHERE episode_id % 50 = 0) WHERE show_id <> 'S3'")
def edit_registry(spark, sf_dir):
    rows = episodes(spark, sf_dir)
    changed = rows.filter("episode_id % 50 = 0").withColumn("show_id", F.lit("S7")).withColumn("archived", F.lit(True))
    return R.removed(R.put(rows, changed, ["episode_id"]), spark.createDataFrame([("S3",)], "show_id string"))


@query(f"WITH {EPISODES}, r AS (SELECT episode_id, min(CASE WHEN episode_id % 2 = 0 THEN 'track' ELSE 'cluster' END) AS step FROM ep WHERE episode_id % 9 = 4 GROUP BY 1) SELECT episode_id, 'analyze' AS action, step IS NULL AS allowed, 'running ' || step AS why FROM ep LEFT JOIN r USING (episode_id)")
def allowed_actions(spark, sf_dir):
    rows = episodes(spark, sf_dir)
    running = rows.filter("episode_id % 9 = 4").select("episode_id", F.when(F.col("episode_id") % 2 == 0, "track").otherwise("cluster").alias("step"))
    return R.allowed(rows.select("episode_id", F.lit("analyze").alias("action")), running)


@query(
    """WITH f AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' WHEN 2 THEN '.txt' ELSE '' END AS name, p_size * 100 AS size FROM part), k AS (SELECT *, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) AS kind FROM f)
 SELECT p_partkey, list_filter([CASE WHEN kind NOT IN ('mp4', 'mov', 'avi', 'mkv') THEN 'kind' END, CASE WHEN size < 500 THEN 'too_small' END, CASE WHEN size > 4000 THEN 'too_large' END], lambda x: x IS NOT NULL) AS errors FROM k"""
)
def file_errors(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(k == 0, ".mp4").when(k == 1, ".MOV").when(k == 2, ".txt").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", R.file_errors(name, F.col("p_size") * 100, R.VIDEO_KINDS, 500, 4000).alias("errors"))


@query(f"WITH {EPISODES}, {FILES}, h AS (SELECT episode_id, substr(md5(string_agg(name || '::' || size || '::' || changed, '::' ORDER BY name || '::' || size || '::' || changed)), 1, 12) AS hash FROM f GROUP BY episode_id) SELECT episode_id, CASE WHEN hash IS NULL THEN 'missing' ELSE 'changed' END AS state FROM ep LEFT JOIN h USING (episode_id) WHERE hash IS NULL OR episode_id % 3 = 0")
def stale_episodes(spark, sf_dir):
    now = R.content_hash(files(spark, sf_dir))
    stored = episodes(spark, sf_dir).join(now, "episode_id", "left").withColumn("hash", F.when(F.col("episode_id") % 3 == 0, "old").otherwise(F.col("hash")))
    return R.stale(stored, now)


@query(f"WITH {EPISODES}, {FILES} SELECT episode_id, name FROM f WHERE episode_id NOT IN (SELECT episode_id FROM ep WHERE NOT archived)")
def purged_files(spark, sf_dir):
    return R.purged(files(spark, sf_dir), episodes(spark, sf_dir)).select("episode_id", "name")
