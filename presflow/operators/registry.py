"""Episodes of shows and seasons as a table: listing, moving, soft removal, hashes, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(episodes: DataFrame, show: str | None = None, season: int | None = None, archived: bool = False) -> DataFrame:
    """Episodes of a show and season (all if not given); archived ones only on request."""
    out = episodes if archived else episodes.filter(~F.col("archived"))
    if show is not None:
        out = out.filter(F.col("show_id") == show)
    return out if season is None else out.filter(F.col("season") == season)


def moved(episodes: DataFrame, episode_id: Column | int, show: str, season: int) -> DataFrame:
    here = F.col("episode_id") == episode_id
    return episodes.withColumn("show_id", F.when(here, show).otherwise(F.col("show_id"))).withColumn("season", F.when(here, season).otherwise(F.col("season")))


def archive(episodes: DataFrame, ids: DataFrame, flag: bool = True) -> DataFrame:
    """Soft removal (or, with ``flag`` false, restoring) of the episodes in ids (episode_id)."""
    hit = ids.select("episode_id").distinct().withColumn("_hit", F.lit(True))
    return episodes.join(hit, "episode_id", "left").withColumn("archived", F.when(F.col("_hit"), flag).otherwise(F.col("archived"))).drop("_hit").select(episodes.columns)


def content_hash(files: DataFrame) -> DataFrame:
    """episode_id and a short hash of its files (name, size, changed), whatever their order."""
    parts = F.sort_array(F.collect_list(F.concat_ws("::", F.col("name"), F.col("size").cast("string"), F.col("changed").cast("string"))))
    return files.groupBy("episode_id").agg(F.substring(F.md5(F.array_join(parts, "::")), 1, 12).alias("hash"))


def stale(episodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """Episodes whose stored hash is not that of their files now, or that have no files."""
    joined = episodes.join(hashes.withColumnRenamed("hash", "now"), "episode_id", "left")
    return joined.filter(F.col("now").isNull() | (F.col("hash") != F.col("now"))).select("episode_id", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("state"))


def summary(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("show_id", "season").agg(F.count("*").alias("episodes"), F.count_if("archived").alias("archived"))


def put(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with rows added, in place of those of the same key."""
    return table.join(rows, key, "left_anti").unionByName(rows, allowMissingColumns=True)


def removed(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without the rows of these keys."""
    return table.join(keys, keys.columns, "left_anti")


def cascade(shows: DataFrame, seasons: DataFrame, episodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shows, seasons and episodes without shows (show_id) and what belongs to them."""
    return tuple(removed(t, gone.select("show_id")) for t in (shows, seasons, episodes))


def allowed(actions: DataFrame, running: DataFrame) -> DataFrame:
    """actions (episode_id, action) with ``allowed`` and ``why``: nothing starts on an episode on which a step runs (episode_id, step)."""
    busy = running.groupBy("episode_id").agg(F.min("step").alias("_step"))
    rows = actions.join(busy, "episode_id", "left")
    return rows.select(*actions.columns, F.col("_step").isNull().alias("allowed"), F.when(F.col("_step").isNotNull(), F.concat(F.lit("running "), F.col("_step"))).alias("why"))


#: What a video or an image must be.
VIDEO_KINDS, IMAGE_KINDS = ("mp4", "mov", "avi", "mkv"), ("jpg", "jpeg", "png", "webp")


def file_errors(name: Column, size: Column, kinds: tuple[str, ...], least: int, most: int) -> Column:
    """Array of what is wrong with a file: its kind by its name, too small or too large."""
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.array_compact(F.array(F.when(~kind.isin(*kinds), "kind"), F.when(size < least, "too_small"), F.when(size > most, "too_large")))


def purged(files: DataFrame, episodes: DataFrame) -> DataFrame:
    """Files (episode_id, ...) of episodes that are archived or not in the registry: what may be deleted."""
    kept = episodes.filter(~F.col("archived")).select("episode_id")
    return files.join(kept, "episode_id", "left_anti")
