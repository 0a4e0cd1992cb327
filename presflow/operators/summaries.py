"""Figures of an episode: counts of steps, clusters and tracks, histograms, estimates, and quality of faces and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def plain_clusters(members: DataFrame, metrics: DataFrame) -> DataFrame:
    """Figures of clusters where confidence was not rolled up: tracks, median and least p25 of tracks that have one (else zero), no
    contamination, and the quality in place of the likeness of centroids."""
    rows = members.join(metrics.select("track_id", "p25"), "track_id", "left").groupBy("cluster_id", F.coalesce("name", F.lit("Unknown")).alias("name"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.agg(F.count("*").alias("tracks"), zero(F.percentile("p25", F.lit(0.5))).alias("p25_median"), zero(F.min("p25")).alias("p25_min"), F.lit(0.0).alias("contam"), zero(F.max("quality")).alias("pairwise_sim"))


def plain_persons(members: DataFrame, metrics: DataFrame) -> DataFrame:
    """The same for named persons: clusters, tracks that have figures, and the median of their p25."""
    named = members.filter("name is not null and name <> 'Unknown'").join(metrics.select("track_id", "p25"), "track_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return named.groupBy(F.col("name").alias("person")).agg(F.countDistinct("cluster_id").alias("n_clusters"), F.count("p25").alias("n_tracks"), zero(F.percentile("p25", F.lit(0.5))).alias("p25_median"), F.lit(0.0).alias("contam"), F.lit(0.0).alias("margin"))


def flat_tracks(members: DataFrame, metrics: DataFrame, tracks: DataFrame) -> DataFrame:
    """Figures of each track beside its cluster, its person and its start and end (null if there is no such track)."""
    rows = members.select("cluster_id", "track_id", F.coalesce("name", F.lit("Unknown")).alias("person")).join(metrics, "track_id")
    return rows.join(tracks.select("track_id", "start_ms", "end_ms"), "track_id", "left")


def workspace_counts(members: DataFrame, low: float = 0.6) -> DataFrame:
    """One row of counts of members (cluster_id, track_id, person, dirty, confidence): clusters, those with and without a person, dirty
    ones, those whose tracks' mean confidence is under ``low``, and tracks.

    Confidences are added up in order of tracks, so a mean that is ``low`` but for its last digit comes out alike however rows are dealt."""
    upto = Window.partitionBy("cluster_id").orderBy("track_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = members.withColumn("_mean", F.avg(F.coalesce("confidence", F.lit(0.0))).over(upto))
    clusters = running.groupBy("cluster_id").agg(F.max("person").alias("person"), F.max("dirty").alias("dirty"), F.count("*").alias("n"), F.max_by("_mean", "track_id").alias("mean"))
    given = F.col("person").isNotNull() & ~F.col("person").isin("", "unassigned")
    return clusters.agg(
        F.count("*").alias("clusters"), F.count_if(given).alias("assigned"), F.count_if(~given).alias("unassigned"), F.count_if(F.col("mean") < low).alias("low_confidence"), F.count_if("dirty").alias("dirty"), F.coalesce(F.sum("n"), F.lit(0)).alias("tracks")
    )


def episode_summary(stats: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """A row an episode of step figures (episode_id, step, name, value): a struct a step, zero for what was not told."""
    of = lambda step, name: F.coalesce(F.max(F.when((F.col("step") == step) & (F.col("name") == name), F.col("value"))), F.lit(0).cast("bigint")).alias(name)
    return stats.groupBy("episode_id").agg(*[F.struct(*[of(step, name) for name in names]).alias(step) for step, names in wanted.items()])


def status_counts(tracks: DataFrame, members: DataFrame, deleted_tracks: DataFrame, deleted_clusters: DataFrame) -> DataFrame:
    """One row: tracks, clusters and named clusters that are left after deletions, and what was deleted."""
    left = members.join(deleted_clusters, "cluster_id", "left_anti").join(deleted_tracks, "track_id", "left_anti")
    counts = left.agg(F.countDistinct("cluster_id").alias("clusters"), F.countDistinct(F.when(F.col("name").isNotNull(), F.col("cluster_id"))).alias("named_clusters"), F.countDistinct("name").alias("persons"))
    seen = tracks.join(deleted_tracks, "track_id", "left_anti").agg(F.count("*").alias("tracks"))
    gone = deleted_tracks.agg(F.countDistinct("track_id").alias("deleted_tracks")).crossJoin(deleted_clusters.agg(F.countDistinct("cluster_id").alias("deleted_clusters")))
    return counts.crossJoin(seen).crossJoin(gone)  # one row each


def range_histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts of equal bins between the least and the largest value, the last closed on the right (one of width one if they are equal)."""
    ends = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    placed = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))
    low = F.when(F.col("_low") == F.col("_high"), F.col("_low") - 0.5).otherwise(F.col("_low"))
    width = F.when(F.col("_low") == F.col("_high"), F.lit(1.0)).otherwise(F.col("_high") - F.col("_low")) / bins
    return placed.groupBy(F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("count"))


def embedding_stats(detections: DataFrame) -> DataFrame:
    """One row: faces, those with a vector, their share, and faces a frame that has any."""
    has = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    rows = detections.agg(F.count("*").alias("faces"), F.count_if(has).alias("embedded"), F.countDistinct("frame_id").alias("frames"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.select("faces", "embedded", ratio("embedded", "faces").alias("success"), ratio("faces", "frames").alias("per_frame"))


def eta(steps: DataFrame, elapsed: float = 0.0) -> DataFrame:
    """One row: seconds left of the remaining steps (ord, median, samples), the first of which runs since ``elapsed``, and how sure that is."""
    left = F.when(F.col("ord") == 0, F.greatest(F.lit(0.0), F.coalesce("median", F.lit(0.0)) - elapsed)).otherwise(F.coalesce("median", F.lit(0.0)))
    rows = steps.agg(F.coalesce(F.sum(left), F.lit(0.0)).alias("eta_seconds"), F.coalesce(F.min(F.coalesce("samples", F.lit(0))), F.lit(0)).alias("_n"))
    return rows.select("eta_seconds", F.when(F.col("_n") >= 3, "high").when(F.col("_n") >= 1, "low").otherwise("none").alias("confidence"))


def steadiness(vectors: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """n and quality 1 / (1 + 10 s) of each key's vectors, where s is the length of their deviations by dimension; 0 for a single one."""
    spread = vectors.select(*keys, F.posexplode(vector).alias("_at", "_x")).groupBy(*keys, "_at").agg(F.var_pop("_x").alias("_v"), F.count("*").alias("_n"))
    rows = spread.groupBy(*keys).agg(F.max("_n").alias("n"), F.sqrt(F.sum("_v")).alias("_s"))
    return rows.select(*keys, "n", F.when(F.col("n") < 2, 0.0).otherwise(1 / (1 + 10 * F.col("_s"))).alias("quality"))


def image_quality(sharpness: Column, brightness: Column, contrast: Column, coverage: Column) -> Column:
    """0 to 100: up to 40 for sharpness, 30 for middling brightness, 20 for contrast and 10 for the face's share of the image."""
    upto = lambda c, most: F.least(c / most, F.lit(1.0))
    return F.bround(upto(sharpness, 500.0) * 40 + (1 - F.abs(brightness - 127) / 127) * 30 + upto(contrast, 100.0) * 20 + upto(coverage, 100.0) * 10, 1)


def still_score(fiqa: Column, sharpness: Column, height: Column, weights: tuple[float, float, float]) -> Column:
    """Weighted sum of a face's quality, its sharpness (100 is enough) and its height (150 pixels are enough)."""
    return weights[0] * fiqa + weights[1] * F.least(sharpness / 100.0, F.lit(1.0)) + weights[2] * F.least(height / 150.0, F.lit(1.0))


def best_still(candidates: DataFrame, key: str, item: str, fiqa_min: float, sharp_min: float, weights: tuple[float, float, float]) -> DataFrame:
    """Of each key the candidate (fiqa, sharpness, height) of highest score among those that are good enough, or of all if none is."""
    from .assembly import passing_or_all
    from .vectors import top_k

    good = passing_or_all(candidates, [key], (F.col("fiqa") >= fiqa_min) & (F.col("sharpness") >= sharp_min))
    scored = good.withColumn("score", still_score(F.col("fiqa"), F.col("sharpness"), F.col("height"), weights))
    return top_k(scored, [key], 1, F.desc("score"), F.col(item)).drop("nth")


def yaw(left_x: Column, right_x: Column, nose_x: Column) -> Column:
    """Degrees by how far the nose stands from the middle of the eyes, a whole eye distance being 90."""
    width = F.abs(right_x - left_x)
    return F.when(width > 0, (nose_x - (left_x + right_x) / 2) / width * 90).otherwise(0.0)


def frontalness(left: tuple[Column, Column], right: tuple[Column, Column], nose: tuple[Column, Column]) -> Column:
    """The smaller over the larger distance of an eye to the nose; 1 without landmarks."""
    far = lambda eye: F.sqrt(F.pow(eye[0] - nose[0], F.lit(2)) + F.pow(eye[1] - nose[1], F.lit(2)))
    return F.coalesce(F.least(far(left), far(right)) / (F.greatest(far(left), far(right)) + 1e-6), F.lit(1.0))


def frame_flags(frames: DataFrame, keys: list[str], blur: float = 40.0, still: float = 3.5) -> DataFrame:
    """keys, frames, blurred and low_motion of spans of frames (sharpness, motion): by their medians."""
    rows = frames.groupBy(*keys).agg(F.count("*").alias("frames"), F.percentile("sharpness", F.lit(0.5)).alias("_s"), F.percentile("motion", F.lit(0.5)).alias("_m"))
    return rows.select(*keys, "frames", (F.col("_s") < blur).alias("blurred"), F.coalesce(F.col("_m") < still, F.lit(False)).alias("low_motion"))
