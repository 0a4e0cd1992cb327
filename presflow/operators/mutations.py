"""Changes to cluster membership, as new tables: rows (cluster_id, track_id, name, confidence, quality), one a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLUMNS = ["cluster_id", "track_id", "name", "confidence", "quality"]


def _set(members: DataFrame, **values: Column) -> DataFrame:
    return members.select(*[values[c].cast(t).alias(c) if c in values else F.col(c) for c, t in members.dtypes])


def _with_top(members: DataFrame) -> DataFrame:
    """``top``: the largest cluster id, one number for all rows."""
    return members.join(F.broadcast(members.agg(F.coalesce(F.max("cluster_id"), F.lit(-1)).alias("top"))))


def merge(members: DataFrame, a: int, b: int, name: str | None = None) -> DataFrame:
    """Cluster b's tracks join a, which keeps its id, takes the given name (or none) and the size-weighted quality."""
    both = F.col("cluster_id").isin(a, b)
    mean = members.filter(both).agg(F.avg("quality").alias("mean"))
    return _set(
        members.join(F.broadcast(mean)), cluster_id=F.when(both, a).otherwise(F.col("cluster_id")), name=F.when(both, F.lit(name)).otherwise(F.col("name")),
        confidence=F.when(both, F.lit(1.0 if name else None)).otherwise(F.col("confidence")), quality=F.when(both, F.col("mean")).otherwise(F.col("quality")),
    ).select(COLUMNS)


def split(members: DataFrame, cluster: int, tracks: list[int]) -> DataFrame:
    """The named tracks get the next free id, the rest of the cluster the one after; both keep its figures and lose its name."""
    here = F.col("cluster_id") == cluster
    new = F.when(F.col("track_id").isin(tracks), F.col("top") + 1).otherwise(F.col("top") + 2)
    none = lambda c: F.when(here, F.lit(None)).otherwise(F.col(c))
    return _set(_with_top(members), cluster_id=F.when(here, new).otherwise(F.col("cluster_id")), name=none("name"), confidence=none("confidence")).select(COLUMNS)


def assign_name(members: DataFrame, cluster: int, name: str) -> DataFrame:
    """Names a cluster and locks it (confidence 1)."""
    here = F.col("cluster_id") == cluster
    return _set(members, name=F.when(here, name).otherwise(F.col("name")), confidence=F.when(here, 1.0).otherwise(F.col("confidence"))).select(COLUMNS)


def move(members: DataFrame, tracks: list[int], to: int) -> DataFrame:
    """Tracks move to a cluster and take its name; -1 is a new one of quality 0.5.  A source left empty is gone with its rows.
    To a cluster that does not exist nothing moves."""
    here = F.col("track_id").isin(tracks)
    if to == -1:
        new = {"cluster_id": F.col("top") + 1, "name": F.lit(None), "confidence": F.lit(None), "quality": F.lit(0.5)}
        return _set(_with_top(members), **{c: F.when(here, v).otherwise(F.col(c)) for c, v in new.items()}).select(COLUMNS)
    target = members.filter(F.col("cluster_id") == to).limit(1).select(*[F.col(c).alias(f"_{c}") for c in COLUMNS if c != "track_id"])
    joined = members.join(F.broadcast(target), F.lit(True), "left")  # no row moves if there is no such cluster
    here = here & F.col("_cluster_id").isNotNull()
    return _set(joined, **{c: F.when(here, F.col(f"_{c}")).otherwise(F.col(c)) for c in COLUMNS if c != "track_id"}).select(COLUMNS)


def delete_tracks(members: DataFrame, tracks: list[int]) -> DataFrame:
    return members.filter(~F.col("track_id").isin(tracks)).select(COLUMNS)


def suppress(members: DataFrame, clusters: DataFrame, tracks: DataFrame) -> DataFrame:
    """Without deleted clusters (cluster_id) and deleted tracks (track_id)."""
    return members.join(clusters, "cluster_id", "left_anti").join(tracks, "track_id", "left_anti").select(COLUMNS)


def assign_tracks(members: DataFrame, tracks: list[int], name: str) -> DataFrame:
    """Tracks go to the first cluster of that name, or to a new locked one; tracks that no cluster holds are added."""
    spark = members.sparkSession
    asked = spark.createDataFrame([(t,) for t in tracks], "track_id bigint")
    first = members.agg(F.min(F.when(F.col("name") == name, F.col("cluster_id"))).alias("found"), F.coalesce(F.max("cluster_id"), F.lit(-1)).alias("top"))
    target = first.select(F.coalesce("found", F.col("top") + 1).cast("bigint").alias("cluster_id"))
    quality = members.filter(F.col("name") == name).agg(F.coalesce(F.min_by("quality", "cluster_id"), F.lit(0.5)).alias("quality"))
    new = asked.join(F.broadcast(target)).join(F.broadcast(quality)).select("cluster_id", "track_id", F.lit(name).alias("name"), F.lit(1.0).alias("confidence"), "quality")
    return members.join(asked, "track_id", "left_anti").select(COLUMNS).unionByName(new)


def visible(members: DataFrame, clusters: DataFrame, tracks: DataFrame) -> DataFrame:
    """Clusters with what is left of them: cluster_id, name, track_ids and size; emptied ones are not there."""
    left = suppress(members, clusters, tracks).groupBy("cluster_id", "name").agg(F.sort_array(F.collect_list("track_id")).alias("track_ids"))
    return left.withColumn("size", F.size("track_ids"))


def by_identity(members: DataFrame) -> DataFrame:
    """One row a name (Unknown for none): tracks, smallest cluster, mean quality over clusters, whether all are locked; nth puts Unknown last."""
    clusters = members.groupBy("cluster_id", F.coalesce("name", F.lit("Unknown")).alias("name")).agg(F.collect_list("track_id").alias("t"), F.avg("quality").alias("quality"), F.coalesce(F.bool_and(F.col("confidence") == 1.0), F.lit(False)).alias("locked"))
    return clusters.groupBy("name").agg(
        F.min("cluster_id").alias("cluster_id"), F.sort_array(F.flatten(F.collect_list("t"))).alias("track_ids"), F.bround(F.avg("quality"), 6).alias("quality"), F.bool_and("locked").alias("all_locked"), F.count("*").alias("clusters"), F.max(F.col("name") == "Unknown").alias("unknown")
    )


REFS = ["track_id", "frame_id", "det_idx", "conf"]


def delete_frame(refs: DataFrame, track: int, frame: int) -> DataFrame:
    """Frame references (track_id, frame_id, ...) without one frame of a track; the track's start and end stay."""
    return refs.filter(~((F.col("track_id") == track) & (F.col("frame_id") == frame)))


def _above(df: DataFrame, column: str, name: str = "_top") -> DataFrame:
    """One row: the largest number in use."""
    return df.agg(F.coalesce(F.max(column), F.lit(-1)).alias(name))


def move_frame(members: DataFrame, tracks: DataFrame, refs: DataFrame, track: int, frame: int, to: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A frame of a track becomes a track of its own in another cluster: it has the next free id and the source's start and end.

    A source left without frames goes, from the tracks and from its cluster.  Returns members, tracks and refs; without such a frame or
    such a cluster they are as before.
    """
    here = (F.col("track_id") == track) & (F.col("frame_id") == frame)
    target = members.filter(F.col("cluster_id") == to).limit(1)
    moves = refs.filter(here).limit(1).crossJoin(target.select(F.col("cluster_id").alias("_to"))).select(F.lit(True).alias("_moves"))  # one row or none
    new_id = tracks.join(F.broadcast(_above(tracks, "track_id"))).select((F.col("_top") + 1).alias("_new")).limit(1).crossJoin(F.broadcast(moves))
    moved = refs.join(F.broadcast(new_id), F.lit(True), "left")
    out_refs = moved.withColumn("track_id", F.when(here & F.col("_moves"), F.col("_new")).otherwise(F.col("track_id"))).select(refs.columns)
    source = tracks.filter(F.col("track_id") == track).crossJoin(F.broadcast(new_id)).withColumn("track_id", F.col("_new")).select(tracks.columns)
    left = out_refs.filter(F.col("track_id") == track).limit(1).select(F.lit(True).alias("_left"))
    gone = lambda df: df.join(F.broadcast(left), F.lit(True), "left").join(F.broadcast(moves), F.lit(True), "left").filter((F.col("track_id") != track) | F.col("_left") | F.col("_moves").isNull()).select(df.columns)
    joins = target.crossJoin(F.broadcast(new_id)).withColumn("track_id", F.col("_new")).select(members.columns)
    return gone(members).unionByName(joins), gone(tracks).unionByName(source), out_refs


def split_frames(members: DataFrame, tracks: DataFrame, refs: DataFrame, track: int, frames: list[int], name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames of a track (refs with ts_ms) become a track of their own that is given to an identity, as ``assign_tracks`` does.

    Start and end of the new track are those of its frames.  A source left without frames goes.
    """
    here = (F.col("track_id") == track) & F.col("frame_id").isin(frames)
    new_id = _above(tracks, "track_id").select((F.col("_top") + 1).alias("_new"))
    out_refs = refs.crossJoin(F.broadcast(new_id)).withColumn("track_id", F.when(here, F.col("_new")).otherwise(F.col("track_id"))).select(refs.columns)
    made = refs.filter(here).crossJoin(F.broadcast(new_id)).groupBy(F.col("_new").alias("track_id")).agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("count"))
    counts = out_refs.filter(F.col("track_id") == track).agg(F.count("*").alias("_left"))
    kept = tracks.crossJoin(F.broadcast(counts)).filter((F.col("track_id") != track) | (F.col("_left") > 0))
    kept = kept.withColumn("count", F.when(F.col("track_id") == track, F.col("_left")).otherwise(F.col("count"))).select(tracks.columns)
    still = members.join(kept.select("track_id"), "track_id", "left_semi").select(COLUMNS)
    first = members.filter(F.col("name") == name).agg(F.min(F.struct("cluster_id", "quality")).alias("f"))
    top = _above(members, "cluster_id").crossJoin(first).select(F.coalesce("f.cluster_id", F.col("_top") + 1).alias("cluster_id"), F.coalesce("f.quality", F.lit(0.5)).alias("quality"))
    joins = made.select("track_id").crossJoin(F.broadcast(top)).select("cluster_id", "track_id", F.lit(name).alias("name"), F.lit(1.0).alias("confidence"), "quality")
    return still.unionByName(joins), kept.unionByName(made, allowMissingColumns=True).select(tracks.columns), out_refs


def logged(log: DataFrame, actions: DataFrame, at: Column) -> DataFrame:
    """The log (seq, at, action, target, done) with actions (action, target, done) behind it, numbered on in their own order (``nth``)."""
    new = actions.crossJoin(F.broadcast(_above(log, "seq"))).select((F.col("_top") + 1 + F.col("nth")).alias("seq"), at.alias("at"), "action", "target", "done")
    return log.unionByName(new)


def standing(log: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The actions of a log that stand after its undos, each of which takes back the last action that still stands (or nothing)."""
    w = Window.partitionBy(*keys).orderBy(order)
    steps = log.withColumn("_sum", F.sum(F.when(F.col("action") == "undo", -1).otherwise(1)).over(w))
    steps = steps.withColumn("_level", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w)))
    after = F.min("_level").over(Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1))
    return steps.withColumn("_after", after).filter((F.col("action") != "undo") & (F.coalesce("_after", "_level") >= F.col("_level"))).select(log.columns)


def undoable(log: DataFrame, keys: list[str], depth: int = 10, order: str = "seq") -> DataFrame:
    """What could be taken back next: the newest ``depth`` standing actions, with ``nth`` from 1."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return standing(log, keys, order).withColumn("nth", newest).filter(F.col("nth") <= depth)


def freshness(episodes: DataFrame, marks: DataFrame) -> DataFrame:
    """episode_id, is_dirty, reason and is_fresh of episodes (episode_id, clusters_at, totals_at): dirty while there is a mark
    (episode_id, reason); fresh if not dirty and its totals are newer than its clusters."""
    flag = marks.groupBy("episode_id").agg(F.max("reason").alias("reason")).withColumn("is_dirty", F.lit(True))
    rows = episodes.join(flag, "episode_id", "left").withColumn("is_dirty", F.coalesce("is_dirty", F.lit(False)))
    newer = F.coalesce(F.col("totals_at") > F.col("clusters_at"), F.lit(False))
    return rows.select("episode_id", "is_dirty", F.coalesce("reason", F.lit("")).alias("reason"), (~F.col("is_dirty") & newer).alias("is_fresh"))
