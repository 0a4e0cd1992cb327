"""From tracks, clusters and detections to the intervals of persons: the joins under every analysis, and the filters along the way.

Frame references are rows (track_id, ord, frame_id, det_idx, conf): ``references`` makes them of tracks that hold arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tracking import both_ways, stitch
from .vectors import box, iou, numbered, whole


def references(tracks: DataFrame) -> DataFrame:
    """A row for each frame reference of tracks (track_id, frame_refs)."""
    refs = tracks.select("track_id", F.posexplode("frame_refs").alias("ord", "r"))
    return refs.select("track_id", "ord", "r.frame_id", "r.det_idx", F.col("r.confidence").alias("conf"))


def of_tracks(detections: DataFrame, refs: DataFrame) -> DataFrame:
    """Detections that a track refers to, with track_id; one that several refer to belongs to the last.  Others are left out."""
    last = refs.groupBy("frame_id", "det_idx").agg(F.max("track_id").alias("track_id"))
    return detections.drop("track_id").join(last, ["frame_id", "det_idx"])


def looked_up(detections: DataFrame, refs: DataFrame, item: str) -> DataFrame:
    """For each reference the first detection (smallest ``item``) of its frame and index; references without one are left out."""
    first = detections.drop("track_id", "conf").withColumn("_n", F.row_number().over(Window.partitionBy("frame_id", "det_idx").orderBy(item))).filter("_n = 1").drop("_n")
    return refs.join(first, ["frame_id", "det_idx"])


def stamped(refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """References with ts_ms of the manifest (frame_id, ts_ms), which has every frame."""
    return refs.join(manifest.select("frame_id", "ts_ms"), "frame_id")


def persons(clusters: DataFrame, names: DataFrame) -> DataFrame:
    """cluster_id, track_id and person of clusters (cluster_id, track_ids) that have a name (cluster_id, person) other than SKIP."""
    named = names.filter("person is not null and person <> '' and person <> 'SKIP'")
    return clusters.select("cluster_id", F.explode("track_ids").alias("track_id")).join(named, "cluster_id")


def repaired(tracks: DataFrame, refs: DataFrame) -> DataFrame:
    """Tracks whose missing start or end is taken from their references' ts_ms; what still has none is left out.  ``rebuilt`` tells which."""
    seen = refs.groupBy("track_id").agg(F.min("ts_ms").alias("_first"), F.max("ts_ms").alias("_last"))
    whole = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    rows = tracks.join(seen, "track_id", "left").withColumn("rebuilt", ~whole)
    fixed = rows.withColumn("start_ms", F.when(whole, F.col("start_ms")).otherwise(F.col("_first"))).withColumn("end_ms", F.when(whole, F.col("end_ms")).otherwise(F.col("_last")))
    return fixed.filter("start_ms is not null").drop("_first", "_last")


def raw_intervals(members: DataFrame, tracks: DataFrame, refs: DataFrame, rules: DataFrame, visible_conf: float = 0.7) -> DataFrame:
    """Intervals (person, track_id, start_ms, end_ms, conf, frames, visible, rebuilt) of members (track_id, person).

    frames is the track's count, without one the number of references; visible the share of them with a confidence of at least the
    person's ``visible_conf``.  ``rules`` (person, freeze, min_frames, min_visible, visible_conf) may say how few frames and how small a
    share a person's intervals need; a frozen person's need nothing.  Nulls there stand for no rule.
    """
    known = members.join(rules, "person", "left").join(repaired(tracks, refs), "track_id")
    sure = F.count_if(F.col("r.conf") >= F.coalesce("k.visible_conf", F.lit(visible_conf)))
    seen = known.select("track_id", "visible_conf").distinct().alias("k").join(refs.alias("r"), F.col("k.track_id") == F.col("r.track_id"), "left")
    seen = seen.groupBy(F.col("k.track_id").alias("track_id"), F.col("k.visible_conf").alias("_rule")).agg(F.count("r.track_id").alias("refs"), sure.alias("sure"))
    rows = known.alias("k").join(seen.alias("s"), (F.col("k.track_id") == F.col("s.track_id")) & F.col("k.visible_conf").eqNullSafe(F.col("s._rule")))
    frames = F.when(F.coalesce("count", F.lit(0)) > 0, F.col("count")).otherwise(F.col("refs")).cast("bigint")
    out = rows.select("person", F.col("k.track_id").alias("track_id"), "start_ms", "end_ms", F.coalesce("mean_confidence", F.lit(0.0)).alias("conf"), frames.alias("frames"), "sure", "rebuilt", "freeze", "min_frames", "min_visible")
    out = out.withColumn("visible", F.when(F.col("frames") > 0, F.col("sure") / F.col("frames")).otherwise(0.0))
    enough = (F.col("frames") >= F.coalesce("min_frames", F.lit(0))) & (F.col("visible") >= F.coalesce("min_visible", F.lit(0.0)))
    return out.filter(F.coalesce("freeze", F.lit(False)) | enough).select("person", "track_id", "start_ms", "end_ms", "conf", "frames", "visible", "rebuilt")


def unclustered(tracks: DataFrame, members: DataFrame) -> DataFrame:
    """Tracks that no cluster holds."""
    return tracks.join(members, "track_id", "left_anti")


def in_frames_of(detections: DataFrame, refs: DataFrame) -> DataFrame:
    """Detections in any frame that is referred to, whichever of the frame's faces is meant."""
    return detections.join(refs, "frame_id", "left_semi")


def chosen(rows: DataFrame, people: list[str] = (), clusters: list[int] = (), conf: tuple[float, float] = (0.0, 1.0), conflict: float = 1.0, frames: int = 0) -> DataFrame:
    """Tracks by what the workspace asks for; an empty list, the whole range, a conflict of one or more and no frames ask for nothing."""
    if people:
        rows = rows.filter(F.col("person").isin(list(people)))
    if clusters:
        rows = rows.filter(F.col("cluster_id").isin(list(clusters)))
    if tuple(conf) != (0.0, 1.0):
        rows = rows.filter(F.col("conf").between(*conf))
    if conflict < 1.0:
        rows = rows.filter(F.col("conflict_frac") <= conflict)
    return rows.filter(F.col("frames") >= frames) if frames > 0 else rows


def from_sources(rows: DataFrame, sources: list[str]) -> DataFrame:
    """Rows of these sources; all if there is no such column."""
    return rows.filter(F.col("source").isin(sources)) if "source" in rows.columns else rows


def sampled_between(manifest: DataFrame, first: int, last: int) -> DataFrame:
    """Sampled frames from ``first`` to ``last``, both included."""
    return manifest.filter(F.col("sampled") & F.col("ts_ms").between(first, last))


def shorter_side() -> Column:
    """The size of a face as the detector takes it."""
    return F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))


def longer_side() -> Column:
    """The size of a face as the filters of samples take it."""
    return F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))


def detector_gate(size: int, conf: float) -> Column:
    return (shorter_side() >= size) & (F.col("conf") >= conf)


def entrance_gate(size: int, conf: float) -> Column:
    """What an entrance asks of a face: four fifths of the size and nine tenths of the confidence that are asked elsewhere."""
    return (shorter_side() >= 0.8 * size) & (F.col("conf") >= 0.9 * conf)


def in_region(region: list[Column], least: float = 0.1) -> Column:
    """Whether a face overlaps the region where it was expected."""
    return iou(box(), region) >= least


def passing_or_all(rows: DataFrame, keys: list[str], passes: Column) -> DataFrame:
    """Of each key the rows that pass; all of them if none does."""
    marked = rows.withColumn("_passes", passes).withColumn("_any", F.max("_passes").over(Window.partitionBy(*keys)))
    return marked.filter(F.col("_passes") | ~F.col("_any")).drop("_passes", "_any")


def curated(rows: DataFrame, keys: list[str], quality: float, sigmas: float = 2.5, most: int = 40, item: str = "vec_id") -> DataFrame:
    """Samples (similarity ``sim`` to their centre, quality) for a bank: good enough, not far from the mean similarity, and the best of them."""
    good = rows.filter(F.col("quality") >= quality)
    w = Window.partitionBy(*keys)
    spread = F.stddev_pop("sim").over(w)
    z = F.when(spread == 0, 0.0).otherwise((F.col("sim") - F.avg("sim").over(w)) / (spread + 1e-6))
    kept = good.withColumn("z", z).filter(F.abs("z") <= sigmas)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("quality"), item))
    return kept.withColumn("nth", best).filter(F.col("nth") <= most)


def overlaid(bank: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """The bank's rows with the metrics that there are in place of their own."""
    shared = [c for c in metrics.columns if c != key and c in bank.columns]
    more = [c for c in metrics.columns if c != key and c not in bank.columns]
    rows = bank.alias("b").join(metrics.alias("m"), key, "left")
    own = [F.coalesce(f"m.{c}", f"b.{c}").alias(c) if c in shared else F.col(f"b.{c}") for c in bank.columns if c != key]
    return rows.select(key, *own, *[F.col(f"m.{c}") for c in more])


def evenly(items: Column, n: int) -> Column:
    """``n`` items of an array at even distances, first and last included; all, if there are no more."""
    size = F.size(items)
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (size - 1) / max(1, n - 1)).cast("int"))
    return F.when(size <= n, items).otherwise(F.transform(places, lambda i: F.get(items, i)))


def with_identity(tracks: DataFrame, names: DataFrame) -> DataFrame:
    """Tracks (cluster_id, person_name, identity) with ``who``: by the map (cluster_id, mapped), else the person, else the identity."""
    return tracks.join(names, "cluster_id", "left").withColumn("who", F.coalesce("mapped", "person_name", "identity")).drop("mapped")


def appended(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Both; what one side lacks is null."""
    return rows.unionByName(new, allowMissingColumns=True)


def integrated(tracks: DataFrame, members: DataFrame, tracklets: DataFrame, cluster_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks and members with tracklets (person, start_ms, ...) added: ids go on from the largest, in order of start, and they join their
    person's first cluster (person, cluster_id); tracklets of persons without one are left out."""
    first = cluster_of.groupBy("person").agg(F.min("cluster_id").alias("cluster_id"))
    top = tracks.agg(F.coalesce(F.max("track_id"), F.lit(-1)).alias("_top"))
    placed = tracklets.withColumn("_order", F.struct("start_ms", "end_ms", "person", F.xxhash64(*tracklets.columns))).join(first, "person")
    new = numbered(placed, "_order", "_nth").crossJoin(F.broadcast(top)).withColumn("track_id", F.col("_top") + 1 + F.col("_nth")).drop("_top", "_nth", "_order")
    return appended(tracks, new.drop("cluster_id", "person")), members.unionByName(new.select("cluster_id", "track_id"))


def restitched(tracks: DataFrame, members: DataFrame, tracklets: DataFrame, cluster_of: DataFrame, max_gap: int, least: float, margin: float, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``integrated``, and the links (track_id, linked_to, linked_from) of all tracks, old and new, stitched anew by their ``prototype``."""
    all_, held = integrated(tracks, members, tracklets, cluster_of)
    return all_, held, both_ways(stitch(all_.filter(whole("prototype")), max_gap, least, margin, rules=rules))


def mended(tracks: DataFrame, refs: DataFrame, detections: DataFrame) -> DataFrame:
    """Tracks with start, end, count and mean confidence as their references' detections have them; tracks without any stay as they are."""
    seen = refs.join(detections.select("frame_id", "det_idx", "ts_ms", F.col("conf").alias("_conf")), ["frame_id", "det_idx"])
    stats = seen.groupBy("track_id").agg(F.min("ts_ms").alias("_a"), F.max("ts_ms").alias("_b"), F.count("*").alias("_n"), F.avg("_conf").alias("_c"))
    rows = tracks.join(stats, "track_id", "left")
    new = {"start_ms": "_a", "end_ms": "_b", "count": "_n", "mean_confidence": "_c"}
    return rows.select(*[F.coalesce(new[c], c).alias(c) if c in new else F.col(c) for c in tracks.columns])
