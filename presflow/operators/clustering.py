"""Choice of a clustering radius by purity, figures of clusters, refinement, and the chain that clusters an episode anew."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoints
from . import graphs
from . import vectors as V
from .audits import consolidate, enforce_must
from .graphs import components
from .vectors import centroid, dbscan, dbscans, impurity, l2_normalise, nearest_distances, silhouette


@dataclass(frozen=True)
class SweepParams:
    low: float = 0.25
    high: float = 0.55
    around: float = 0.1
    step: float = 0.02
    least: int = 3
    weight: float = 0.75
    outlier: float = 0.75
    margin: float = 0.1
    min_clusters: int = 3
    #: No cluster may hold more than this percentile of the numbers of all rows.
    largest: float = 95.0
    #: Impurity from which the choice is looked at again; knees for which the radius then has a floor; the floor above the knee, and at least.
    impure: float = 0.3
    floor_knees: tuple[float, float] = (0.28, 0.30)
    floor_above: float = 0.02
    floor: float = 0.31


def knee(df: DataFrame, k: int = 6, share: float = 0.75) -> float:
    """The quartile of distances to the k-th nearest, itself counted (the furthest, if there are fewer rows)."""
    n = df.count()
    if n < 2:
        return 0.35
    return nearest_distances(df, min(k, max(2, n))).agg(F.percentile("kth", F.lit(share))).first()[0]


def candidates(at: float, p: SweepParams = SweepParams()) -> list[float]:
    """Radii around a knee, in steps up to at least the last; beyond the range its end."""
    first, last = min(max(p.low, at - p.around), p.high), max(p.low, min(p.high, at + p.around))
    return [round(float(e), 6) for e in np.arange(first, last + p.step, p.step)]


def eps_sweep(df: DataFrame, eps: list[float], p: SweepParams = SweepParams()) -> DataFrame:
    """eps, clusters, noise, largest, silhouette, impurity, score (silhouette - weight * impurity) and passes of each radius.

    Near pairs are gone through for all radii together (``dbscans``).  Noise is a label of its own in the silhouette, and has no part in the impurity; with
    fewer than two clusters the silhouette is zero.
    """
    checkpoints(df.sparkSession)
    clusters = dbscans(df, eps, p.least, components)
    n = df.count()
    allowed = int((n - 1) * p.largest / 100) if n else 0
    rows = []
    for e, found in zip(eps, clusters, strict=True):
        labels = found.checkpoint()
        labelled = df.select("vec_id", "embedding").join(labels.withColumnRenamed("cluster", "label"), "vec_id")
        sizes = labels.filter("cluster >= 0").groupBy("cluster").count()
        counts = labels.agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.count_if(F.col("cluster") < 0).alias("noise"))
        largest = sizes.agg(F.coalesce(F.max("count"), F.lit(0).cast("bigint")).alias("largest"))
        shape = silhouette(labelled).agg(F.coalesce(F.avg("silhouette"), F.lit(0.0)).alias("silhouette"))
        bad = impurity(labelled.filter("label >= 0"), p.outlier, p.margin).agg(F.coalesce(F.sum(F.col("impurity") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("impurity"))
        one = counts.join(largest).join(shape).join(bad)  # one row each
        told = one.select(F.lit(e).alias("eps"), "clusters", "noise", "largest", F.when(F.col("clusters") >= 2, F.round("silhouette", 6)).otherwise(0.0).alias("silhouette"), F.round("impurity", 6).alias("impurity"))
        passes = (F.col("clusters") >= p.min_clusters) & ((F.lit(allowed) <= 0) | (F.col("largest") <= allowed))
        rows.append(told.withColumn("score", F.round(F.col("silhouette") - p.weight * F.col("impurity"), 6)).withColumn("passes", passes))
    return reduce(DataFrame.unionByName, rows).checkpoint()


def choose(sweep: list, at: float, p: SweepParams = SweepParams()) -> tuple[float, list[str]]:
    """The radius and how it was come to, from the rows of a sweep: the best score of those that pass (of all, if none does).

    If that one is impure and the knee lies where that is known to happen, only radii from a floor on are looked at, those that pass first; if
    the choice is still impure, the purest takes its place.
    """
    best = lambda rows: max(rows, key=lambda r: r["score"])
    pool = [r for r in sweep if r["passes"]] or list(sweep)
    chosen, told = best(pool), ["score"]
    if chosen["impurity"] > p.impure and p.floor_knees[0] <= at <= p.floor_knees[1]:
        floor = max(at + p.floor_above, p.floor)
        higher = [r for r in pool if r["eps"] >= floor] or [r for r in sweep if r["eps"] >= floor]
        if higher:
            pool, chosen = higher, best(higher)
            told.append("floor")
    if chosen["impurity"] > p.impure:
        chosen = min([r for r in pool if r["passes"]] or pool, key=lambda r: (r["impurity"], -r["score"]))
        told.append("guard")
    return chosen["eps"], told


def chosen_eps(df: DataFrame, p: SweepParams = SweepParams()) -> tuple[float, list[str]]:
    """Knee, sweep and choice; the driver sees one row a radius."""
    at = knee(df)
    return choose([r.asDict() for r in eps_sweep(df, candidates(at, p), p).collect()], at, p)


def cluster_figures(labelled: DataFrame, low: float = 0.6) -> DataFrame:
    """Figures of the clusters (label >= 0) of rows (vec_id, label, embedding): size, variance, spread, silhouette, quality and is_low.

    variance is the mean distance to the mean (not scaled), spread its deviation; the silhouette is over rows in clusters, none with one
    cluster only.  quality = (1 - variance, at least 0) * the silhouette, if there is one, at least 0.
    """
    real = labelled.filter("label >= 0")
    means = real.select("label", F.posexplode("embedding").alias("_at", "_x")).groupBy("label", "_at").agg(F.avg("_x").alias("_m"))
    means = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("_at", "_m"))).alias("_v")).select("label", F.col("_v._m").alias("_mean"))
    off = F.zip_with("embedding", "_mean", lambda x, m: (x - m) * (x - m))
    far = real.join(means, "label").select("label", F.sqrt(F.aggregate(off, F.lit(0.0), lambda s, x: s + x)).alias("d"))
    shape = far.groupBy("label").agg(F.count("*").alias("size"), F.avg("d").alias("variance"), F.stddev_pop("d").alias("spread"))
    several = real.agg((F.countDistinct("label") > 1).alias("_several"))
    worth = silhouette(real).groupBy("label").agg(F.avg("silhouette").alias("_s"))
    rows = shape.join(worth, "label").crossJoin(F.broadcast(several)).withColumn("silhouette", F.when(F.col("_several"), F.col("_s")))
    near = 1 - F.least("variance", F.lit(1.0))
    quality = near * F.coalesce(F.greatest(F.lit(0.0), F.col("silhouette")), F.lit(1.0))
    return rows.select("label", "size", "variance", "spread", F.coalesce("silhouette", F.lit(0.0)).alias("silhouette"), quality.alias("quality"), (quality < low).alias("is_low"))


def variance_stats(figures: DataFrame) -> DataFrame:
    return figures.agg(F.avg("variance").alias("mean"), F.coalesce(F.stddev_pop("variance"), F.lit(0.0)).alias("spread"))


def suggestions(clusters: DataFrame, least: float = 0.75, most: int = 100) -> DataFrame:
    """The most alike pairs of clusters (cluster_id, centroid, size): a, b, sim, combined_size and rank."""
    size = lambda c: clusters.select(F.col("cluster_id").alias(c), F.col("size").alias(f"n_{c}"))
    found = V.pairs(clusters, "cluster_id", "centroid", least).join(size("a"), "a").join(size("b"), "b")
    top = found.orderBy(F.desc("sim"), "a", "b").limit(most)
    rank = F.row_number().over(V.Window.orderBy(F.desc("sim"), "a", "b"))  # at most ``most`` rows
    return top.select("a", "b", "sim", (F.col("n_a") + F.col("n_b")).alias("combined_size"), rank.cast("bigint").alias("rank"))


def sound(suggested: DataFrame, quality: DataFrame, least: float = 0.6) -> DataFrame:
    """Suggestions whose clusters both have a quality (cluster_id, quality) of ``least``; without one it is zero."""
    of = lambda c: quality.select(F.col("cluster_id").alias(c), F.coalesce("quality", F.lit(0.0)).alias(f"_{c}"))
    return suggested.join(of("a"), "a").join(of("b"), "b").filter((F.col("_a") >= least) & (F.col("_b") >= least)).select(suggested.columns)


def ejected(members: DataFrame, least: float = 0.35) -> DataFrame:
    """Members (cluster_id, track_id, embedding) with ``sim`` to the mean of their cluster and ``stays``."""
    unit = members.withColumn("_u", l2_normalise("embedding"))
    rows = unit.join(centroid(members, ["cluster_id"]).select("cluster_id", "centroid"), "cluster_id").withColumn("sim", V.dot("_u", "centroid"))
    return rows.select("cluster_id", "track_id", "embedding", "sim", (F.col("sim") >= least).alias("stays"))


def refine(members: DataFrame, distance: float = 0.35, outlier: float = 0.35, episode: str = "episode_id") -> DataFrame:
    """episode, cluster_id, track_id and into: members after outliers are ejected and alike clusters are merged.

    Merging is greedy and depends on order: from the smallest id on, a cluster takes in each later one whose centroid is near, and its centroid
    follows at once.  Only sums of vectors matter for that, one row a cluster: they go through one task an episode.  The first comparisons are
    with centroids of before the ejection.
    """
    rated = ejected(members.withColumn("cluster_id", F.struct(episode, "cluster_id")), outlier).select(F.col(f"cluster_id.{episode}").alias(episode), F.col("cluster_id.cluster_id").alias("cluster_id"), "track_id", "embedding", "stays")
    sums = lambda rows, name: rows.select(episode, "cluster_id", F.posexplode("embedding").alias("_at", "_x")).groupBy(episode, "cluster_id", "_at").agg(F.sum("_x").alias("_s"), F.count("*").alias("_n")).groupBy(episode, "cluster_id").agg(F.sort_array(F.collect_list(F.struct("_at", "_s"))).alias(name), F.max("_n").alias(f"n_{name}"))
    before, after = sums(rated, "all"), sums(rated.filter("stays"), "kept")
    rows = before.join(after, [episode, "cluster_id"], "left").select(episode, "cluster_id", F.col("all._s").alias("all"), F.col("kept._s").alias("kept"), F.coalesce("n_kept", F.lit(0)).alias("n"))
    kind = members.schema[episode].dataType.simpleString()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster_id")
        unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
        left = {c: (unit(np.array(a, float)), np.zeros(len(a)) if k is None else np.array(k, float), n) for c, a, k, n in zip(pdf["cluster_id"], pdf["all"], pdf["kept"], pdf["n"], strict=True)}
        out, order = [], list(left)
        while order:
            head = order.pop(0)
            centre, total, n = left[head]
            out.append((head, head))
            rest = []
            for c in order:
                if centre @ left[c][0] >= 1 - distance:
                    out.append((c, head))
                    total, n = total + left[c][1], n + left[c][2]
                    centre = unit(total) if n else centre
                else:
                    rest.append(c)
            order = rest
        return pd.DataFrame({episode: pdf[episode].iloc[0], "cluster_id": [c for c, _ in out], "into": [h for _, h in out]})

    moves = rows.groupBy(episode).applyInPandas(merge, f"{episode} {kind}, cluster_id bigint, into bigint")
    return rated.filter("stays").select(episode, "cluster_id", "track_id").join(moves, [episode, "cluster_id"])


@dataclass(frozen=True)
class ReclusterParams:
    sweep: SweepParams = SweepParams()
    eps: float | None = None  # none: chosen by purity
    faces: int = 10
    least_conf: float = 0.7
    least_size: int = 80
    most_iou: float = 0.1
    same_name: float = 0.75
    open_sim: float = 0.6
    open_margin: float = 0.08
    frame_low: float = 0.55
    frame_margin: float = 0.08


def _linked(named: DataFrame, members: DataFrame, links: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Must links and cannot links (a, b) between tracks, from clusters named by hand (cluster_id, track_id, name, confidence and maybe centroid) and kept ones.

    Tracks of one such cluster must stay together, and so must clusters of one name (see ``consolidate``).  Of different names, only those tracks are
    listed that ``members`` (cluster_id, track_id) puts together: each with one of another name, so that all who violate a constraint are in a pair.
    """
    stars = graphs.must_cannot(named).filter("kind = 'must'").select("a", "b")
    kept = links.filter("kind = 'must'").select("a", "b")
    cannot = links.filter("kind = 'cannot'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # two clusters of a name are kept apart only where every pair of their tracks is
    at = lambda c, of: named.select(F.col("track_id").alias(c), F.col("cluster_id").alias(of))
    size = lambda of: named.groupBy(F.col("cluster_id").alias(of)).agg(F.count("*").alias(f"n_{of}"))
    apart = cannot.join(at("a", "x"), "a").join(at("b", "y"), "b").filter("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).count()
    apart = apart.join(size("x"), "x").join(size("y"), "y").filter("count = n_x * n_y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    centre = F.first("centroid").alias("centroid") if "centroid" in named.columns else F.lit(None).cast("array<double>").alias("centroid")
    old = named.groupBy("cluster_id", "name", "confidence").agg(centre, F.min("track_id").alias("track_id"))
    first = lambda of, c: old.select(F.col("cluster_id").alias(of), F.col("track_id").alias(c))
    ties = consolidate(old, least, apart).join(first("cluster_id", "a"), "cluster_id").join(first("target", "b"), "target").select("a", "b")
    # of a track that is in several clusters, the last name holds
    by_hand = graphs.by_hand(named).groupBy("track_id").agg(F.max_by("name", "cluster_id").alias("name"))
    held = members.select("cluster_id", "track_id").join(by_hand, "track_id")
    two = held.groupBy("cluster_id").agg(F.min(F.struct("name", "track_id")).alias("p"), F.max(F.struct("name", F.col("track_id"))).alias("q")).filter("p.name <> q.name")
    met = held.join(two, "cluster_id").select(F.col("track_id").alias("a"), F.when(F.col("name") == F.col("p.name"), F.col("q.track_id")).otherwise(F.col("p.track_id")).alias("b"))
    return stars.unionByName(kept).unionByName(ties), cannot.unionByName(met)


def recluster(detections: DataFrame, refs: DataFrame, bank: DataFrame, suppressed: DataFrame, links: DataFrame, quality: Column, p: ReclusterParams = ReclusterParams(), named: DataFrame | None = None) -> dict[str, DataFrame]:
    """An episode clustered anew: members (cluster_id, track_id, name), samples, and figures of clusters (``figures``), tracks, clusters and persons.

    References to tracks, without suppressed ones (track_id), join detections; faces that pass, the best of each track by ``quality``, give the
    tracks' centroids, and these are clustered by density; noise is in no cluster.  Links are those of ``links`` (kind, a, b) and of clusters that were
    named by hand before (``named``: cluster_id, track_id, name, confidence, maybe centroid).  First, tracks that must not be together leave their cluster for a new
    one; then clusters that must links tie become one.  A cluster's centroid is the mean of all its sampled faces; one that left another has that one's,
    one that was tied the mean of its parts'.  By it the bank (identity, proto_id, embedding) names clusters where it is sure.  Last, confidence is rolled up.
    """
    from .assembly import of_tracks

    checkpoints(detections.sparkSession)
    held = of_tracks(detections, refs).join(suppressed, "track_id", "left_anti")
    good = V.face_samples(held, p.least_conf, p.least_size, p.most_iou).withColumn("quality", quality)
    samples = V.top_k(good, ["track_id"], p.faces, F.desc("quality"), F.col("vec_id")).checkpoint()
    tracks = centroid(samples, ["track_id"]).checkpoint()
    rows = tracks.select(F.col("track_id").alias("vec_id"), F.col("centroid").alias("embedding"))
    eps = p.eps if p.eps is not None else chosen_eps(rows, p.sweep)[0]
    labels = dbscan(rows, eps, p.sweep.least, components).checkpoint()
    dense = labels.filter("cluster >= 0").select(F.col("cluster").alias("cluster_id"), F.col("vec_id").alias("track_id"), F.lit(None).cast("string").alias("name"))
    none = detections.sparkSession.createDataFrame([], "cluster_id bigint, track_id bigint, name string, confidence double")
    must, cannot = _linked(none if named is None else named, dense, links, p.same_name)
    parted = graphs.enforce_cannot(dense, cannot).checkpoint()
    tied = enforce_must(parted, components(must)).checkpoint()
    faces = samples.select("track_id", "embedding").join(dense.select("cluster_id", "track_id"), "track_id").select("cluster_id", F.posexplode("embedding").alias("_at", "_x"))
    means = faces.groupBy("cluster_id", "_at").agg(F.avg("_x").alias("_m")).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("_at", "_m"))).alias("_v")).select(F.col("cluster_id").alias("_from"), F.col("_v._m").alias("embedding"))
    of = lambda m, c: m.select("track_id", F.col("cluster_id").alias(c))
    parts = of(tied, "cluster_id").join(of(parted, "_part"), "track_id").join(of(dense, "_from"), "track_id").select("cluster_id", "_part", "_from").distinct()
    centres = centroid(parts.join(means, "_from"), ["cluster_id"]).select("cluster_id", "centroid").checkpoint()
    best = V.best_two(V.identity_sims(centres, bank.withColumn("embedding", l2_normalise("embedding")), ["cluster_id"], "centroid"), ["cluster_id"], "label")
    sure = V.open_set(best, p.open_sim, p.open_margin).select("cluster_id", F.when(F.col("assigned") != "unknown", F.col("assigned")).alias("name"))
    members = tied.select("cluster_id", "track_id").join(sure, "cluster_id", "left").checkpoint()
    frames = samples.drop("identity", "cluster_id").join(members, "track_id").withColumnRenamed("name", "identity").join(centres, "cluster_id")
    scored = V.frame_confidence(frames, bank, p.frame_low, p.frame_margin).join(samples.select("vec_id", "track_id", "quality"), "vec_id").checkpoint()
    metrics = V.track_confidence(members.select("track_id"), scored)
    figures = cluster_figures(rows.join(labels.withColumnRenamed("cluster", "label"), "vec_id"))
    return {"members": members, "samples": scored, "centres": centres, "figures": figures, "tracks": metrics, "clusters": V.cluster_confidence(members, metrics, tracks), "persons": V.person_confidence(members, metrics)}


@dataclass(frozen=True)
class CleanParams:
    least_conf: float = 0.65
    least_size: int = 72
    most_iou: float = 0.1
    faces: int = 10
    eps: float = 0.45
    least: int = 3
    outlier_sim: float = 0.75
    deviations: float = 3.0
    margin: float = 0.1
    run: int = 4
    evidence: float = 0.12
    split: bool = True


def clean_clusters(detections: DataFrame, refs: DataFrame, quality: Column, p: CleanParams = CleanParams()) -> dict[str, DataFrame]:
    """An episode clustered by its good faces alone: samples, members (cluster_id, track_id; noise is in none), figures of clusters and
    contaminated spans (see ``recovery.contamination_audit``), which are told of and not acted on.

    Faces that pass, the best of each track by ``quality``, give the tracks' centroids; these are clustered by density with one
    radius, without constraints or names.  A track without a good face takes no part.  A sample's place is its number in its track by frame.
    """
    from .assembly import of_tracks
    from .recovery import contamination_audit

    checkpoints(detections.sparkSession)
    good = V.face_samples(of_tracks(detections, refs), p.least_conf, p.least_size, p.most_iou).withColumn("quality", quality)
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("frame_id", "vec_id")) - 1
    samples = V.top_k(good, ["track_id"], p.faces, F.desc("quality"), F.col("vec_id")).select("track_id", "frame_id", "vec_id", "embedding", "conf", "face_size", "quality", place.alias("at")).checkpoint()
    rows = centroid(samples, ["track_id"]).select(F.col("track_id").alias("vec_id"), F.col("centroid").alias("embedding")).checkpoint()
    labels = dbscan(rows, p.eps, p.least, components).checkpoint()
    members = labels.filter("cluster >= 0").select(F.col("cluster").alias("cluster_id"), F.col("vec_id").alias("track_id"))
    figures = cluster_figures(rows.join(labels.withColumnRenamed("cluster", "label").filter("label >= 0"), "vec_id"))
    spans = contamination_audit(samples.join(members, "track_id").select("cluster_id", "track_id", "at", "vec_id", "embedding"), p.outlier_sim, p.deviations, p.margin, p.run, p.evidence, p.split)
    return {"samples": samples, "members": members, "figures": figures, "spans": spans}
