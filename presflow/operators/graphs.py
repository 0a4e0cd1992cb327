"""Must-link components and cannot-link constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoints
from .vectors import against, numbered

#: Asked tracks up to which they are sent to every task whole.
FEW = 200_000


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of links (a, b): labels and jumps in turn, each round written as a checkpoint."""
    checkpoints(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label").checkpoint()
    while True:
        met = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(met, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("to"))
        new = lower.join(jump, "low", "left").select("node", F.least(F.coalesce("to", "low"), "low").alias("label"), "was").checkpoint()
        if new.filter("label <> was").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")


def components_after(labels: DataFrame, edges: DataFrame, new: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """The labels (node, component) after links ``new`` (a, b) have come and ``lost`` ones have gone; ``edges`` are all links before.

    Only what is touched is worked out again: components that lost a link from their own remaining links, and then the new links between
    components, which are contracted to one node each.  Nodes whose component stays keep their row as it is; a component's name is its smallest node.
    """
    checkpoints(labels.sparkSession)
    both = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    new, at = both(new), lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    if lost is not None:
        gone = both(lost).join(both(edges), ["a", "b"], "left_semi").join(new, ["a", "b"], "left_anti").checkpoint()
        hurt = gone.join(at("a"), "a").select(F.col("_a").alias("component")).distinct().checkpoint()
        inside = both(edges).join(gone, ["a", "b"], "left_anti").join(at("a"), "a").join(hurt.withColumnRenamed("component", "_a"), "_a", "left_semi").select("a", "b")
        again = components(inside).checkpoint()
        parts = labels.join(hurt, "component", "left_semi").select("node").join(again, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        labels = labels.join(hurt, "component", "left_anti").select("node", "component").unionByName(parts).checkpoint()
    fresh = new.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    labels = labels.select("node", "component").unionByName(fresh).checkpoint()
    between = new.join(at("a"), "a").join(at("b"), "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).checkpoint()
    if between.isEmpty():
        return labels
    merged = components(between).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return labels.join(merged, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))


def first_independent(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The nodes that stay if they are gone through in order and one goes if it is in conflict with one that stays.

    ``conflicts`` (a, b): a comes before b in the order, which is thus in the pairs alone.  In rounds: who has no conflict with an earlier node
    that is still open stays, and whoever is in conflict with these goes.  That is the lexicographically first maximal independent set; rounds are
    as many as its longest chain of decisions, each over the pairs that are still open, and written as a checkpoint.
    """
    checkpoints(nodes.sparkSession)
    open_ = conflicts.select("a", "b").distinct().checkpoint()
    gone = None
    while not open_.isEmpty():
        stays = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")), "a", "left_anti")
        goes = open_.join(stays, "a", "left_semi").select("b").distinct().checkpoint()
        gone = goes if gone is None else gone.unionByName(goes)
        # pairs whose first node goes are settled, and so are those whose second does
        open_ = open_.join(stays, "a", "left_anti").join(goes.select(F.col("b").alias("a")), "a", "left_anti").join(goes, "b", "left_anti").select("a", "b").checkpoint()
    return nodes if gone is None else nodes.join(gone.select(F.col("b").alias("node")), "node", "left_anti")


def must_cannot(named: DataFrame) -> DataFrame:
    """kind (must or cannot), a, b of tracks (track_id, cluster_id, name, confidence) in clusters named by hand.

    Tracks of one such cluster must stay together, tracks of different names must not.  Links are between classes: a cluster's tracks are
    tied to its smallest one, and a name's smallest track stands for all of the name; ``expanded`` gives the pairs of tracks that are asked for.
    """
    own = by_hand(named)
    first = own.groupBy("cluster_id").agg(F.min("track_id").alias("a"))
    must = own.join(first, "cluster_id").filter("track_id > a").select(F.lit("must").alias("kind"), "a", F.col("track_id").alias("b"))
    names = own.groupBy("name").agg(F.min("track_id").alias("a"))
    cannot = against(names.select("a"), names.select(F.col("a").alias("b"))).filter("a < b")  # names: those that people gave
    return must.unionByName(cannot.select(F.lit("cannot").alias("kind"), "a", "b")).distinct()


def by_hand(named: DataFrame) -> DataFrame:
    """Rows of clusters that a person gave a name."""
    return named.filter(F.col("name").isNotNull() & (F.col("name") != "Unknown") & (F.col("confidence").isNull() | (F.col("confidence") == 1.0)))


def expanded(named: DataFrame, asked: DataFrame) -> DataFrame:
    """kind, a, b: every pair that a track of ``asked`` (track_id) has in the constraints of ``must_cannot``; as many rows as asked tracks times tracks.

    A pair of two asked tracks comes from the smaller one alone, so pairs are told once as they are made, and are not shuffled; only those of tracks that are
    in several clusters are looked through for equal ones.
    """
    checkpoints(named.sparkSession)
    own = by_hand(named).select("track_id", "cluster_id", "name").distinct()
    own = own.join(asked.select("track_id", F.lit(True).alias("asked")).distinct(), "track_id", "left")
    several = own.groupBy("track_id").count().filter("count > 1").select("track_id").checkpoint()
    some = own.filter("asked").checkpoint()
    if several.isEmpty():
        return _met(some, own)
    of = lambda rows, how: rows.join(several, "track_id", how)
    single, again = _met(of(some, "left_anti"), of(own, "left_anti")), _met(of(some, "left_semi"), own).unionByName(_met(of(some, "left_anti"), of(own, "left_semi")))
    return single.unionByName(again.distinct())


def _met(some: DataFrame, own: DataFrame) -> DataFrame:
    """kind, a, b of asked tracks with all; up to FEW asked ones are sent to every task."""
    some = some.select(F.col("track_id").alias("a"), F.col("cluster_id").alias("c"), F.col("name").alias("n"))
    once = (F.col("a") < F.col("track_id")) | ((F.col("a") > F.col("track_id")) & F.col("asked").isNull())
    must = some.join(own, (F.col("c") == F.col("cluster_id")) & once).select(F.lit("must").alias("kind"), "a", "track_id")
    met = own.crossJoin(F.broadcast(some)) if some.count() <= FEW else against(own, some)
    cannot = met.filter((F.col("n") != F.col("name")) & once).select(F.lit("cannot").alias("kind"), "a", "track_id")
    return must.unionByName(cannot).select("kind", F.least("a", "track_id").alias("a"), F.greatest("a", "track_id").alias("b"))


def constraint_counts(links: DataFrame) -> DataFrame:
    """One row: the numbers of links (kind, a, b) of each kind and of tracks in them."""
    sides = links.select("kind", F.explode(F.array("a", "b")).alias("t"))
    tracks = sides.agg(F.countDistinct("t").alias("tracks"), F.countDistinct(F.when(F.col("kind") == "must", F.col("t"))).alias("must_tracks"))
    counts = links.agg(F.count_if(F.col("kind") == "must").alias("must_links"), F.count_if(F.col("kind") == "cannot").alias("cannot_links"))
    return counts.crossJoin(tracks)  # one row each


def all_constraints(*sources: DataFrame) -> DataFrame:
    """Links (kind, a, b) of all sources, each once and with a before b."""
    rows = reduce(DataFrame.unionByName, [s.select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for s in sources])
    return rows.distinct()


def enforce_cannot(members: DataFrame, cannot: DataFrame) -> DataFrame:
    """Members (cluster_id, track_id, name) with those of unnamed clusters that violate a pair moved to one new cluster each."""
    at = lambda side: members.filter("name IS NULL").select(F.col("track_id").alias(side), F.col("cluster_id").alias(f"at_{side}"))
    violated = cannot.select("a", "b").join(at("a"), "a").join(at("b"), "b").filter("at_a = at_b and a <> b")
    hit = violated.select(F.explode(F.array("a", "b")).alias("track_id"), F.col("at_a").alias("cluster_id")).distinct().withColumn("moved", F.lit(True))
    top = members.agg(F.max("cluster_id").alias("top"))
    new = numbered(hit.select("cluster_id").distinct(), "cluster_id", "n").join(F.broadcast(top)).select("cluster_id", (F.col("top") + 1 + F.col("n")).alias("new_id"))
    joined = members.join(hit, ["cluster_id", "track_id"], "left").join(new, "cluster_id", "left")
    return joined.select(F.when(F.col("moved"), F.col("new_id")).otherwise(F.col("cluster_id")).alias("cluster_id"), "track_id", "name")
