"""Audits of identities and clusters: contamination, bank quality, low-confidence reasons, consolidation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoints
from .graphs import components
from .vectors import _matrix, l2_normalise, least_product, products, whole

#: Rows of a key that are settled in one round, and open rows of a key that are one task's.
FIRST, SPLIT = 1024, 16_384


def cross_contamination(frames: DataFrame, centres: DataFrame, margin: float) -> DataFrame:
    """Frames (item, cluster_id, at, u) nearer to another centroid (other, centroid) than to their own by ``margin``; best_other starts at 0."""
    met = products(frames, centres, "u", "centroid").withColumnRenamed("sim", "s")
    own = F.max(F.when(F.col("other") == F.col("cluster_id"), F.col("s")))
    rival = F.max(F.when(F.col("other") != F.col("cluster_id"), F.struct(F.col("s"), (-F.col("other")).alias("o"))))
    rows = met.groupBy("item", "cluster_id", "at").agg(own.alias("own"), rival.alias("rival"))
    best = F.greatest(F.lit(0.0), F.coalesce("rival.s", F.lit(0.0)))
    return rows.filter(best - F.col("own") >= margin).select("item", "cluster_id", "at", (best - F.col("own")).alias("strength"), F.when(F.col("rival.s") > 0, -F.col("rival.o")).alias("other"))


def contamination_spans(hits: DataFrame, least: int) -> DataFrame:
    """Runs of consecutive contaminated frames of a cluster with the action they call for.

    split_to_X if all of the run's frames that have another cluster have the same, X; split_to_unknown if none has one; else flag.
    """
    w = Window.partitionBy("cluster_id").orderBy("at")
    placed = hits.withColumn("run", F.col("at") - F.row_number().over(w))
    rows = placed.groupBy("cluster_id", "run").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n"), F.avg("strength").alias("strength"), F.min("other").alias("low"), F.max("other").alias("high"))
    action = F.when(F.col("low") == F.col("high"), F.concat(F.lit("split_to_"), F.col("low").cast("string"))).when(F.col("low").isNull(), "split_to_unknown").otherwise("flag")
    return rows.filter(F.col("n") >= least).select("cluster_id", "first_at", "last_at", "n", "strength", action.alias("action"))


def bank_metrics(bank: DataFrame, overlap: float) -> DataFrame:
    """For each identity (proto_id, identity, embedding): prototypes, the quarter-point of each one's best similarity to its own, and the share nearer than ``overlap`` to another identity."""
    other = bank.select(F.col("proto_id").alias("o_id"), F.col("identity").alias("o_identity"), F.col("embedding").alias("o"))
    met = products(bank.select("proto_id", "identity", "embedding"), other, "embedding", "o").filter("proto_id <> o_id").withColumnRenamed("sim", "s")
    each = met.groupBy("proto_id", "identity").agg(F.max(F.when(F.col("identity") == F.col("o_identity"), F.col("s"))).alias("own"), F.max(F.when(F.col("identity") != F.col("o_identity"), F.col("s"))).alias("rival"))
    rows = each.groupBy("identity").agg(F.count("*").alias("prototypes"), F.sort_array(F.array_compact(F.collect_list("own"))).alias("own"), F.avg((F.coalesce("rival", F.lit(-1.0)) > overlap).cast("int")).alias("contam"))
    return rows.select("identity", "prototypes", F.get("own", F.floor(F.size("own") * 0.25).cast("int")).alias("p25"), "contam")


def reasons(p25: Column, conflict: Column, low: float, high: float) -> Column:
    """Array of what makes a track or a cluster doubtful."""
    return F.array_compact(F.array(F.when(p25 < low, F.format_string("LOW p25 %.2f", p25)), F.when(conflict >= high, F.format_string("HIGH conflict %.2f", conflict))))


def pose_bin(offset: Column, size: Column) -> Column:
    """Pose by how far the nose stands from the middle of the eyes, and scale by the face's size."""
    pose = F.when(F.abs(offset) > 0.5, "profile").when(F.abs(offset) > 0.25, "three_quarter").otherwise("frontal")
    return F.concat(pose, F.when(size < 100, "_small").otherwise("_large"))


def best_of(df: DataFrame, keys: list[str], item: str, *order: str) -> DataFrame:
    """Of each key the item that is largest by the order (the smallest item of equals)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], item)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def enforce_must(members: DataFrame, components: DataFrame) -> DataFrame:
    """Clusters that must-link components (node, component) tie together made one: the first named (else the smallest) keeps its id.

    A cluster goes with the component of its smallest track, so one of mixed components is decided alike every time.
    """
    small = members.groupBy("cluster_id", "name").agg(F.min("track_id").alias("node"))
    tied = small.join(components, "node").select("component", "cluster_id", "name")
    first = tied.groupBy("component").agg(F.min(F.struct(F.col("name").isNull().alias("unnamed"), F.col("cluster_id").alias("to"), F.col("name").alias("to_name"))).alias("f"))
    moves = tied.join(first, "component").select("cluster_id", "f.to", "f.to_name")
    return members.join(moves, "cluster_id", "left").select(F.coalesce("to", "cluster_id").alias("cluster_id"), "track_id", F.when(F.col("to").isNotNull(), F.col("to_name")).otherwise(F.col("name")).alias("name"))


def consolidate(clusters: DataFrame, least: float, cannot: DataFrame) -> DataFrame:
    """cluster_id and target: clusters (cluster_id, name, confidence, centroid) that a person gave the same name join the smallest of those they are tied to.

    A name is left alone as a whole if any two of its clusters, both with a centroid, have a product under ``least``.  Else all its clusters are tied
    to each other, but for pairs of ``cannot`` (a, b).  A cluster in no such pair ties all of a name together; only where a name has none, pairs are
    made, of clusters that are in such pairs.
    """
    locked = clusters.filter("name is not null and name <> 'Unknown' and confidence = 1.0").select("name", "cluster_id", "centroid")
    apart = least_product(locked, ["name"], "cluster_id", "centroid").filter(F.col("least") < least)
    joined = locked.join(apart, "name", "left_anti").select("name", "cluster_id")
    of = lambda c: joined.select(F.col("cluster_id").alias(c), F.col("name").alias(f"_{c}"))
    barred = cannot.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(of("a"), "a").join(of("b"), "b").filter("_a = _b and a < b").select(F.col("_a").alias("name"), "a", "b")
    held = barred.select("name", F.explode(F.array("a", "b")).alias("cluster_id")).distinct()
    free = joined.join(held, ["name", "cluster_id"], "left_anti").groupBy("name").agg(F.min("cluster_id").alias("free"))
    stars = joined.join(free, "name").select(F.col("free").alias("a"), F.col("cluster_id").alias("b"))
    tight = held.join(free, "name", "left_anti")
    among = tight.select("name", F.col("cluster_id").alias("a")).join(tight.select("name", F.col("cluster_id").alias("b")), "name").filter("a < b").join(barred, ["name", "a", "b"], "left_anti")
    return components(stars.unionByName(among.select("a", "b"))).filter("node <> component").select(F.col("node").alias("cluster_id"), F.col("component").alias("target"))


def greedy_distinct(df: DataFrame, keys: list[str], order: str, most: float, vector: str = "embedding") -> DataFrame:
    """keys and order of the rows that are not alike (by a similarity of ``most``) to an accepted one of their key that comes before.

    ``order`` is a column of distinct values.  In rounds: of each key the next FIRST open rows in order are settled one after another, and the open
    rows behind them that are alike to an accepted one go, in products of blocks.  Pairs are not written; a round leaves FIRST rows fewer of each
    key at least, and mostly far fewer.
    """
    spark = checkpoints(df.sparkSession)
    names = [*keys, "_order"]
    unit = df.select(*keys, F.col(order).alias("_order"), l2_normalise(vector).alias("_u"))
    usable = F.col("_usable")
    unit = unit.withColumn("_usable", whole("_u") & F.coalesce(F.exists("_u", lambda x: x != 0), F.lit(False)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in unit.schema.fields if f.name in names)
    apart = unit.filter(~usable).select(*names)  # near to none
    open_ = unit.filter(usable).drop("_usable").checkpoint()
    # equal keys meet, nulls among them
    key = F.xxhash64(*keys)

    def settle(some: pa.Table) -> pa.Table:
        some = some.sort_by("_order")
        x = _matrix(some, "_u")
        alike, kept = x @ x.T >= most, []
        gone = np.zeros(len(x), bool)
        for i in range(len(x)):
            if not gone[i]:
                kept.append(i)
                gone |= alike[i]
        return some.take(pa.array(kept))

    def rest(some: pa.Table, accepted: pa.Table) -> pa.Table:
        if not some.num_rows or not accepted.num_rows:
            return some.select(open_names)
        x, y = _matrix(some, "_u"), _matrix(accepted, "_u")
        near = np.concatenate([(x[at : at + 1024] @ y.T >= most).any(1) for at in range(0, len(x), 1024)])
        return some.select(open_names).filter(pa.array(~near))

    kept, open_names = [], open_.columns
    full = f"{kinds}, _u array<double>"
    while not open_.isEmpty():
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_order"))
        first = open_.select(*names).withColumn("_n", nth).filter(F.col("_n") <= FIRST)
        right_names = [F.col(k).alias(f"_r_{k}") for k in keys]
        same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
        sizes = open_.groupBy(*keys).agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("_parts"))
        bound = first.groupBy(*keys).agg(F.max("_order").alias("_last")).select(*right_names, "_last").join(sizes, same).select(*[f"_r_{k}" for k in keys], "_last", "_parts").checkpoint()
        bound = F.broadcast(bound) if bound.count() <= FIRST else bound
        placed = open_.join(bound, same).select(*open_names, "_last", "_parts")
        accepted = placed.filter(F.col("_order") <= F.col("_last")).select(*open_names).groupBy(*keys).applyInArrow(settle, full).checkpoint()
        kept.append(accepted.select(*names))
        # the open rows of a key are dealt to parts, each of which meets all that were accepted in this round
        behind = placed.filter(F.col("_order") > F.col("_last"))
        left = behind.withColumn("_part", F.pmod(F.xxhash64("_order"), F.col("_parts")).cast("int")).select(*open_names, key.alias("_key"), "_part")
        right = accepted.join(bound, same).select(*open_names, key.alias("_key"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
        open_ = left.groupBy("_key", *keys, "_part").cogroup(right.groupBy("_key", *keys, "_part")).applyInArrow(rest, full).checkpoint()
    out = reduce(DataFrame.unionByName, [apart, *kept])
    return out.select(*keys, F.col("_order").alias(order))


def cluster_audit(frames: DataFrame) -> DataFrame:
    """n, mean and least similarity to the centroid, and the share of doubtful frames of each cluster of rows (cluster_id, sim, conf)."""
    return frames.groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg("sim").alias("mean_sim"), F.min("sim").alias("least_sim"), F.avg((F.col("conf") < 0.7).cast("int")).alias("doubtful"))
