"""Vector operators on ``array<double>`` columns, and what is built of them: centroids, medoids, matching, confidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoints
from . import blocks

#: Rows of one side up to which it is sent to every task whole.
SMALL = 20_000
#: Rows of each side of a block of products.
BLOCK = 2048
#: Pivots of the metric index at most.
MOST_PIVOTS = 512


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(a: Column | str) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.when(n == 0, F.col(a) if isinstance(a, str) else a).otherwise(F.transform(a, lambda x: x / n))), 1)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-9)


def centroid(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Mean of the vectors of each key, scaled to unit length, and their number."""
    spread = df.select(*keys, F.posexplode(vector).alias("_at", "_x"))
    means = spread.groupBy(*keys, "_at").agg(F.avg("_x").alias("_m"), F.count("*").alias("n"))
    whole = means.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("_at", "_m"))).alias("_v"))
    return whole.select(*keys, "n", F.col("_v._m").alias("_mean")).select(*keys, "n", l2_normalise("_mean").alias("centroid"))


def median_template(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Element-wise median of the vectors of each key."""
    spread = df.select(*keys, F.posexplode(vector).alias("_at", "_x"))
    medians = spread.groupBy(*keys, "_at").agg(F.percentile("_x", F.lit(0.5)).alias("_m"))
    return medians.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "_m"))).alias("_v")).select(*keys, F.col("_v._m").alias("template"))


def best_template(df: DataFrame, keys: list[str], k: int = 10, item: str = "vec_id") -> DataFrame:
    """Element-wise median of each key's k samples that are largest by confidence times face size (square root of the area)."""
    size = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return median_template(top_k(df, keys, k, F.desc(F.col("conf") * size), F.col(item)), keys)


def against(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of left with every row of right, in blocks: right is dealt to blocks of at most SMALL rows that meet left by number.

    For things of which one side has few; the left side is copied once for each block of the right.
    """
    blocks = max(1, -(-right.count() // SMALL))
    numbered = right.withColumn("_block", F.pmod(F.xxhash64(*[c for c, t in right.dtypes if not t.startswith("array")]), F.lit(blocks)).cast("int"))
    return left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(numbered, "_block").drop("_block")


def whole(vector: Column | str) -> Column:
    """Whether a vector is there and has no null component."""
    return F.coalesce(~F.exists(vector, lambda x: x.isNull()), F.lit(False))


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table[column].combine_chunks()
    if not len(flat):
        return np.zeros((0, 0))
    values, lengths = flat.flatten().to_numpy(zero_copy_only=False).astype(float), set(flat.value_lengths().to_pylist())
    if len(lengths) > 1:
        raise ValueError(f"vectors of {min(lengths)} and of {max(lengths)} components can't be multiplied")
    return values.reshape(len(flat), -1)


def _schema(*frames: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for df in frames for f in df.schema.fields)


def products(left: DataFrame, right: DataFrame, lv: str, rv: str, least: float | None = None, best: int | None = None, triangle: bool = False, block: int = BLOCK, by: str | None = None) -> DataFrame:
    """Rows of left with rows of right and ``sim``, the product of the vectors ``lv`` and ``rv`` (which are left out).

    Blocks of left meet blocks of right, one matrix product each, so a row is sent once for each block of the other side.  Only pairs of
    ``least`` or more are kept, and of each left row in each block the ``best`` (with ties).  ``triangle``: both sides are one frame with
    its names apart, and a pair of blocks meets once; who asks for it keeps one of (x, y) and (y, x).  ``by``: of the right
    columns only this one, with the largest product of each of its values in each block.  Rows whose vector is null or holds a null take no
    part; vectors of different lengths are an error.
    """
    left, right = left.filter(whole(lv)), right.filter(whole(rv))
    n, m = (max(1, -(-df.count() // block)) for df in (left, right))
    left_keys, right_keys = left.drop(lv), right.drop(rv)
    spot = lambda df, of, blocks: F.pmod(F.xxhash64(*[c for c in df.columns if c != of]), F.lit(blocks)).cast("int")
    l = left.withColumn("_l", spot(left, lv, n)).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    r = right.withColumn("_r", spot(right, rv, m)).withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if triangle:
        l, r = l.filter("_l <= _r"), r.filter("_l <= _r")
    if by:
        right_keys = right_keys.select(by)
    names = [*left_keys.columns], [*right_keys.columns]

    def run(some: pa.Table, others: pa.Table) -> pa.Table:
        if not some.num_rows or not others.num_rows:
            i = j = np.zeros(0, np.int64)
            sims = np.zeros(0)
        else:
            x, y = _matrix(some, lv), _matrix(others, rv)
            if x.shape[1] != y.shape[1]:
                raise ValueError(f"vectors of {x.shape[1]} and of {y.shape[1]} components can't be multiplied")
            sims = x @ y.T
            if by:
                order = pa.compute.sort_indices(others, [(by, "ascending")])
                others, sims = others.select([by]).take(order), sims[:, order.to_numpy()]
                run_ends = pa.compute.run_end_encode(others[by].combine_chunks()).run_ends.to_numpy()
                first = np.r_[0, run_ends[:-1]]
                others, sims = others.take(pa.array(first)), np.maximum.reduceat(sims, first, axis=1)
            keep = np.ones(sims.shape, bool) if least is None else sims >= least
            if best is not None and best < sims.shape[1]:
                keep &= sims >= np.partition(sims, -best, axis=1)[:, -best, None]
            i, j = np.nonzero(keep)
            sims = sims[i, j]
        return pa.Table.from_arrays([*(some[c].take(pa.array(i)) for c in names[0]), *(others[c].take(pa.array(j)) for c in names[1]), pa.array(sims)], [*names[0], *names[1], "sim"])

    return l.groupBy("_l", "_r").cogroup(r.groupBy("_l", "_r")).applyInArrow(run, f"{_schema(left_keys, right_keys)}, sim double")


def least_product(rows: DataFrame, keys: list[str], item: str, vector: str, block: int = BLOCK) -> DataFrame:
    """keys and ``least``, the smallest product of two of a key's vectors, for keys that have two.  Blocks of a key's vectors meet, one number comes out."""
    usable = rows.select(*keys, item, vector).filter(whole(vector))
    counts = usable.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    dealt = usable.join(counts, keys).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_n")).cast("int")).withColumn("_met", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    kinds = _schema(rows.select(*keys))

    def run(some: pa.Table, others: pa.Table) -> pa.Table:
        if not some.num_rows or not others.num_rows:
            return some.select(keys).slice(0, 0).append_column("least", pa.array([], pa.float64()))
        sims = _matrix(some, vector) @ _matrix(others, f"_{vector}").T
        mine, theirs = np.asarray(some[item].to_pylist()), np.asarray(others[f"_{item}"].to_pylist())
        sims[mine[:, None] == theirs[None, :]] = np.inf
        return some.select(keys).slice(0, 1).append_column("least", pa.array([float(sims.min())]))

    left = dealt.select(*keys, item, vector, F.col("_own").alias("_l"), F.col("_met").alias("_r"))
    right = dealt.select(*[F.col(c).alias(f"_{c}") for c in (*keys, item, vector)], F.col("_met").alias("_l"), F.col("_own").alias("_r"))
    on = [*keys, "_l", "_r"], [*[f"_{k}" for k in keys], "_l", "_r"]
    found = left.filter("_l <= _r").groupBy(*on[0]).cogroup(right.filter("_l <= _r").groupBy(*on[1])).applyInArrow(run, f"{kinds}, least double")
    return found.groupBy(*keys).agg(F.min("least").alias("least")).filter(F.col("least") < float("inf"))


def medoid(df: DataFrame, keys: list[str], item: str, vector: str = "embedding") -> DataFrame:
    """Of each key, the item with the largest summed similarity to the others, the smallest of equals.

    The sum over a key's unit vectors v . (sum of all) needs no pairs.
    """
    unit = df.select(*keys, item, l2_normalise(vector).alias("_u"))
    total = unit.select(*keys, F.posexplode("_u").alias("_at", "_x")).groupBy(*keys, "_at").agg(F.sum("_x").alias("_s"))
    total = total.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "_s"))).alias("_t"))
    scored = unit.join(total, keys).select(*keys, item, F.round(dot("_u", F.col("_t._s")) - 1, 9).alias("score"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), item)
    return scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def best_two(scored: DataFrame, key: list[str], label: str, score: str = "sim") -> DataFrame:
    """best, best_sim, second_sim (0 if there is no second) and margin of each key; ties go to the smaller label."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), label)
    top = scored.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    pick = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    out = top.groupBy(*key).agg(pick(1, label).alias("best"), pick(1, score).alias("best_sim"), F.coalesce(pick(2, score), F.lit(0.0)).alias("second_sim"))
    return out.withColumn("margin", F.col("best_sim") - F.col("second_sim"))


def identity_sims(rows: DataFrame, bank: DataFrame, key: list[str], vector: str = "embedding") -> DataFrame:
    """sim: each row's best similarity to any prototype of each identity."""
    b = bank.select(F.col("identity").alias("label"), F.col("embedding").alias("_proto"), "proto_id")
    return products(rows.select(*key, F.col(vector).alias("_v")), b, "_v", "_proto", by="label").groupBy(*key, "label").agg(F.max("sim").alias("sim"))


def open_set(best: DataFrame, least: float, margin: float) -> DataFrame:
    """assigned: the best label, or unknown if it is not alike or not apart enough."""
    return best.withColumn("assigned", F.when((F.col("best_sim") >= least) & (F.col("margin") >= margin), F.col("best")).otherwise("unknown"))


def pairs(rows: DataFrame, item: str, vector: str, least: float) -> DataFrame:
    """Pairs (a, b, sim) of items, a before b, with a similarity of at least ``least``."""
    r = rows.select(F.col(item).alias("b"), F.col(vector).alias("_vb"))
    out = products(rows.select(F.col(item).alias("a"), F.col(vector).alias("_va")), r, "_va", "_vb", least, triangle=True)
    # a pair of blocks meets once, with its items either way round
    return out.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").dropDuplicates(["a", "b"])


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2)."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    shared = side(0, 2) * side(1, 3)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def box(alias: str = "") -> list[Column]:
    return [F.col(f"{alias}.{c}" if alias else c) for c in ("x1", "y1", "x2", "y2")]


def nms(df: DataFrame, keys: list[str], item: str, most: float = 0.5, bin_px: int = 64) -> DataFrame:
    """Greedy suppression: by falling confidence, a box goes if it overlaps one of its key that stays by more than ``most``.

    Boxes that overlap are found by a join of their sides; what stays is settled in rounds over these conflicts, not box by box.
    """
    from .graphs import first_independent
    from .intervals import range_join

    rank = F.struct((-F.col("conf")).alias("c"), F.col(item).alias("i"))
    rows = df.select(*keys, item, rank.alias("_rank"), *[F.col(c).cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")])
    sides = rows.withColumn("start_ms", F.col("x1")).withColumn("end_ms", F.col("x2"))
    over = range_join(sides, sides, (F.col("l._rank") < F.col("r._rank")) & (iou(box("l"), box("r")) > most), bin_px, on=keys)
    node = lambda of: F.struct(*[F.col(f"{of}.{k}") for k in [*keys, item]])
    kept = first_independent(rows.select(F.struct(*keys, item).alias("node")), over.select(node("l").alias("a"), node("r").alias("b")))
    return kept.select("node.*")


def face_samples(df: DataFrame, least_conf: float, least_size: int, most_iou: float, least_sharpness: float | None = None) -> DataFrame:
    """Samples that pass: a vector, confidence, size (the longer side), no other face that covers them in the frame, and sharpness, if asked for."""
    sized = df.withColumn("face_size", F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    good = sized.filter(F.col("embedding").isNotNull() & (F.col("conf") >= least_conf) & (F.col("face_size") >= least_size))
    if least_sharpness is not None:
        good = good.filter(F.col("sharpness") >= least_sharpness)
    l, r = good.alias("l"), df.select("frame_id", "vec_id", "x1", "y1", "x2", "y2").alias("r")
    different = (F.col("l.x1") != F.col("r.x1")) | (F.col("l.y1") != F.col("r.y1")) | (F.col("l.x2") != F.col("r.x2")) | (F.col("l.y2") != F.col("r.y2"))
    return l.join(r, (F.col("l.frame_id") == F.col("r.frame_id")) & different & (iou(box("l"), box("r")) > most_iou), "left_anti")


def sample_quality(conf: Column, size: Column, sharpness: Column) -> Column:
    share = F.least(F.greatest((size - 72) / 228.0, F.lit(0.0)), F.lit(1.0))
    return 0.6 * F.greatest(F.lit(0.0), (conf - 0.5) / 0.5) + 0.3 * share + 0.1 * sharpness


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("nth") <= k)


def prototypes(df: DataFrame, keys: list[str], k: int = 10, item: str = "vec_id") -> DataFrame:
    """Unit mean of each key's k samples that are largest by confidence times face size."""
    size = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return centroid(top_k(df, keys, k, F.desc(F.col("conf") * size), F.col(item)), keys).withColumnRenamed("centroid", "prototype")


def set_similarity(rows: DataFrame, wanted: DataFrame, k: int, key: str = "track_id", block: int = 2 * BLOCK) -> DataFrame:
    """key, other and sim of the wanted pairs (key, other) of sets: the mean of the k largest products of their unit vectors ``u``.

    Sets are dealt to blocks; a matrix product for each two blocks of a wanted pair, of which only the k largest come out.  A row without a whole
    vector takes no part.
    """
    usable = rows.select(key, F.xxhash64("vec_id").alias("_h"), F.col("u").alias("_u")).filter(whole("_u"))
    sizes = usable.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    size = lambda c, n: sizes.select(F.col(key).alias(c), F.col("_n").alias(n))
    pairs_ = wanted.select(key, "other").distinct().join(size(key, "_m"), key).join(size("other", "_k"), "other")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = usable.join(sizes, key).withColumn("_at", F.pmod("_h", "_n").cast("int"))
    left = dealt.select(key, "_u", F.col("_at").alias("_i")).join(pairs_, key).withColumn("_j", every("_k")).select(key, "other", "_i", "_j", "_u")
    right = dealt.select(F.col(key).alias("other"), F.col("_u").alias("_v"), F.col("_at").alias("_j")).join(pairs_, "other").withColumn("_i", every("_m")).select(key, "other", "_i", "_j", "_v")
    names = [key, "other"]

    def run(some: pa.Table, others: pa.Table) -> pa.Table:
        if not some.num_rows or not others.num_rows:
            return pa.table({key: (some if some.num_rows else others)[key].slice(0, 0), "other": (some if some.num_rows else others)["other"].slice(0, 0), "sim": pa.array([], pa.float64())})
        x, y, top = _matrix(some, "_u"), _matrix(others, "_v"), np.zeros(0)
        for at in range(0, len(x), 512):
            top = np.concatenate([top, (x[at : at + 512] @ y.T).ravel()])
            top = np.partition(top, -k)[-k:] if len(top) > k else top
        return pa.table({c: some[c].take(pa.array(np.zeros(len(top), np.int64))) for c in names} | {"sim": pa.array(top)})

    kinds = _schema(wanted.select(key, "other"))
    on = [*names, "_i", "_j"]
    best = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, f"{kinds}, sim double")
    return top_k(best, names, k, F.desc("sim")).groupBy(*names).agg(F.avg("sim").alias("sim"))


def frame_confidence(frames: DataFrame, bank: DataFrame, low: float, margin_low: float = 0.08, key: str = "vec_id") -> DataFrame:
    """frame_conf, frame_margin, frame_low and frame_conflict of each frame (key, identity, embedding, and maybe centroid, of its cluster).

    The frame's own similarity is the best to its identity's prototypes, without any that to its cluster's centroid, without one zero.  It
    conflicts if there is a competitor and the margin to the best is under ``margin_low``.  A frame without a vector counts as zero.
    """
    unit = frames.withColumn("_u", F.when(F.size("embedding") > 0, l2_normalise("embedding")))
    protos = bank.withColumn("embedding", l2_normalise("embedding"))
    sims = identity_sims(unit.filter("_u is not null"), protos, [key], "_u")
    names = bank.select(F.col("identity").alias("label")).distinct()
    blank = unit.filter("_u is null").select(key).crossJoin(F.broadcast(names)).withColumn("sim", F.lit(0.0))  # names: at most one a prototype
    own = F.max(F.when(F.col("label") == F.col("identity"), F.col("sim")))
    other = F.max(F.when(~F.col("label").eqNullSafe(F.col("identity")), F.col("sim")))
    to_centre = dot("_u", "centroid") if "centroid" in frames.columns else F.lit(None).cast("double")
    each = unit.select(key, "identity", to_centre.alias("to_centre")).join(sims.unionByName(blank), key, "left")
    rows = each.groupBy(key).agg(F.coalesce(own, F.max("to_centre"), F.lit(0.0)).alias("frame_conf"), other.alias("other"))
    margin = F.col("frame_conf") - F.coalesce("other", F.lit(0.0))
    return rows.select(key, "frame_conf", margin.alias("frame_margin"), (F.col("frame_conf") < low).alias("frame_low"), (F.col("other").isNotNull() & (margin < margin_low)).alias("frame_conflict"))


def track_confidence(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """Roll-up of frames (track_id, frame_conf, frame_margin, frame_low, frame_conflict) for every track; zeros without frames."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    stats = frames.groupBy("track_id").agg(
        F.count("*").alias("n_frames"), F.percentile("frame_conf", F.lit(0.25)).alias("p25"), F.avg("frame_conf").alias("mean"), F.min("frame_conf").alias("least"), F.var_pop("frame_conf").alias("var"),
        F.avg("frame_margin").alias("margin"), F.percentile("frame_margin", F.lit(0.25)).alias("margin_p25"), F.avg(F.col("frame_conflict").cast("int")).alias("conflict_frac"), F.count_if("frame_low").alias("low"),
    )
    doubles = ("p25", "mean", "least", "var", "margin", "margin_p25", "conflict_frac")
    whole = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return tracks.join(stats, "track_id", "left").select(*tracks.columns, whole("n_frames"), *[zero(c).alias(c) for c in doubles], whole("low"))


def cohesion(df: DataFrame, keys: list[str], vector: str = "centroid") -> DataFrame:
    """Mean similarity of the pairs of a key's unit vectors (1 for a single one), from the length of their sum: no pairs are made."""
    sums = df.filter(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("_at", "_x")).groupBy(*keys, "_at").agg(F.sum("_x").alias("_s"), F.count("*").alias("_n"))
    whole = sums.groupBy(*keys).agg(F.max("_n").alias("_n"), F.sum(F.col("_s") * F.col("_s")).alias("_q"))
    return whole.select(*keys, F.when(F.col("_n") == 1, 1.0).otherwise((F.col("_q") - F.col("_n")) / (F.col("_n") * (F.col("_n") - 1))).alias("pairwise_sim"))


def _contam() -> Column:
    return F.when(F.sum("n_frames") > 0, F.sum(F.col("conflict_frac") * F.col("n_frames")) / F.sum("n_frames")).otherwise(0.0)


def cluster_confidence(members: DataFrame, metrics: DataFrame, centroids: DataFrame) -> DataFrame:
    """cluster_id, name, tracks, p25_median, p25_min, contam and pairwise_sim of members (cluster_id, name, track_id), metrics of tracks and
    their centroids (track_id, centroid).  Zeros for a cluster without any."""
    rows = members.join(metrics, "track_id", "left").groupBy("cluster_id", F.coalesce("name", F.lit("Unknown")).alias("name"))
    stats = rows.agg(F.count("n_frames").alias("tracks"), F.percentile("p25", F.lit(0.5)).alias("p25_median"), F.min("p25").alias("p25_min"), _contam().alias("contam"))
    alike = cohesion(members.join(centroids, "track_id"), ["cluster_id"])
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return stats.join(alike, "cluster_id", "left").select("cluster_id", "name", "tracks", zero("p25_median"), zero("p25_min"), "contam", zero("pairwise_sim"))


def person_confidence(members: DataFrame, metrics: DataFrame) -> DataFrame:
    """person, n_clusters, n_tracks, p25_median, contam and margin (median over tracks with frames) of each named person."""
    named = members.filter("name is not null and name <> 'Unknown'").join(metrics, "track_id")
    return named.groupBy(F.col("name").alias("person")).agg(
        F.countDistinct("cluster_id").alias("n_clusters"), F.count("*").alias("n_tracks"), F.percentile("p25", F.lit(0.5)).alias("p25_median"), _contam().alias("contam"),
        F.coalesce(F.percentile(F.when(F.col("n_frames") > 0, F.col("margin")), F.lit(0.5)), F.lit(0.0)).alias("margin"),
    )


def silhouette(df: DataFrame, item: str = "vec_id", label: str = "label") -> DataFrame:
    """Silhouette of each row by cosine distance, from sums of unit vectors by label: no pairs are made."""
    unit = df.select(item, label, l2_normalise("embedding").alias("u"))
    sums = unit.select(label, F.posexplode("u").alias("at", "x")).groupBy(label, "at").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    sums = sums.groupBy(F.col(label).alias("other")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s"))).alias("t")).select("other", "n", F.col("t.s").alias("t"))
    met = products(unit, sums, "u", "t").withColumnRenamed("sim", "d")
    own = F.max(F.when(F.col("other") == F.col(label), F.when(F.col("n") > 1, 1 - (F.col("d") - 1) / (F.col("n") - 1))))
    rest = F.min(F.when(F.col("other") != F.col(label), 1 - F.col("d") / F.col("n")))
    rows = met.groupBy(item, label).agg(own.alias("a"), rest.alias("b"))
    worth = (F.col("b") - F.col("a")) / F.greatest("a", "b")
    return rows.select(item, label, F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise(worth).alias("silhouette"))


def impurity(df: DataFrame, outlier: float, margin: float, label: str = "label") -> DataFrame:
    """Share of each label's rows that lie far from its centroid or nearer to another's."""
    unit = df.select("vec_id", label, l2_normalise("embedding").alias("u"))
    centres = centroid(df, [label]).select(F.col(label).alias("other"), "centroid")
    met = products(unit, centres, "u", "centroid").withColumnRenamed("sim", "s")
    rows = met.groupBy("vec_id", label).agg(F.max(F.when(F.col("other") == F.col(label), F.col("s"))).alias("own"), F.greatest(F.lit(0.0), F.max(F.when(F.col("other") != F.col(label), F.col("s")))).alias("best_other"))
    far, cross = F.col("own") < outlier, F.col("best_other") - F.col("own") >= margin
    return rows.groupBy(label).agg(F.count("*").alias("n"), F.count_if(far).alias("outliers"), F.count_if(cross).alias("cross"), ((F.count_if(far) + F.count_if(cross)) / F.count("*")).alias("impurity"))


def nearest_distances(df: DataFrame, k: int) -> DataFrame:
    """Each vector's distance (1 - similarity) to its k-th nearest, itself counted as the first."""
    files = blocks.stored(df.select("vec_id", l2_normalise("embedding").alias("u")).filter(whole("u")), "vec_id", "u")
    if files is None:
        return df.select("vec_id", F.lit(0.0).alias("kth")).limit(0)
    found = blocks.kth_nearest(df.sparkSession, files, k)
    files.drop()
    return found.select(F.col("item").alias("vec_id"), F.greatest(F.lit(0.0), 1 - F.col("sim")).alias("kth"))


def tuned_radius(df: DataFrame, k: int = 5, low: float = 0.40, high: float = 0.50) -> DataFrame:
    """One row: n, percentiles of the distances to the k-th nearest (p25, p50, p75, p90), knee_index (how many lie under p75) and eps, p75 within bounds."""
    kth = nearest_distances(df, k + 1)
    figures = kth.agg(F.count("*").alias("n"), *[F.percentile("kth", F.lit(share)).alias(f"p{round(100 * share)}") for share in (0.25, 0.5, 0.75, 0.9)])
    under = kth.crossJoin(F.broadcast(figures.select("p75"))).agg(F.count_if(F.col("kth") < F.col("p75")).alias("knee_index"))  # one row
    return figures.crossJoin(F.broadcast(under)).withColumn("eps", F.least(F.lit(high), F.greatest(F.lit(low), "p75")))


def near_links(df: DataFrame, eps: float) -> DataFrame:
    """(a, b, sim) of vectors within a cosine distance of ``eps``, a < b.

    Vectors of zero length, null ones and those that hold a null are near to none.
    """
    unit = df.select("vec_id", l2_normalise("embedding").alias("u")).filter(whole("u") & F.exists("u", lambda x: x != 0))
    return metric_links(unit, "vec_id", "u", 1 - eps)


def metric_links(unit: DataFrame, item: str, vector: str, least: float, block: int = BLOCK, figures: list | None = None) -> DataFrame:
    """``pairs`` of unit vectors, without those blocks that the triangle inequality rules out.

    Angles are a metric.  A bounded number of pivots (vectors of the table) cut the vectors into cells, each vector at home with its nearest
    pivot, at an angle d.  With R the angle of ``least``: a vector is copied to another cell only if it is within R of the cell's ball and at most
    2 R farther from its pivot than from its own; every pair is then found where its first one is at home.  In a cell, blocks are bands of d: two
    bands that lie more than R apart do not meet.  All this only leaves out what cannot be near; where nothing can be left out (``least`` at or under
    zero, or vectors in no order), it comes to all blocks of pairs.  ``figures`` gets (pairs of blocks that meet, pairs that there are).
    """
    n = unit.count()
    cells = min(MOST_PIVOTS, n // block)
    if cells < 2:
        return pairs(unit, item, vector, least)
    reach = float(np.arccos(np.clip(least, -1.0, 1.0))) + 1e-6
    pivots = np.array([r[0] for r in unit.orderBy(F.xxhash64(item), item).select(vector).limit(cells).collect()])
    shared = unit.sparkSession.sparkContext.broadcast(pivots)
    kind = unit.schema[item].dataType.simpleString()
    angles = lambda x: np.arccos(np.clip(x @ shared.value.T, -1.0, 1.0))

    def homes(batches):
        for batch in batches:
            d = angles(_matrix(pa.Table.from_batches([batch]), vector))
            home = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(d[np.arange(len(home)), home])], ["cell", "d"])

    balls = unit.select(vector).mapInArrow(homes, "cell int, d double").groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("n")).collect()  # a row a pivot at most
    radius = np.full(cells, -1.0)
    bands = np.ones(cells, np.int64)
    for row in balls:
        radius[row["cell"]], bands[row["cell"]] = row["radius"], max(1, -(-row["n"] // block))
    radii = unit.sparkSession.sparkContext.broadcast((radius, bands))

    def placed(batches):
        """A row for each cell that a vector belongs to, with the bands (by angle to the pivot) that it has to meet there."""
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                table = pa.Table.from_batches([part])
                d = angles(_matrix(table, vector))
                radius, bands = radii.value
                home = d.argmin(1)
                own = d[np.arange(len(d)), home][:, None]
                inside = (d <= np.minimum(own + 2 * reach, radius + reach)) | (np.arange(cells) == home[:, None])
                inside &= radius >= 0
                row, cell = np.nonzero(inside)
                width = np.maximum(radius[cell], 1e-9) / bands[cell]
                band = lambda a: np.clip(np.floor(a / width), 0, bands[cell] - 1).astype(np.int64)
                resident = home[row] == cell
                low, high = band(d[row, cell] - reach), band(d[row, cell] + reach)
                values = [table[item].take(pa.array(row)), table[vector].take(pa.array(row)), pa.array(cell, pa.int32()), pa.array(resident), pa.array(band(d[row, cell]), pa.int32()), pa.array(low, pa.int32()), pa.array(high, pa.int32())]
                yield from pa.Table.from_arrays(values, [item, vector, "cell", "resident", "band", "low", "high"]).to_batches()

    checkpoints(unit.sparkSession)
    rows = unit.select(item, vector).mapInArrow(placed, f"{item} {kind}, {vector} array<double>, cell int, resident boolean, band int, low int, high int").checkpoint()
    # the residents of a band, and what has to meet them, are dealt to parts of about a block each
    mine = rows.filter("resident").select(F.col(item).alias("a"), F.col(vector).alias("_va"), F.col("cell").alias("_cell"), F.col("band").alias("_band"))
    theirs = rows.select(F.col(item).alias("b"), F.col(vector).alias("_vb"), F.col("cell").alias("_cell"), F.explode(F.sequence("low", "high")).alias("_band"))
    counted = lambda df, name: df.groupBy("_cell", "_band").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    blocks = counted(mine, "_n").join(counted(theirs, "_m"), ["_cell", "_band"]).checkpoint()
    if figures is not None:
        figures.append((blocks.agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0, (-(-n // block)) ** 2))
    part = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = mine.join(blocks, ["_cell", "_band"]).withColumn("_i", part("a", "_n")).withColumn("_j", each("_m")).drop("_n", "_m")
    right = theirs.join(blocks, ["_cell", "_band"]).withColumn("_j", part("b", "_m")).withColumn("_i", each("_n")).drop("_n", "_m")

    def run(some: pa.Table, others: pa.Table) -> pa.Table:
        if not some.num_rows or not others.num_rows:
            return pa.table({"a": some["a"].slice(0, 0), "b": others["b"].slice(0, 0), "sim": pa.array([], pa.float64())})
        sims = _matrix(some, "_va") @ _matrix(others, "_vb").T
        i, j = np.nonzero(sims >= least)
        return pa.table({"a": some["a"].take(pa.array(i)), "b": others["b"].take(pa.array(j)), "sim": pa.array(sims[i, j])})

    keys = ["_cell", "_band", "_i", "_j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"a {kind}, b {kind}, sim double").filter("a < b")


def connecting(unit: DataFrame, item: str, vector: str, least: float) -> DataFrame:
    """Links (a, b) that connect the same items as all pairs with a similarity of ``least`` do; the pairs are not written."""
    files = blocks.stored(unit.filter(whole(vector)), item, vector)
    if files is None:
        return unit.select(F.col(item).alias("a"), F.col(item).alias("b")).limit(0)
    links = blocks.forest(unit.sparkSession, files, [least])
    files.drop()
    return links.select("a", "b")


def dbscan(df: DataFrame, eps: float, least: int, components, links: DataFrame | None = None) -> DataFrame:
    """vec_id and cluster (-1 for noise) by cosine distance; ``least`` counts the point itself.

    Clusters are numbered by their smallest member; a border point that several reach goes to the one with the smallest core.
    ``components`` turns links (a, b) into (node, component).  ``links`` may hold ``near_links`` of a larger radius; without them, near pairs are
    gone through twice and not written (``dbscans``).
    """
    if links is None:
        return dbscans(df, [eps], least, components)[0]
    near = links.filter(F.col("sim") >= 1 - eps).select("a", "b")
    checkpoints(df.sparkSession)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    core = both.groupBy("a").count().filter(F.col("count") + 1 >= least).select(F.col("a").alias("core"))
    core = (df.select(F.col("vec_id").alias("core")) if least <= 1 else core).checkpoint()
    inner = both.join(core, F.col("a") == F.col("core"), "left_semi").join(core, F.col("b") == F.col("core"), "left_semi")
    rim = both.join(core, F.col("a") == F.col("core"), "left_anti").join(core, F.col("b") == F.col("core"), "left_semi")
    return _clustered(df, core, inner, rim, components)


def dbscans(df: DataFrame, radii: list[float], least: int, components) -> list[DataFrame]:
    """``dbscan`` for each radius.  Near pairs are gone through once to count them and once for links that connect cores, for all radii together."""
    spark = checkpoints(df.sparkSession)
    ends = df.select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b")).limit(0)
    unit = df.select("vec_id", l2_normalise("embedding").alias("u")).filter(whole("u") & F.exists("u", lambda x: x != 0))
    files = blocks.stored(unit, "vec_id", "u")
    if files is not None:
        sims = [1 - eps for eps in radii]
        marked, near = blocks.counted(spark, files, sims)
        files.drop()
        links = blocks.forest(spark, marked, sims, least - 1)
        marked.drop()
    out = []
    for n in range(len(radii)):
        if files is None:
            core, inner, rim = ends.select(F.col("a").alias("core")), ends, ends
        else:
            core = near.filter(F.col("near")[n] + 1 >= least).select(F.col("item").alias("core"))
            inner, rim = (links.filter((F.col("n") == n) & (F.col("inner") == kind)).select("a", "b") for kind in (True, False))
        core = df.select(F.col("vec_id").alias("core")) if least <= 1 else core
        out.append(_clustered(df, core, inner, rim, components))
    return out


def _clustered(df: DataFrame, core: DataFrame, inner: DataFrame, rim: DataFrame, components) -> DataFrame:
    """Clusters of cores, of links between them (``inner``) and of links from border points (a) to cores (b)."""
    placed = core.join(components(inner), F.col("core") == F.col("node"), "left").select("core", F.coalesce("component", "core").alias("root"))
    border = rim.join(placed, F.col("b") == F.col("core")).groupBy("a").agg(F.min("root").alias("root"))
    members = placed.select(F.col("core").alias("vec_id"), "root").unionByName(border.select(F.col("a").alias("vec_id"), "root"))
    numbers = numbered(members.groupBy("root").agg(F.min("vec_id").alias("first")), "first", "cluster")
    return df.select("vec_id").join(members.join(numbers, "root"), "vec_id", "left").select("vec_id", F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"))


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``name``: numbers from 0 without gaps by a column of distinct values; ranges are numbered side by side, from their counts."""
    checkpoints(rows.sparkSession)
    dealt = rows.repartitionByRange(order).withColumn("_span", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("_span").agg(F.count("*").alias("_n"))
    bases = counts.select("_span", F.coalesce(F.sum("_n").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # one row a range
    inner = F.row_number().over(Window.partitionBy("_span").orderBy(order)) - 1
    placed = dealt.withColumn("_inner", inner).join(F.broadcast(bases), "_span")
    return placed.select(*rows.columns, (F.col("_base") + F.col("_inner")).alias(name))
