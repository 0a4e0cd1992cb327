"""Append-only logs: identity events, rolling figures, episode tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoints


def reattachments(log: DataFrame) -> DataFrame:
    """label, frame and latency of reattachments whose previous event of the label is a drop: a drop is consumed once."""
    w = Window.partitionBy("label").orderBy("frame", "event_id")
    seen = log.filter(F.col("decision").isin("drop", "reattach"))
    seen = seen.withColumn("before", F.lag("decision").over(w)).withColumn("since", F.lag("frame").over(w))
    return seen.filter((F.col("decision") == "reattach") & (F.col("before") == "drop")).select("label", "frame", (F.col("frame") - F.col("since")).alias("latency"))


def identity_metrics(events: DataFrame, fps: float = 30.0) -> DataFrame:
    """One row of figures of identity events (event_id, frame, label_before, label_after, reason): confirmations are right, switches are
    wrong, drops are missed; switches a minute; mean and 95th percentile of frames from a drop to the reattachment of its label.
    """
    named = lambda c: F.col(c).isNotNull() & (F.col(c) != "UNK")
    told = F.col("reason")
    sums = events.agg(
        F.count("*").alias("events"), F.count_if(told.isin("join_confirmed", "promote_confirm", "reattach") & named("label_after")).alias("tp"), F.count_if(told == "switch").alias("fp"), F.count_if(told == "drop_exit").alias("fn"),
        F.greatest((F.max("frame") - F.min("frame")) / (fps * 60), F.lit(1e-6)).alias("minutes"),
    )
    dropped = events.filter((told == "drop_exit") & named("label_before")).select("event_id", "frame", F.col("label_before").alias("label"), F.lit("drop").alias("decision"))
    back = events.filter((told == "reattach") & named("label_after")).select("event_id", "frame", F.col("label_after").alias("label"), F.lit("reattach").alias("decision"))
    late = reattachments(dropped.unionByName(back)).agg(F.avg("latency").alias("latency_mean"), F.percentile("latency", F.lit(0.95)).alias("latency_p95"))
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("fp")), ratio(F.col("tp"), F.col("fn"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    rounded = lambda c, name: F.bround(c, 4).alias(name)
    return sums.crossJoin(late).select("events", rounded(f1, "id_f1"), rounded(p, "precision"), rounded(r, "recall"), rounded(F.col("fp") / F.col("minutes"), "switches_per_min"), "latency_mean", "latency_p95")  # one row each


def exclusive_quantile(values: Column, share: float) -> Column:
    """Quantile at position share * (n + 1) of a sorted array, between neighbours; the largest below three values."""
    n = F.size(values)
    at = share * (n + 1)
    j = F.least(F.greatest(F.floor(at).cast("int"), F.lit(1)), n - 1)
    lower, upper = F.element_at(values, j), F.element_at(values, j + 1)
    return F.when(n < 3, F.element_at(values, -1)).otherwise(lower + (upper - lower) * (at - j))


def rolling(df: DataFrame, keys: list[str], order: str, value: str, rows: int = 10) -> DataFrame:
    """median and p90 of each row's last ``rows`` values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    got = df.withColumn("_v", F.sort_array(F.collect_list(value).over(w)))
    middle = (F.element_at("_v", F.floor((F.size("_v") + 1) / 2).cast("int")) + F.element_at("_v", F.floor(F.size("_v") / 2 + 1).cast("int"))) / 2
    return got.select(*keys, order, F.size("_v").alias("samples"), middle.alias("median"), exclusive_quantile(F.col("_v"), 0.9).alias("p90"))


def running_stats(df: DataFrame, keys: list[str], order: str, value: str, alpha: float, width: int = 1024, fan: int = 64) -> DataFrame:
    """keys, ema (from the first value), n, mean and sigma (sample deviation) of a key's values in order; rows with a null are left out.

    A step of the exponential mean is the map m -> a m + b, and maps compose; so a bin of ``width`` of the order becomes one map, with
    mergeable moments beside it, and ``fan`` neighbours become one again, until a key has one.  No more than ``fan`` rows of a key, or a bin's, come together.
    """
    checkpoints(df.sparkSession)
    rows = df.select(*keys, order, F.col(value).cast("double").alias("_x")).filter(F.col(order).isNotNull() & F.col("_x").isNotNull())
    held = rows.groupBy(*keys, F.floor(F.col(order) / width).alias("_at")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_x").alias("x")))).alias("_r"))
    one = lambda x: F.struct(F.lit(1 - alpha).alias("a"), (alpha * x).alias("b"), F.lit(1).cast("bigint").alias("n"), x.alias("mean"), F.lit(0.0).alias("m2"), x.alias("first"))

    def after(s: Column, t: Column) -> Column:
        n, apart = s["n"] + t["n"], t["mean"] - s["mean"]
        mean = s["mean"] + apart * t["n"] / n
        return F.struct((s["a"] * t["a"]).alias("a"), (t["a"] * s["b"] + t["b"]).alias("b"), n.alias("n"), mean.alias("mean"), (s["m2"] + t["m2"] + apart * apart * s["n"] * t["n"] / n).alias("m2"), s["first"].alias("first"))

    whole = lambda maps: F.aggregate(F.slice(maps, 2, F.size(maps)), F.element_at(maps, 1), after)
    maps = held.select(*keys, "_at", whole(F.transform("_r", lambda r: one(r["x"]))).alias("_m")).checkpoint()
    while not maps.groupBy(*keys).count().filter("count > 1").isEmpty():
        near = maps.groupBy(*keys, F.floor(F.col("_at") / fan).alias("_up")).agg(F.sort_array(F.collect_list(F.struct("_at", "_m"))).alias("_r"))
        maps = near.select(*keys, F.col("_up").alias("_at"), whole(F.transform("_r", lambda r: r["_m"])).alias("_m")).checkpoint()
    m = lambda c: F.col(f"_m.{c}")
    return maps.select(*keys, (m("a") * m("first") + m("b")).alias("ema"), m("n").alias("n"), m("mean").alias("mean"), F.when(m("n") > 1, F.sqrt(m("m2") / (m("n") - 1))).otherwise(0.0).alias("sigma"))


def histogram(df: DataFrame, value: Column, low: Column, high: Column, bins: int) -> DataFrame:
    """Counts of equal bins of [low, high]; the last is closed on the right.  Values outside are left out."""
    width = (high - low) / bins
    at = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
    return df.filter(value.between(low, high)).groupBy(at.alias("bin")).count()


def tail(df: DataFrame, order: str, n: int = 50) -> DataFrame:
    """The newest n rows, newest first."""
    return df.orderBy(F.desc(order)).limit(n)


def needs_step(steps: DataFrame) -> DataFrame:
    """Whether a step must run: its output is missing or older than one of its inputs.  Rows (step, output_at, inputs)."""
    newest = F.aggregate("inputs", F.lit(None).cast("bigint"), lambda m, x: F.greatest(F.coalesce(m, x), x))
    return steps.select("step", (F.col("output_at").isNull() | F.coalesce(newest > F.col("output_at"), F.lit(False))).alias("needed"))


def expired(files: DataFrame, now: Column, days: int) -> DataFrame:
    """Files whose last change (``changed``, a timestamp) is more than ``days`` ago."""
    return files.filter(F.col("changed") < now - F.make_dt_interval(F.lit(days)))


def missing_chunks(uploads: DataFrame, received: DataFrame) -> DataFrame:
    """(upload_id, chunk) that have not come; uploads (upload_id, chunks), received (upload_id, chunk)."""
    wanted = uploads.filter("chunks > 0").select("upload_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    return wanted.join(received, ["upload_id", "chunk"], "left_anti")


def assembled(uploads: DataFrame, received: DataFrame) -> DataFrame:
    """upload_id, n_bytes, sha256 (of the chunks in order) and status of each upload: ``missing`` chunks, ``mismatch`` with the digest that was told, or ``ok``.

    uploads (upload_id, chunks, sha256; null: none was told, and what came is taken), received (upload_id, chunk, at, data).  Of a chunk that was sent again the
    newest counts (of one time the largest data); chunks beyond ``chunks`` and of unknown uploads don't.  Null data is an empty chunk.  With chunks
    missing, n_bytes and sha256 are null.  Repeated rows of an upload count once.  Chunks are dealt by upload and stream through its task in order, one batch in memory.
    """
    told = uploads.filter("upload_id is not null").dropDuplicates(["upload_id"]).select("upload_id", F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"), F.lower("sha256").alias("told"))
    newest = F.row_number().over(Window.partitionBy("upload_id", "chunk").orderBy(F.desc_nulls_last("at"), F.desc_nulls_last("data")))
    rows = received.select("upload_id", F.col("chunk").cast("bigint").alias("chunk"), "at", F.col("data").cast("binary").alias("data"))
    rows = rows.join(told.select("upload_id", "chunks"), "upload_id").filter("chunk >= 0 and chunk < chunks").withColumn("_n", newest).filter("_n = 1").select("upload_id", "chunk", "data")
    kind = rows.schema["upload_id"].dataType.simpleString()

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, running, n, size = None, hashlib.sha256(), 0, 0
        for frame in frames:
            done = []
            for upload, data in zip(frame["upload_id"], frame["data"], strict=True):
                if upload != at:
                    if n:
                        done.append((at, n, size, running.hexdigest()))
                    at, running, n, size = upload, hashlib.sha256(), 0, 0
                running.update(data or b"")
                n, size = n + 1, size + len(data or b"")
            yield pd.DataFrame(done, columns=["upload_id", "came", "n_bytes", "sha256"])
        if n:
            yield pd.DataFrame([(at, n, size, running.hexdigest())], columns=["upload_id", "came", "n_bytes", "sha256"])

    sums = rows.repartition("upload_id").sortWithinPartitions("upload_id", "chunk").mapInPandas(digest, f"upload_id {kind}, came bigint, n_bytes bigint, sha256 string")
    out = told.join(sums, "upload_id", "left")
    whole = F.coalesce("came", F.lit(0)) == F.col("chunks")
    nothing = F.col("chunks") == 0
    value = lambda c, empty: F.when(nothing, F.lit(empty)).when(whole, F.col(c)).alias(c)
    out = out.select("upload_id", "told", whole.alias("_whole"), value("n_bytes", 0), value("sha256", hashlib.sha256().hexdigest()))
    status = F.when(~F.col("_whole"), "missing").when(F.col("told").isNotNull() & (F.col("told") != F.col("sha256")), "mismatch").otherwise("ok")
    return out.select("upload_id", F.col("n_bytes").cast("bigint").alias("n_bytes"), "sha256", status.alias("status"))
