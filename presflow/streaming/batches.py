"""The adaptive merge of a stream, settled a batch at a time by the batch operators, so that a batch is spread over all tasks.

``ordered.merged`` settles an episode's rows in one task; for episodes of millions of tracks that takes too long.  Here the state between batches is
a table: what waits for the watermark, the open interval of each person, and what is in sight of gaps that may still come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals as I
from ..session import checkpoints

_ROW = ["person", "start_ms", "end_ms", "conf", "visible", "frames", "members"]


def merged(stream: DataFrame, folder: str, params: I.MergeParams = I.MergeParams(), tie: str = "track_id", late_ms: int = 600_000) -> DataFrame:
    """Reads the stream to its end and gives the rows of ``ordered.merged`` (without keys), which lie in ``folder``.

    A batch that is run again writes the same folders anew.  Rows that start before the watermark (the latest start less ``late_ms``) of the batches before are left
    out, as are those with a null.
    """
    spark = checkpoints(stream.sparkSession)
    named = [tie, *_ROW]
    state = lambda n: f"{folder}/state/{n}"

    def step(batch: DataFrame, number: int) -> None:
        kinds = {"start_ms": "bigint", "end_ms": "bigint", "conf": "double", "visible": "double", "frames": "bigint", "members": "bigint"}
        rows = batch.withColumn("members", F.lit(1)).select(tie, "person", *[F.col(c).cast(k).alias(c) for c, k in kinds.items()]).dropna()
        last = settled = None
        if number > 0:
            old = spark.read.parquet(state(number - 1))
            clock = old.filter("kind = 'clock'").first()
            last, settled = (clock["start_ms"], clock["end_ms"]) if clock else (None, None)
            of = lambda kind: old.filter(F.col("kind") == kind).select(*named)
            if last is not None:
                rows = rows.filter(F.col("start_ms") >= last - late_ms)
            if settled is not None:
                rows = rows.filter(F.col("start_ms") > settled)
            rows = rows.unionByName(of("waiting"))
        rows = rows.checkpoint()
        latest = rows.agg(F.max("start_ms")).first()[0]
        last = max((t for t in (last, latest) if t is not None), default=None)
        if last is None:
            rows.withColumn("kind", F.lit("waiting")).write.mode("overwrite").parquet(state(number))
            return
        watermark = last - late_ms
        ready, waiting = rows.filter(F.col("start_ms") <= watermark), rows.filter(F.col("start_ms") > watermark)
        seen = ready.filter(F.col("conf") >= params.conflict_conf)
        settled = max((t for t in (settled, ready.agg(F.max("start_ms")).first()[0]) if t is not None), default=None)
        if number > 0:
            ready, seen = ready.unionByName(of("open")), seen.unionByName(of("seen"))
        steps = I.adaptive_merge(ready, params, tie, seen.select("person", "start_ms", "end_ms"))
        groups = steps.groupBy("person", "merged_id").agg(F.min_by(tie, F.struct("start_ms", tie)).alias(tie), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("conf").alias("conf"), F.max("visible").alias("v"), F.max("frames").alias("f"), F.sum("members").alias("members"))
        alone = F.col("members") == 1
        groups = groups.withColumn("visible", F.when(alone, F.col("v")).otherwise(0.0)).withColumn("frames", F.when(alone, F.col("f")).otherwise(F.lit(0).cast("bigint"))).checkpoint()
        ends = groups.groupBy("person").agg(F.max("merged_id").alias("_last"))  # a row a person
        told = groups.join(ends, "person").withColumn("open", (F.col("merged_id") == F.col("_last")) & (F.col("end_ms") + params.reach >= watermark))
        told.filter("not open").select(*_ROW).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        clock = spark.range(1).select(F.lit(None).cast(rows.schema[tie].dataType).alias(tie), F.lit(None).cast("string").alias("person"), F.lit(last).cast("bigint").alias("start_ms"), F.lit(settled).cast("bigint").alias("end_ms"), F.lit(None).cast("double").alias("conf"), F.lit(None).cast("double").alias("visible"), F.lit(None).cast("bigint").alias("frames"), F.lit(None).cast("bigint").alias("members"))
        parts = {"waiting": waiting, "open": told.filter("open").select(*named), "seen": seen.filter(F.col("end_ms") > watermark - params.reach), "clock": clock}
        every = None
        for kind, part in parts.items():
            part = part.select(*named).withColumn("kind", F.lit(kind))
            every = part if every is None else every.unionByName(part)
        every.write.mode("overwrite").parquet(state(number))

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    schema = "person string, start_ms bigint, end_ms bigint, conf double, visible double, frames bigint, members bigint"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")  # there may have been no batch
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/out").select(*_ROW)
