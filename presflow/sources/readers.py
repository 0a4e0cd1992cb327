"""Readers of stored artifacts: parquet with a fallback, JSON documents, JSON lines, CSV, binary files, frame grids."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import versions

TRACKS_SCHEMA = (
    "tracks array<struct<track_id:bigint,start_ms:bigint,end_ms:bigint,duration_ms:bigint,count:int,stitch_score:double,mean_confidence:double,global_id:string,person_name:string,"
    "frame_refs:array<struct<frame_id:bigint,det_idx:int,bbox:array<int>,confidence:double,ts_ms:bigint,global_id:string>>>>"
)
CLUSTERS_SCHEMA = "clusters array<struct<cluster_id:bigint,size:int,track_ids:array<bigint>,variance:double,silhouette_score:double,quality_score:double,is_lowconf:boolean,name:string,assignment_confidence:double,assignment_margin:double>>"
TOTALS_SCHEMA = "person_name string, total_ms bigint, total_sec double, appearances bigint, first_ms bigint, last_ms bigint, mean_confidence double, percent double"
TIMELINE_SCHEMA = "person_name string, start_ms bigint, end_ms bigint, duration_ms bigint, source string, confidence double, frame_count int, visible_fraction double"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def first_of(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The first parquet table of those that exist (picked samples before all embeddings, say)."""
    return next((spark.read.parquet(p) for p in paths if exists(spark, p)), None)


def document(spark: SparkSession, path: str, schema: str, rows: str) -> DataFrame | None:
    """Rows of an array in JSON documents; None if the document is missing."""
    if not exists(spark, path):
        return None
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).select(F.explode(rows).alias("r")).select("r.*")


def tracks(spark: SparkSession, path: str) -> DataFrame | None:
    return document(spark, path, TRACKS_SCHEMA, "tracks")


def clusters(spark: SparkSession, path: str) -> DataFrame | None:
    return document(spark, path, CLUSTERS_SCHEMA, "clusters")


def repaired(tracks_: DataFrame) -> DataFrame:
    """Tracks without a start or an end get them from their frames; those without frames either go."""
    ts = F.filter("frame_refs.ts_ms", lambda t: t.isNotNull())
    fixed = tracks_.withColumn("start_ms", F.coalesce("start_ms", F.array_min(ts))).withColumn("end_ms", F.coalesce("end_ms", F.array_max(ts)))
    return fixed.filter("start_ms is not null and end_ms is not null")


def metrics(spark: SparkSession, path: str, schema: str, rows: str, key: str) -> DataFrame:
    """Rows of a metrics document; an empty table with the key column alone, of its type, if there are none."""
    found = document(spark, path, schema, rows)
    if found is not None and not found.isEmpty():
        return found
    return spark.createDataFrame([], schema).select(F.explode(rows).alias("r")).select(f"r.{key}")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank and malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def timeline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMELINE_SCHEMA).option("header", True).csv(path)


def totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOTALS_SCHEMA).option("header", True).csv(path)


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows whose JSON in ``column`` becomes columns of the schema; malformed JSON gives nulls."""
    return rows.withColumn("_j", F.from_json(column, schema)).select(*[c for c in rows.columns if c != column], "_j.*")


def merged_config(base: dict, over: dict) -> dict:
    """Deep merge; where both have a value that is not a mapping, the second wins."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged_config(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def config(spark: SparkSession, *paths: str, parse: Callable[[str], dict] = json.loads) -> dict:
    """Settings of small text files (JSON unless ``parse`` says otherwise), later ones over earlier ones."""
    out: dict = {}
    for path in paths:
        out = merged_config(out, parse(spark.read.text(path, wholetext=True).first()[0]))
    return out


def sampled_frames(spark: SparkSession, frames: int, fps: float, stride_ms: int) -> DataFrame:
    """Frames of a video that a stride keeps: frame_id, ts_ms."""
    stride = max(1, int(stride_ms / 1000 * fps))
    return spark.range(0, frames, stride).select(F.col("id").alias("frame_id"), (F.col("id") / F.lit(float(fps)) * 1000).cast("bigint").alias("ts_ms"))


def new_files(spark: SparkSession, folder: str, known: DataFrame, pattern: str = "*.mp4") -> DataFrame:
    """Files of a folder that a registry (path) does not have: path, modified and length; contents are not read."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    except AnalysisException:
        return spark.createDataFrame([], "path string, modified timestamp, length bigint")
    return found.select("path", F.col("modificationTime").alias("modified"), "length").join(known.select("path"), "path", "left_anti")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """path, row, embedding and quality (1 where there is none) of .npy files, and of .npz files that hold ``embeddings`` and maybe ``qualities``."""

    def rows(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = np.load(io.BytesIO(content), allow_pickle=False)
                packed = name.endswith(".npz")
                matrix = np.atleast_2d(found["embeddings"] if packed else found)
                quality = found["qualities"] if packed and "qualities" in found else np.ones(len(matrix))
                yield pd.DataFrame({"path": name, "row": range(len(matrix)), "embedding": [v.astype(float).tolist() for v in matrix], "quality": quality.astype(float)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").load(path).select("path", "content")
    return files.mapInPandas(rows, "path string, row bigint, embedding array<double>, quality double")


def label_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Vectors (label, embedding) and figures (label, centroid, count, mean_dist, m2) of a stored index; None if there is none."""
    number = versions.latest(spark, path)
    return (versions.table(spark, path, "vectors", number), versions.table(spark, path, "labels", number)) if number else None
