"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoints

_TIDY, _ADAPTIVE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.adaptive.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, an action's shuffle files go as soon as the action has ended."""
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def cut(df: DataFrame, dealt: bool = False) -> DataFrame:
    """The frame written to the shared checkpoint folder and read back: lineage ends there, lost executors cost nothing, and its shuffles go.

    ``dealt``: what is read back is known to be dealt as the frame was, so joins and groups by the same key move none of its rows.
    Plans of adaptive execution do not tell that, so the frame is made without it; joins in it find no help against skew.
    """
    spark = df.sparkSession
    before = spark.conf.get(_ADAPTIVE)
    with tidy(checkpoints(spark)):
        spark.conf.set(_ADAPTIVE, "false" if dealt else before)
        try:
            return df.select("*").checkpoint(eager=True)  # what cleans up is settled when a frame is made
        finally:
            spark.conf.set(_ADAPTIVE, before)


_claims: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """Said by an operator that keeps tables in a worker between batches: those of others go first.

    Workers are used again by later stages, so without this the tables of all operators of a pipeline would add up.
    """
    if name not in _claims or len(_claims) > 1:
        for other in [x for x in _claims if x != name]:
            _claims.pop(other)()
        _claims[name] = clear
        gc.collect()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
            trim(0)  # what is free goes back to the system


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc_mod5(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5
