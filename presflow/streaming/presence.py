"""Streams of observations: windows, sessions, and re-identification with state.

Sources are files or any other streaming reader; observations older than the watermark are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.tracking import Reidentifier, ReidParams, decisions

LATE = "10 minutes"


def observations(spark: SparkSession, folder: str, schema: str, files_at_once: int = 50) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed(stream: DataFrame, ts: str, keys: list[str], width: str, hop: str | None = None, late: str = LATE) -> DataFrame:
    """Counts and mean value by tumbling (or hopping) window."""
    window = F.window(ts, width, hop) if hop else F.window(ts, width)
    grouped = stream.withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return grouped.select("w.start", "w.end", *keys, "n", "mean")


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str, late: str = LATE) -> DataFrame:
    """Point observations merged while gaps stay within ``gap``."""
    grouped = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
    return grouped.select("w.start", "last", *keys, "n")


def identities(stream: DataFrame, seeds: list[tuple[str, list[float]]], params: ReidParams = ReidParams(), ts: str | None = None, late: str = LATE, keep_ms: int = 3_600_000) -> DataFrame:
    """Identity decisions of a stream (episode_id, frame_id, track_id, embedding); an episode's labels, centroids and tracks are its state.

    A frame's rows come in one file.  With a time column ``ts`` the state of an episode is dropped ``keep_ms`` after its last row, by the
    watermark; without one it is kept.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            reid = pickle.loads(state.get[0])
        else:
            reid = Reidentifier(params)
            for label, vector in seeds:
                reid.seed(label, vector)
        rows = pd.concat(frames)  # Arrow cuts a group at any row
        out = decisions(reid, rows)
        out.insert(0, "episode_id", key[0])
        yield out[["episode_id", "frame", "track_id", "label_after", "status_after", "reason"]]
        state.update((pickle.dumps(reid),))
        if ts:
            last = int(rows[ts].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1) + keep_ms)

    fields = "episode_id bigint, frame bigint, track_id bigint, label_after string, status_after string, reason string"
    timed = stream.withWatermark(ts, late) if ts else stream
    return timed.groupBy("episode_id").applyInPandasWithState(run, fields, "state binary", "append", "EventTimeTimeout" if ts else "NoTimeout")


class Progress(StreamingQueryListener):
    """Passes (query id, batch, rows in, rows a second) of every batch on, and the error (or none) with which a query ends."""

    def __init__(self, report: Callable[[str, int, int, float], None], ended: Callable[[str, str | None], None] = lambda query, error: None):
        self.report, self.ended = report, ended

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.report(str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended(str(event.id), event.exception)


def to_table(stream: DataFrame, folder: str, checkpoint: str):
    """Writes a stream as Parquet and goes on where it left off when started again with the same checkpoint folder."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
