"""Streams whose rows are settled in order of event time: the tracker and the adaptive merge, with keyed state.

Rows wait in the state until the watermark has passed their time; then all that came before them has come, in whatever files
and order, and they are settled as the batch operators settle them.  Rows that come later than the watermark allows are left out.
State is kept by RocksDB (set when a stream is made) and goes on from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.intervals import MERGES, MergeParams, merge_step
from ..operators.tracking import Tracker, TrackerParams
from .presence import LATE

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed their time, then settles them in order; a timer stands at what is due next."""

    fields: str
    #: Between event time and the times of rows: what lies at the epoch counts as late from the start.
    shift = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.clock = handle.getValueState("clock", "timer bigint, last bigint, settled bigint")  # the earliest timer, the latest row, the latest that was settled

    def rows_of(self, frame: pd.DataFrame) -> list[tuple]:
        """Tuples of ``fields``, the time first."""
        raise NotImplementedError

    def settle(self, key: tuple, rows: list[tuple], watermark: int) -> pd.DataFrame:
        """What rows, in order, come to; also called without rows."""
        raise NotImplementedError

    def due(self, last: int, watermark: int) -> int | None:
        """When the state has to be looked at though no row waits; none if it may go."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, last, settled = self.clock.get() if self.clock.exists() else (None, None, -(1 << 62))
        watermark = timerValues.getCurrentWatermarkInMs() - self.shift
        came = [row for frame in rows for row in self.rows_of(frame) if row[0] > settled and row[0] >= watermark]
        if came:
            self.waiting.appendList(came)
            first, last = min(r[0] for r in came), max([r[0] for r in came] + ([] if last is None else [last]))
            if timer is None or first < timer:
                timer = max(first, watermark + 1)
                self.handle.registerTimer(timer + self.shift)
            self.clock.update((timer, last, settled))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.clock.exists():
            return
        watermark = timerValues.getCurrentWatermarkInMs() - self.shift
        _, last, settled = self.clock.get()
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready, rest = sorted(r for r in waiting if r[0] <= watermark), [r for r in waiting if r[0] > watermark]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
            settled = ready[-1][0]
        made = self.settle(key, ready, watermark)
        if len(made):
            yield made
        dues = [r[0] for r in rest] + [t for t in [self.due(last, watermark)] if t is not None]
        if dues:
            timer = max(min(dues), watermark + 1)
            self.handle.registerTimer(timer + self.shift)
            self.clock.update((timer, last, settled))
        else:
            self.clock.clear()
            self.forget()

    def close(self) -> None:
        pass


def _millis(frame: pd.DataFrame, ts: str) -> list[int]:
    return (frame[ts].astype("datetime64[us]").astype("int64") // 1000).tolist()


class _Following(_InOrder):
    """State: a map of live tracks, and the number that the next one gets."""

    fields = "at bigint, frame_id bigint, det_idx int, box array<double>, conf double, vector array<double>, scene_end boolean"

    def __init__(self, params: TrackerParams, episode: str, ts: str, scene_end: str | None, keep: int):
        self.params, self.episode, self.ts, self.scene_end, self.keep = params, episode, ts, scene_end, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.tracks = handle.getMapState("tracks", "track_id bigint", "box array<double>, total array<double>, missed int")
        self.next = handle.getValueState("next", "track_id bigint")

    def rows_of(self, frame: pd.DataFrame) -> list[tuple]:
        ends = frame[self.scene_end].tolist() if self.scene_end else [False] * len(frame)
        boxes = frame[["x1", "y1", "x2", "y2"]].astype(float).to_numpy().tolist()
        vectors = [np.asarray(v, float).tolist() for v in frame["embedding"]]
        return list(zip(_millis(frame, self.ts), frame["frame_id"].tolist(), frame["det_idx"].tolist(), boxes, frame["conf"].astype(float).tolist(), vectors, map(bool, ends), strict=True))

    def settle(self, key, rows, watermark):
        if not rows:
            return pd.DataFrame()
        tracker = Tracker(self.params)
        known = {k[0]: v for k, v in self.tracks.iterator()} if self.tracks.exists() else {}
        tracker.tracks = [{"id": i, "box": np.array(box), "sum": np.array(total), "missed": missed} for i, (box, total, missed) in sorted(known.items())]
        tracker.next_id = self.next.get()[0] if self.next.exists() else 1
        out, at = [], 0
        while at < len(rows):
            stop = next((i for i in range(at, len(rows)) if rows[i][1] != rows[at][1]), len(rows))
            some = sorted(rows[at:stop], key=lambda r: r[2])
            ids = tracker.update(some[0][1], np.array([r[3] for r in some]), np.array([r[5] for r in some]), np.array([r[4] for r in some]))
            out += [(key[0], some[i][1], some[i][2], t) for i, t in sorted(ids.items())]
            if any(r[6] for r in some):
                tracker.cut()
            at = stop
        live = {t["id"]: t for t in tracker.tracks}
        for i in known.keys() - live.keys():
            self.tracks.removeKey((i,))
        for i, t in live.items():
            value = (t["box"].tolist(), t["sum"].tolist(), int(t["missed"]))
            if i not in known or (list(known[i][0]), list(known[i][1]), known[i][2]) != value:
                self.tracks.updateValue((i,), value)
        self.next.update((tracker.next_id,))
        return pd.DataFrame(out, columns=[self.episode, "frame_id", "det_idx", "track_id"])

    def due(self, last: int, watermark: int) -> int | None:
        return last + self.keep + 1 if watermark <= last + self.keep else None

    def forget(self) -> None:
        self.tracks.clear()
        self.next.clear()


def followed(stream: DataFrame, params: TrackerParams = TrackerParams(), episode: str = "episode_id", ts: str = "ts", scene_end: str | None = None, late: str = LATE, keep_ms: int = 3_600_000) -> DataFrame:
    """What ``operators.tracking.track`` gives for the same detections: episode, frame_id, det_idx and track_id.

    Detections (episode, frame_id, det_idx, x1, y1, x2, y2, conf, embedding and the frame's time ``ts``, which grows with
    frame_id and lies after 1970) may come in any order and any files, within ``late``.  A frame is settled once the watermark has passed it.  An episode's state is its
    live tracks, one row a track of which only those that a batch changes are written, and the frames that wait; ``keep_ms`` after
    its last frame it goes.  An embedding or box with a null leaves the detection out.
    """
    if params.compat:
        raise ValueError("rows that compat leaves out afterwards can't be taken back from a stream")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    wanted = [episode, "frame_id", "det_idx", "x1", "y1", "x2", "y2", "conf", "embedding", ts, *([scene_end] if scene_end else [])]
    whole = F.coalesce(~F.exists("embedding", lambda x: x.isNull()), F.lit(False))
    rows = stream.select(*wanted).dropna(subset=wanted[:10]).filter(whole).withWatermark(ts, late)
    kind = stream.schema[episode].dataType.simpleString()
    return rows.groupBy(episode).transformWithStateInPandas(_Following(params, episode, ts, scene_end, keep_ms), f"{episode} {kind}, frame_id bigint, det_idx int, track_id bigint", "append", "EventTime")


@dataclass
class _Group:
    """A person's open interval, as the merge has it."""

    start: int
    end: int
    conf: float
    visible: float
    frames: int
    members: int

    def row(self, key: tuple, person: str) -> tuple:
        return *key, person, self.start, self.end, self.conf, self.visible if self.members == 1 else 0.0, self.frames if self.members == 1 else 0, self.members


class _Merging(_InOrder):
    """State: a map of open groups by person, and the sightings that a gap may still meet."""

    shift = 86_400_000
    fields = "at bigint, track_id bigint, person string, end_ms bigint, conf double, visible double, frames bigint"

    def __init__(self, params: MergeParams, tie: str, columns: list[str]):
        self.p, self.tie, self.columns = params, tie, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", "person string", "start bigint, end bigint, conf double, visible double, frames bigint, members bigint")
        self.seen = handle.getListState("seen", "start bigint, end bigint, person string")

    def rows_of(self, frame: pd.DataFrame) -> list[tuple]:
        number = lambda c, kind: frame[c].astype(kind).tolist()
        return list(zip(number("start_ms", "int64"), number(self.tie, "int64"), frame["person"].tolist(), number("end_ms", "int64"), number("conf", float), number("visible", float), number("frames", "int64"), strict=True))

    def settle(self, key, rows, watermark):
        p, own = self.p, dict(self.p.per_person or {})
        groups = {k[0]: _Group(*v) for k, v in self.open.iterator()} if self.open.exists() else {}
        before = set(groups)
        seen = [tuple(r) for r in self.seen.get()] if self.seen.exists() else []
        out, changed, pruned = [], set(), 0
        for n, (at, _, person, end, conf, visible, frames) in enumerate(rows):
            group, new = groups.get(person), _Group(at, end, conf, visible, frames, 1)
            changed.add(person)
            if group is not None:
                gap = at - group.end
                step = "clamped"
                if gap <= p.reach:
                    hidden = gap > p.conflict_guard and any(w != person and a < at and min(b, at) - max(a, group.end) >= max(1, p.conflict_guard) for a, b, w in seen)
                    step = merge_step(own.get(person, p), gap, group.conf, group.visible, conf, visible, hidden)
                if step in MERGES:
                    new = _Group(group.start, max(group.end, end), max(group.conf, conf), 0.0, 0, group.members + 1)
                else:
                    out.append(group.row(key, person))
            groups[person] = new
            if conf >= p.conflict_conf:
                seen.append((at, end, person))
            if n - pruned >= 200:  # what no gap after this row can meet
                seen, pruned = [s for s in seen if s[1] > at - p.reach], n
        for person in [w for w, g in groups.items() if watermark > g.end + p.reach]:  # nothing that still may come is near enough
            out.append(groups.pop(person).row(key, person))
        for person in before - groups.keys():
            self.open.removeKey((person,))
        for person in changed & groups.keys():
            g = groups[person]
            self.open.updateValue((person,), (g.start, g.end, g.conf, g.visible, g.frames, g.members))
        # a gap that is still to come ends after the watermark and is no longer than ``reach``; it may begin where an open group ends
        near = [s for s in seen if s[1] > watermark - p.reach]
        self.seen.put(near) if near else self.seen.clear()
        return pd.DataFrame(out, columns=self.columns)

    def due(self, last: int, watermark: int) -> int | None:
        ends = [v[1] for _, v in self.open.iterator()] if self.open.exists() else []
        return min(ends) + self.p.reach + 1 if ends else None

    def forget(self) -> None:
        self.open.clear()
        self.seen.clear()


def merged(stream: DataFrame, params: MergeParams = MergeParams(), keys: list[str] | None = None, tie: str = "track_id", late_ms: int = 600_000) -> DataFrame:
    """What ``timeline(adaptive_merge(...))`` gives for the same tracks: keys, person, start_ms, end_ms, conf, visible, frames and members.

    Tracks (keys, tie, person, start_ms, end_ms, conf, visible, frames; times in milliseconds, from zero) may come in any
    order and files, as long as none starts more than ``late_ms`` before one that came earlier.  An interval is given once, when the watermark (on starts) has
    passed its end by more than ``reach``, or a later track of the person did not join it: then no gap can close any more.

    Persons meet within ``keys`` (an episode, say): these are what is dealt to tasks, since a gap looks at all others of its
    key.  State is one open interval a person, what is in sight within ``reach``, and the tracks that wait.  A track with a null is left out.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    own = keys or ["_all"]
    wanted = [*(keys or []), tie, "person", "start_ms", "end_ms", "conf", "visible", "frames"]
    rows = stream.select(*wanted).dropna().withColumn("_ts", F.timestamp_millis(F.col("start_ms") + _Merging.shift)).withWatermark("_ts", f"{late_ms} milliseconds")
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in own]
    fields = ", ".join([*kinds, "person string, start_ms bigint, end_ms bigint, conf double, visible double, frames bigint, members bigint"])
    columns = [*own, "person", "start_ms", "end_ms", "conf", "visible", "frames", "members"]
    out = rows.groupBy(*own).transformWithStateInPandas(_Merging(params, tie, columns), fields, "append", "EventTime")
    return out if keys else out.drop("_all")
