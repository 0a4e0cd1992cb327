"""A data source of documents: ``spark.read.format("presence_documents")`` over JSON documents and .npy/.npz files.

Options: ``path`` (a folder, or one file), ``kind`` (tracks, clusters or vectors).  Each file is a partition's worth of rows, or several small files are;
a filter on ``file`` (the name without folder and ending, an episode's as a rule) is pushed down to the listing, so that other files are not opened.
Files are listed and opened through pyarrow's file systems: local paths, and those stores that it knows.
"""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMAS = {
    "tracks": "file string, track_id bigint, start_ms bigint, end_ms bigint, count int, mean_confidence double, global_id string, person_name string, frame_refs string",
    "clusters": "file string, cluster_id bigint, size int, track_ids array<bigint>, variance double, silhouette_score double, quality_score double, is_lowconf boolean, name string, assignment_confidence double, assignment_margin double",
    "vectors": "file string, row bigint, embedding array<double>, quality double",
}
ENDINGS = {"tracks": (".json",), "clusters": (".json",), "vectors": (".npy", ".npz")}
#: Bytes of files that one partition reads (unless one file is longer).
BYTES = 32 << 20


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def _file(name: str) -> str:
    return posixpath.splitext(posixpath.basename(name))[0]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fields: list[tuple[str, str]]):
        self.path, self.kind, self.fields = options["path"], options.get("kind", "tracks"), fields
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on ``file`` choose files; all others are left to Spark."""
        for f in filters:
            chosen = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if chosen is None or f.attribute != ("file",):
                yield f
            else:
                self.wanted = chosen if self.wanted is None else self.wanted & chosen

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri("/" + self.path[5:].lstrip("/") if self.path.startswith("file:") else self.path)

    def partitions(self) -> list[Files]:
        system, root = self._system()
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        found = sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and f.path.endswith(ENDINGS[self.kind]))
        parts, size = [], BYTES
        for name, n in found:
            if self.wanted is not None and _file(name) not in self.wanted:
                continue
            if size + n > BYTES:
                parts.append([])
                size = 0
            parts[-1].append(name)
            size += n
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._system()
        for name in partition.names:
            with system.open_input_stream(name) as stream:
                content = stream.read()
            yield from self.vectors(name, content) if self.kind == "vectors" else self.rows(name, content)

    def rows(self, name: str, content: bytes) -> Iterator[tuple]:
        """A malformed document has no rows; fields that a row lacks are null."""
        try:
            found = json.loads(content)
        except ValueError:
            return
        for row in (found.get(self.kind) or []) if isinstance(found, dict) else []:
            own = row | {"file": _file(name)}
            if "frame_refs" in row:
                own["frame_refs"] = json.dumps(row["frame_refs"])
            yield tuple(_as(own.get(c), kind) for c, kind in self.fields)

    def vectors(self, name: str, content: bytes) -> Iterator[tuple]:
        held = np.load(io.BytesIO(content), allow_pickle=False)
        packed = name.endswith(".npz")
        matrix = np.atleast_2d(held["embeddings"] if packed else held)
        quality = held["qualities"] if packed and "qualities" in held else np.ones(len(matrix))
        for i, (v, q) in enumerate(zip(matrix.astype(float).tolist(), quality.tolist(), strict=True)):
            yield _file(name), i, v, float(q)


def _as(value, kind: str):
    if value is None or kind.startswith(("string", "array", "boolean")):
        return value
    return float(value) if kind == "double" else int(value)


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "presence_documents"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "tracks")]

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options), [(f.name, f.dataType.simpleString()) for f in schema.fields])


def register(spark: SparkSession) -> SparkSession:
    """Makes the source known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Documents)
    return spark
