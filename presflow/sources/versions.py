"""Tables that are replaced without a moment of absence: folders that never change, and a manifest for each version.

A version is a file ``manifest/<number>`` that names a folder for each table of the set.  A writer writes new folders first, then creates the
manifest with the next number, which only one writer can; so several tables change together, a crash leaves the version before, and of two
writers that began from one version the second is refused.  A reader keeps the folders of the version that it has looked up.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer was first."""


def _store(spark: SparkSession, path: str):
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    return as_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), as_path


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """All numbers that are taken, whole or not."""
    fs, as_path = _store(spark, path)
    folder = as_path(f"{path}/manifest")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, path: str, number: int) -> dict[str, str] | None:
    """Folders by table of a version; None if its writer did not get to its end."""
    lines = spark.read.text(f"{path}/manifest/{number:012d}", wholetext=True).collect()
    try:
        return json.loads(lines[0][0])["tables"] if lines else None
    except ValueError:
        return None


def latest(spark: SparkSession, path: str) -> int:
    """The newest whole version; 0 if there is none."""
    return next((n for n in reversed(_numbers(spark, path)) if manifest(spark, path, n) is not None), 0)


def commit(tables: dict[str, DataFrame], path: str, begun_from: int | None = None) -> int:
    """Writes the tables and makes them the next version, together with the tables of the last one that are not among them.

    ``begun_from`` is the version that the tables were made of (the last one, if not given): if there is a newer one, or another writer takes the number
    first, it is a ``Conflict``, and what was written goes.  The tables may be read from the version before.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, as_path = _store(spark, path)
    seen = latest(spark, path)
    if begun_from is not None and begun_from != seen:
        raise Conflict(f"version {seen} has followed {begun_from}")
    before = (manifest(spark, path, seen) or {}) if seen else {}
    taken = _numbers(spark, path)
    folders = {name: f"data-{name}-{uuid4().hex}" for name in tables}
    try:
        for name, df in tables.items():
            df.write.parquet(f"{path}/{folders[name]}")
        number = max([seen, *taken]) + 1
        if _numbers(spark, path) != taken:
            raise Conflict("another writer was first")
        try:
            out = fs.create(as_path(f"{path}/manifest/{number:012d}"), False)
        except Exception as e:
            raise Conflict(f"another writer has made version {number}") from e
        out.write(bytearray(json.dumps({"tables": before | folders}).encode()))
        out.close()
    except BaseException:
        for folder in folders.values():
            fs.delete(as_path(f"{path}/{folder}"), True)
        raise
    return number


def table(spark: SparkSession, path: str, name: str = "table", version: int | None = None) -> DataFrame | None:
    """A table of a version (the newest, if not given), None if there is none; it stays the same while others are committed."""
    number = latest(spark, path) if version is None else version
    folder = (manifest(spark, path, number) or {}).get(name) if number else None
    return None if folder is None else spark.read.parquet(f"{path}/{folder}")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes manifests and folders that the newest ``keep`` versions do not need; the number of folders.  Not while a writer is at work."""
    fs, as_path = _store(spark, path)
    whole = {n: m for n in _numbers(spark, path) if (m := manifest(spark, path, n)) is not None}
    stay = sorted(whole)[-keep:]
    needed = {folder for n in stay for folder in whole[n].values()}
    gone = [f.getPath() for f in fs.listStatus(as_path(path)) if f.getPath().getName().startswith("data-") and f.getPath().getName() not in needed]
    for n in _numbers(spark, path):
        if stay and n < stay[0]:
            fs.delete(as_path(f"{path}/manifest/{n:012d}"), False)
    for folder in gone:
        fs.delete(folder, True)
    return len(gone)
