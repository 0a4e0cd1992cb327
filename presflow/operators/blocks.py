"""All pairs of vectors without shuffling a vector for each block that it meets, and without writing the pairs.

Vectors are written once, to files of a bounded number of rows in the shared folder.  A task holds some files and reads the others one after
another, so what it needs is bounded, and what comes out is a row or a few for each vector: how many are near, how far the k-th nearest is, or
links that connect the same vectors as all the near pairs do (a forest).  Products are taken in single precision, and those that
are too close to a threshold to tell, or in question for a k-th place, again in double.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows of a file, and of its part that meets another file at a time.
ROWS, PART = 4096, 1024
#: Bytes of the vectors that a task holds at most (one file at least).
HELD = 32 << 20


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder)


@dataclass
class Block:
    """A file's items, vectors (in both precisions) and how many vectors are near each, one column a threshold."""

    items: pa.Array
    x: np.ndarray
    near: np.ndarray | None

    def __post_init__(self):
        self.x32 = self.x.astype(np.float32)


@dataclass(frozen=True)
class Stored:
    folder: str
    kind: str
    dim: int
    sizes: tuple[int, ...]
    names: tuple[str, ...]

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def load(self, at: int) -> Block:
        system, root = _filesystem(self.folder)
        with system.open_input_stream(f"{root}/{self.names[at]}") as source:
            table = pa.ipc.open_stream(source).read_all().combine_chunks()
        x = table["x"].chunk(0).flatten().to_numpy().reshape(table.num_rows, -1)
        near = table["near"].chunk(0).flatten().to_numpy().reshape(table.num_rows, -1) if "near" in table.column_names else None
        return Block(table["item"].chunk(0), x, near)

    def groups(self, spark: SparkSession) -> list[list[int]]:
        """Files of each task: as many as it may hold, and fewer where that leaves too few tasks."""
        most = max(1, min(HELD // (8 * self.dim * ROWS), -(-len(self.sizes) // (3 * spark.sparkContext.defaultParallelism))))
        return [list(range(i, min(i + most, len(self.sizes)))) for i in range(0, len(self.sizes), most)]

    def drop(self) -> None:
        system, root = _filesystem(self.folder)
        if system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir(root)


def _written(folder: str, items: pa.Array, x: np.ndarray, near: np.ndarray | None = None) -> str:
    system, root = _filesystem(folder)
    system.create_dir(root)
    name = uuid.uuid4().hex
    fixed = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(a).ravel()), a.shape[1])
    table = pa.table({"item": items, "x": fixed(x)} | ({} if near is None else {"near": fixed(near)}))
    with system.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return name


def stored(unit: DataFrame, item: str, vector: str) -> Stored | None:
    """Rows whose vectors are whole, written to files; none if there are no rows.  The driver sees a row a file."""
    from .vectors import _matrix

    folder = f"{shared_folder(unit.sparkSession)}/blocks-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting)
            x = _matrix(table, vector)
            return pa.RecordBatch.from_pylist([{"name": _written(folder, table[item].combine_chunks(), x), "n": len(x), "dim": x.shape[1]}])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                if n + part.num_rows > ROWS:
                    yield out()
                    waiting, n = [], 0
                waiting.append(part)
                n += part.num_rows
        if n:
            yield out()

    files = sorted(tuple(r) for r in unit.select(item, vector).mapInArrow(run, "name string, n bigint, dim bigint").collect())
    if len({dim for _, _, dim in files}) > 1:
        raise ValueError(f"vectors of {min(f[2] for f in files)} and of {max(f[2] for f in files)} components can't be multiplied")
    return Stored(folder, unit.schema[item].dataType.simpleString(), files[0][2], tuple(f[1] for f in files), tuple(f[0] for f in files)) if files else None


def _each(spark: SparkSession, groups: list[list[int]], run, schema: str) -> DataFrame:
    """``run(group)`` gives tables; one task a group, and what comes out is written."""

    def tasks(batches):
        for batch in batches:
            for at in batch.column(0).to_pylist():
                for table in run(groups[at]):
                    yield from table.to_batches(max_chunksize=50_000)

    return spark.range(0, len(groups), 1, len(groups)).mapInArrow(tasks, schema).checkpoint()


def _slack(dim: int) -> float:
    """More than single precision can be off in a product of unit vectors."""
    return 1e-6 + 2e-7 * dim


def _near(left: Block, right: Block, least: list[float], same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(threshold, rows of left, rows of right) of pairs with a product of that threshold; a row does not meet itself."""
    slack = _slack(left.x.shape[1])
    for top in range(0, len(left.x), PART):
        sims = (left.x32[top : top + PART] @ right.x32.T).ravel()
        at = np.flatnonzero(sims >= min(least) - slack)
        sims = sims[at].astype(float)
        i, j = np.divmod(at, len(right.x))
        i += top
        if same:
            apart = i != j
            i, j, sims = i[apart], j[apart], sims[apart]
        unsure = np.flatnonzero(np.any([np.abs(sims - t) <= slack for t in least], axis=0))
        for some in range(0, len(unsure), 100_000):
            u = unsure[some : some + 100_000]
            sims[u] = np.einsum("ij,ij->i", left.x[i[u]], right.x[j[u]])
        for n, t in enumerate(least):
            yes = sims >= t
            yield n, i[yes], j[yes]


def counted(spark: SparkSession, at: Stored, least: list[float]) -> tuple[Stored, DataFrame]:
    """The files anew with the numbers of near vectors, one for each threshold, and these as rows: item and near."""
    groups, folder = at.groups(spark), f"{at.folder}-near"

    def run(group):
        mine = [at.load(f) for f in group]
        near = [np.zeros((len(b.x), len(least)), np.int64) for b in mine]
        for f in range(len(at.sizes)):
            other = at.load(f)
            for own, block, counts in zip(group, mine, near, strict=True):
                for n, i, _ in _near(block, other, least, own == f):
                    counts[:, n] += np.bincount(i, minlength=len(counts))
        for block, counts in zip(mine, near, strict=True):
            name = _written(folder, block.items, block.x, counts)
            yield pa.table({"name": pa.array([name] * len(counts)), "item": block.items, "near": pa.array(counts.tolist(), pa.list_(pa.int64()))})

    rows = _each(spark, groups, run, f"name string, item {at.kind}, near array<bigint>")
    files = sorted((r["name"], r["n"]) for r in rows.groupBy("name").agg(F.count("*").alias("n")).collect())
    return Stored(folder, at.kind, at.dim, tuple(n for _, n in files), tuple(name for name, _ in files)), rows.select("item", "near")


def _tied(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the first place of each component) with the links (a, b) taken in."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def forest(spark: SparkSession, at: Stored, least: list[float], core: int | None = None) -> DataFrame:
    """n (threshold), inner, a, b: links that connect the same items as all near pairs do.

    With ``core``, only items with so many near ones (``counted``) are connected (``inner``); a link of one that has fewer (a) to one that
    has as many (b) is given as it is: there are fewer than ``core`` of them a row.  Each task makes a forest of its own pairs, at most a row an item.
    """
    groups, m, starts = at.groups(spark), len(at.sizes), at.starts

    def run(group):
        mine, items, cores = {f: at.load(f) for f in group}, {}, {}
        labels = [np.arange(starts[-1]) for _ in least]
        rims: list[list] = [[] for _ in least]

        def seen(f, block):
            items[f] = block.items
            cores[f] = np.ones((len(block.x), len(least)), bool) if core is None else block.near >= core

        for f, block in mine.items():
            seen(f, block)
        for f in range(m):
            # a pair of files meets once: the later ones, up to half the way around
            meets = [g for g in group if (d := (f - g) % m) <= (m - 1) // 2 or (2 * d == m and g < f)]
            if not meets:
                continue
            other = mine.get(f) or at.load(f)
            seen(f, other)
            for g in meets:
                for n, i, j in _near(mine[g], other, [*least], g == f):
                    ci, cj = cores[g][i, n], cores[f][j, n]
                    both = ci & cj
                    labels[n] = _tied(labels[n], starts[g] + i[both], starts[f] + j[both])
                    for rim, hub, yes in ((starts[g] + i, starts[f] + j, ~ci & cj), (starts[f] + j, starts[g] + i, ci & ~cj)):
                        if yes.any():
                            rims[n].append(np.stack([rim[yes], hub[yes]]))
        known = sorted(items)
        places = np.concatenate([np.arange(starts[f], starts[f + 1]) for f in known])
        names = pa.concat_arrays([items[f] for f in known])
        of = lambda p: names.take(pa.array(np.searchsorted(places, p)))
        for n, label in enumerate(labels):
            a = np.flatnonzero(label != np.arange(len(label)))
            rim = np.concatenate(rims[n], axis=1) if rims[n] else np.zeros((2, 0), np.int64)
            for inner, x, y in ((True, a, label[a]), (False, rim[0], rim[1])):
                if len(x):
                    yield pa.table({"n": pa.array(np.full(len(x), n, np.int32)), "inner": pa.array(np.full(len(x), inner)), "a": of(x), "b": of(y)})

    return _each(spark, groups, run, f"n int, inner boolean, a {at.kind}, b {at.kind}")


def kth_nearest(spark: SparkSession, at: Stored, k: int) -> DataFrame:
    """item and sim, its k-th largest product (its own counted), of items that have so many."""
    groups, slack = at.groups(spark), _slack(at.dim)

    def run(group):
        mine = [at.load(f) for f in group]
        best = [np.full((len(b.x), k), -np.inf) for b in mine]  # in rising order
        for f in range(len(at.sizes)):
            other = at.load(f)
            for block, kept in zip(mine, best, strict=True):
                for top in range(0, len(block.x), PART):
                    held = kept[top : top + PART]
                    sims = block.x32[top : top + PART] @ other.x32.T
                    floor = held[:, 0].astype(np.float32)
                    if sims.shape[1] > k and not np.isfinite(floor).all():
                        floor = np.maximum(floor, np.partition(sims, -k, axis=1)[:, -k])
                    at_ = np.flatnonzero((sims >= (floor - np.float32(slack))[:, None]).ravel())
                    i, j = np.divmod(at_, sims.shape[1])
                    exact = np.empty(len(i))
                    for some in range(0, len(i), 100_000):
                        s = slice(some, some + 100_000)
                        exact[s] = np.einsum("ij,ij->i", block.x[top + i[s]], other.x[j[s]])
                    counts = np.bincount(i, minlength=len(held))
                    if len(i):
                        wide = np.full((len(held), counts.max()), -np.inf)
                        wide[i, np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)] = exact
                        kept[top : top + PART] = np.sort(np.concatenate([held, wide], axis=1), axis=1)[:, -k:]
        for block, kept in zip(mine, best, strict=True):
            there = np.flatnonzero(np.isfinite(kept[:, 0]))
            yield pa.table({"item": block.items.take(pa.array(there)), "sim": pa.array(kept[there, 0])})

    return _each(spark, groups, run, f"item {at.kind}, sim double")
