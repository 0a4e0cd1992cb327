"""Nearest neighbours by largest inner product, with collision-counting hashing.

Vectors are dealt to blocks, and each block is indexed for itself: M random directions, and for each the block's
projections as a sorted array.  A search centres a window on the query's projection in every array; windows widen step by
step (virtual rehashing, no array is built again), and a vector met in at least THRESHOLD windows is verified by its true
inner product.  A step of radius R finds a vector at distance R with high probability, so the search ends once the k-th
best of the verified lies within R.

Inner products become distances by one more component: sqrt(N^2 - |x|^2) for a vector, N the block's longest, and 0 for a
query; then distance^2 = |q|^2 + N^2 - 2 <q, x>.

Blocks hold a bounded number of vectors.  Every block of queries meets every block of vectors once.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Directions, windows that a vector must be met in, half a window's width for radius 1, and the ratio of radii.
DIRECTIONS, THRESHOLD, HALF, RATIO = 32, 24, 1.5, 1.12
BLOCK, QUERY_BLOCK = 16_384, 512
_SEED = 20_240


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    """One row for a block: ids and vectors, in order of id; of rows with the same id, the smallest vector stays."""
    dim = key[1].as_py()
    ids = table["vec_id"].to_numpy()
    vectors = np.array(table["vector"].combine_chunks().flatten(), np.float64).reshape(len(ids), dim)
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    once = np.r_[True, ids[1:] != ids[:-1]]
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), "ids": [ids[once].tobytes()], "vectors": [vectors[once].tobytes()]})


def _blocks(df: DataFrame, size: int) -> tuple[DataFrame, int]:
    n = max(1, ceil(df.count() / size))
    dealt = df.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    return dealt.groupBy("block", "dim").applyInArrow(_pack, "block int, dim int, ids binary, vectors binary"), n


class Index:
    """Sorted projections of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        _, copy_of = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, copy_of.ravel()))
        same = copy_of.ravel()[order]
        first = np.searchsorted(same, same)
        keep = np.sort(order[np.arange(len(ids)) - first <= k])  # of equal vectors no more than k + 1 can be among the k nearest of another
        self.ids, self.vectors = ids[keep], vectors[keep]
        norms = np.sqrt((self.vectors**2).sum(1))
        self.longest = norms.max()
        rest = np.sqrt(np.maximum(self.longest**2 - norms**2, 0))
        directions = np.random.default_rng(_SEED).standard_normal((vectors.shape[1] + 1, DIRECTIONS))
        self.directions = directions[:-1]
        projected = (self.vectors @ self.directions + rest[:, None] * directions[-1]).T
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, 1)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int):
        """For each query: ids and inner products of the k best verified vectors, best first, ties to the smaller id."""
        n = len(self.ids)
        centres = queries @ self.directions
        lengths = (queries**2).sum(1) + self.longest**2
        sample = self.vectors[:: max(1, n // 256)]
        near = np.sqrt(np.maximum(np.median(lengths[:, None] - 2 * queries @ sample.T, axis=1), 0))
        for q, (query, length) in enumerate(zip(queries, lengths, strict=True)):
            radius = max(0.5 * near[q], 1e-6 * np.sqrt(length))
            counts = np.zeros(n, np.int64)
            low = high = None
            seen = np.zeros(n, bool)
            found, scores = np.empty(0, np.int64), np.empty(0)
            while True:
                a = [x.searchsorted(c - HALF * radius) for x, c in zip(self.sorted, centres[q], strict=True)]
                b = [x.searchsorted(c + HALF * radius, "right") for x, c in zip(self.sorted, centres[q], strict=True)]
                if low is None:
                    new = [o[i:j] for o, i, j in zip(self.order, a, b, strict=True)]
                else:
                    new = [part for o, i, j, x, y in zip(self.order, a, b, low, high, strict=True) for part in (o[i:x], o[y:j])]
                low, high = a, b
                counts += np.bincount(np.concatenate(new), minlength=n)
                more = np.flatnonzero((counts >= THRESHOLD) & ~seen)
                seen[more] = True
                more = more[self.ids[more] != own[q]]
                found = np.r_[found, more]
                scores = np.r_[scores, self.vectors[more] @ query]
                if len(scores) > k:
                    worst = np.partition(scores, len(scores) - k)[len(scores) - k]
                    keep = scores >= worst - 1e-9 * length
                    found, scores = found[keep], scores[keep]
                    if length - 2 * worst <= radius**2:
                        break
                if seen.all():
                    break
                radius *= RATIO
            scores = (self.vectors[found] * query).sum(1)  # the same rounding wherever a vector stands
            best = np.lexsort((self.ids[found], -scores))[:k]
            yield self.ids[found[best]], scores[best]


def _search(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                matrix = lambda x, dim=row["dim"]: np.frombuffer(x, np.float64).reshape(-1, dim)
                index = Index(np.frombuffer(row["ids"], np.int64), matrix(row["vectors"]), k)
                own = np.frombuffer(row["query_ids"], np.int64)
                results = list(index.search(matrix(row["queries"]), own, k))
                ids, scores = [np.concatenate([r[i] for r in results]) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, [len(r[0]) for r in results])), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    return run


def search(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query, itself left out.

    ``is_query`` is a condition on ``vec_id``.  Rows with a null id and vectors that are null, zero or hold null or
    non-finite components take no part; vectors of different lengths never meet.  Rows that repeat an id count once (the
    smallest vector).  Equal scores go by the smaller id.  Other columns are not looked at.  An empty table gives none.
    """
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))
    data, n = _blocks(rows, BLOCK)
    queries, m = _blocks(rows.filter(is_query), QUERY_BLOCK)
    queries = queries.select(F.col("block").alias("query_block"), "dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    pairs = data.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).join(
        queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), ["block", "query_block", "dim"]
    )
    found = pairs.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
