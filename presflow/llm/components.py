"""Connected components by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy


def _ends(df: DataFrame, first: tuple[str, str], second: tuple[str, str], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two rows of each: one scan, where a union would make two."""
    pairs = [F.struct(*[F.col(c).alias(n) for c, n in zip(pair, names, strict=True)]) for pair in (first, second)]
    return df.select(F.explode(F.array(*pairs)).alias("e")).select(*[F.col(f"e.{n}").alias(n) for n in names])


def _large_star(edges: DataFrame) -> DataFrame:
    least = _ends(edges, ("a", "b"), ("b", "a")).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return edges.select(F.col("b").alias("at"), F.col("a").alias("to")).join(least, F.col("at") == F.col("a")).select(F.col("to").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return _ends(edges.join(least, "a"), ("b", "m"), ("a", "m")).filter("a <> b")


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges are stars around their smallest node: who has a smaller neighbour has that one alone."""
    ends = _ends(edges.withColumns({"up": F.lit(1), "down": F.lit(0)}), ("a", "up"), ("b", "down"), ("node", "up"))
    seen = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    with tidy(edges.sparkSession):
        return (seen.agg(F.max(F.when(F.col("ups") > 0, F.col("n")))).first()[0] or 0) <= 1


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): the smallest node b of the component of every other node a of the edges (a, b).

    Each round joins edges with the least neighbour of their ends, no node's neighbours come together in one task.  Rounds
    grow with the logarithm of the number of nodes; each is written to the checkpoint folder.  Edges are read several times in
    the first one, and should be written down.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        edges = cut(_small_star(_large_star(edges)).distinct())
        if _settled(edges):
            return edges


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (a, b); nodes that are alone are not in it."""
    found = stars(edges)
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
