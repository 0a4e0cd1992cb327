"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of a ring of 64-bit hashes; a key belongs to the arc that ends at the next point clockwise.
A shard takes at most its bound of rows.  What an arc holds beyond the bound of its owner goes on clockwise to the next
points whose shards still have room.  With bounds that add up to the number of rows, counts differ by one at most.

Only the number of rows of each arc reaches the driver (shards x virtual nodes numbers, whatever the table's size).  There
the flow along the ring is worked out; it cuts each arc's rows, in order of hash, into runs that go to one shard each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from hashlib import blake2b

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The ring is looked up by the leading bits of a hash.
CELL_BITS = 12
LAW = "rows"


def ring(shards: int, virtual_nodes: int) -> tuple[list[int], list[int]]:
    """Points in order, and the shard that owns each.  A shard's points do not depend on how many others there are."""
    spot = lambda s, v: int.from_bytes(blake2b(b"%d:%d" % (s, v), digest_size=8).digest(), "big", signed=True)
    pairs = sorted((spot(s, v), s) for s in range(shards) for v in range(virtual_nodes))
    return [p for p, _ in pairs], [s for _, s in pairs]


def bounds(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def flow(counts: list[int], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first) for every run of rows; ``room`` adds up to the counts."""
    room, slot = room[:], [0] * len(room)
    runs: list[tuple[int, int, int, int, int]] = []
    kept = []

    def put(arc: int, at: int, n: int, shard: int) -> None:
        runs.append((arc, at, at + n, shard, slot[shard]))
        slot[shard] += n
        room[shard] -= n

    for arc, n in enumerate(counts):
        kept.append(min(n, room[owner[arc]]))
        if kept[arc]:
            put(arc, 0, kept[arc], owner[arc])
    moving: deque[list[int]] = deque()
    for lap in range(2):
        for arc, n in enumerate(counts):
            while moving and (free := room[owner[arc]]):
                source, at, left = moving[0]
                put(source, at, min(left, free), owner[arc])
                if left <= free:
                    moving.popleft()
                else:
                    moving[0] = [source, at + free, left - free]
            if lap == 0 and n > kept[arc]:
                moving.append([arc, kept[arc], n - kept[arc]])
    return runs


def _arc(points: list[int], position: Column, df: DataFrame) -> DataFrame:
    """Adds ``arc``; the table of cells has 2**CELL_BITS rows, however large ``df`` is."""
    width = 64 - CELL_BITS
    cells = []
    for cell in range(-(1 << CELL_BITS - 1), 1 << CELL_BITS - 1):
        a = bisect_left(points, cell << width)
        b = bisect_left(points, (cell + 1) << width)
        cells.append((cell, points[a:b], a, b % len(points)))
    table = df.sparkSession.createDataFrame(cells, "cell int, inside array<bigint>, first int, beyond int")
    placed = df.withColumn("position", position).withColumn("cell", F.shiftright("position", width).cast("int"))
    before = F.size(F.filter("inside", lambda p: p < F.col("position")))
    arc = F.when(before < F.size("inside"), F.col("first") + before).otherwise(F.col("beyond"))
    return placed.join(F.broadcast(table), "cell").withColumn("arc", arc).drop("cell", "inside", "first", "beyond")


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, virtual_nodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    size: UTF-8 bytes of the text plus 16; a null text has none, and the checksum of an empty one.  Rows are placed by their
    key; a null key is a key like others, and repeated rows are rows of their own, told apart by rank.  Slots count from 0
    within a shard without gaps.  Other columns are not looked at.  An empty table gives an empty table.
    One shuffle of five numbers a row, by arc; texts do not move.
    """
    octets = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(F.col(key).alias("doc_id"), (F.octet_length(octets).cast("bigint") + 16).alias("size"), F.crc32(octets).alias("text_crc32"))
    points, owner = ring(shards, virtual_nodes)
    rows = _arc(points, F.xxhash64("doc_id"), rows)
    counts = [0] * len(points)
    for arc, n in _arc(points, F.xxhash64("doc_id"), df.select(F.col(key).alias("doc_id"))).groupBy("arc").count().collect():
        counts[arc] = n
    runs = flow(counts, owner, bounds(sum(counts), shards))
    runs = df.sparkSession.createDataFrame(runs, "arc int, low bigint, high bigint, shard int, base bigint")
    order = Window.partitionBy("arc").orderBy("position", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("bigint") - 1).alias("r")
    runs = F.broadcast(runs).alias("u")  # at most two runs a point and one a shard
    inside = (F.col("r.arc") == F.col("u.arc")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(runs, inside).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
