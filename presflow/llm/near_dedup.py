"""Near-duplicate documents by a chosen-path set similarity join.

Documents with equal shingle sets are one item of the search.  In each of TREES trees an item goes to the nodes of BRANCH
coordinates of its min-wise signature, and from a node on to BRANCH children, whose coordinates follow from the hash of the
path; items that agree in them stay together.  With a similarity s the expected number of shared children is BRANCH * s,
above one for the threshold, so a linked pair stays together somewhere at any depth but for a small chance, and independent
trees make that chance smaller.  All trees draw on one signature of 64 coordinates.  Averaged over how many of these a linked
pair agrees in, the model gives a recall of 99.998 % at a similarity of 0.85 and of 99.98 % at 0.80 for pairs that meet in no
small node; pairs of smaller nodes are missed with a chance of (1 - s) to the power of TREES * BRANCH, 3e-7 and 3e-6.

Nodes of at most NODE items are looked through in one task: they branch there, in arrays, down to LEAF items, which are
compared exhaustively; so is a node that is so much alike that branching would take longer.  What hangs together by
signatures is a part.  A part of at most STAR items is confirmed whole; of a larger one, stars around some of its items are
confirmed first, which brings a group of near copies down to one component and a rest.  Then the rest meets all items that are
near by signatures and not connected yet: their sets come to one task, once each, and are compared by matrix products there.
Only where they would pass PART_SHINGLES they are cut into chunks that meet pairwise.

Before a node of more than NODE items branches, its items meet HUBS of its items, drawn by hash, and those that link with the
nearest are connected.  A node that is one component is done.  Of a node's other pairs, those with an item outside of its
largest component, either its children are looked at or blocks of the node and of the rest are compared, whichever takes
fewer rows.  Both ways look at all of these pairs.

Leaves are compared by signatures of one byte a coordinate first; candidates then by their full shingle sets.  Confirmed links
make components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import claim, cut, partitions
from .components import stars
from .shingles import COORDINATES, shingles, signature

PERCENT = 85
TREES, BRANCH, LEAF, NODE = 4, 2, 256, 6000
#: Items of a node that its other items meet, items that meet them at a time, and items that are confirmed together.
HUBS, MEETING, STAR = 64, 512, 128
#: Items of each side of a block.
BLOCK = 1024
#: What a row of a level of branching costs, in rows of blocks.
LEVEL = 4.0
#: Columns of the incidence matrix that intersections are counted by at a time, and rows of each side.
COLUMNS, ROWS = 8192, 256
#: Shingles of a part that is confirmed at once.
PART_SHINGLES = 2 << 20

ROOTS = TREES * BRANCH
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("item", pa.binary()), ("roots", pa.list_(pa.int32())), ("low", pa.binary())])
_SIGNED_SQL = "doc_id bigint, n_shingles bigint, item binary, roots array<int>, low binary"


def _key(s: np.ndarray) -> bytes:
    """The name of a shingle set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def _sign(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                s = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"")
                sig = signature(s) if len(s) else np.zeros(0, np.uint32)
                rows.append({"doc_id": doc_id, "n_shingles": len(s), "item": _key(s), "roots": sig[:ROOTS].view(np.int32), "low": sig.astype(np.uint8).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, _SIGNED)


def _groups(rows: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys, each whole; rows come sorted."""
    claim("groups", lambda: None)
    held: list[pa.RecordBatch] = []
    for batch in rows:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _dealt(df: DataFrame, key: str, *then: str) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), key).sortWithinPartitions(key, *then)


def _tolerance(percent: int) -> float:
    """Agreement that a linked pair falls below about once in 300,000 times."""
    s = percent / 100
    return s - 4.5 * (s * (1 - s) / COORDINATES) ** 0.5


def _lows(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(table.num_rows, COORDINATES)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coordinates that each row of a has in common with each of b."""
    out = np.empty((len(a), len(b)), np.uint8)
    step = max(1, (1 << 21) // (COORDINATES * max(1, len(b))))
    for at in range(0, len(a), step):
        out[at : at + step] = (a[at : at + step, None] == b).sum(2, dtype=np.uint8)
    return out


def _parts(near: np.ndarray) -> Iterator[np.ndarray]:
    """Members of each connected part of a symmetric matrix of neighbours that has more than one."""
    left = near.any(1)
    while left.any():
        seen = np.zeros(len(near), bool)
        front = np.zeros(len(near), bool)
        front[left.argmax()] = True
        while front.any():
            seen |= front
            front = near[front].any(0) & ~seen
        left &= ~seen
        yield np.flatnonzero(seen)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 5000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _stars(least: float):
    """(node, item, hub, agree): each item's nearest hub if it is near enough, and for each unit with no item the mean agreement of hubs."""

    def rows(batches):
        for table in _groups(batches, "unit"):
            low, hub = _lows(table), table["hub"].to_numpy(zero_copy_only=False)
            items, node = table["item"].to_pylist(), table["node"][0].as_py()
            hubs, others = np.flatnonzero(hub), np.flatnonzero(~hub)
            among = _agreement(low[hubs], low[hubs])
            n = len(hubs)
            yield node, None, None, float((among.sum(dtype=np.int64) - n * COORDINATES) / max(1, n * (n - 1)) / COORDINATES)
            if len(others):
                agree = _agreement(low[others], low[hubs])
                best = agree.argmax(1)
                for i in np.flatnonzero(agree.max(1) >= least * COORDINATES):
                    yield node, items[others[i]], items[hubs[best[i]]], float(agree[i, best[i]] / COORDINATES)

    return lambda batches: _batches(rows(batches), ["node", "item", "hub", "agree"], [pa.int64(), pa.binary(), pa.binary(), pa.float64()])


def _key_of(members: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b"".join(members)) - (1 << 63)


def _leaves(low: np.ndarray, rows: np.ndarray, path: int) -> Iterator[np.ndarray]:
    """Rows of the leaves below a node of these rows: children by two coordinates that follow from the path, while that is less work."""
    m = len(rows)
    if m > LEAF:
        some = low[rows[:: max(1, m // HUBS)]]
        alike = min(0.999, max(0.01, float((_agreement(some, some).mean() * len(some) / COORDINATES - 1) / (len(some) - 1))))
        if (BRANCH * alike) ** (np.log(m / LEAF) / -np.log(alike)) * LEAF * LEVEL < m:
            step = 1 + path // COORDINATES % (COORDINATES - 1)
            for i in range(BRANCH):
                at = (path + i * step) % COORDINATES
                order = rows[np.argsort(low[rows, at], kind="stable")]
                value = low[order, at]
                for child in np.split(order, np.flatnonzero(value[1:] != value[:-1]) + 1):
                    if len(child) > 1:
                        yield from _leaves(low, child, xxhash.xxh3_64_intdigest(bytes((at, int(low[child[0], at]))), seed=path))
            return
    yield rows


def _near(low: np.ndarray, path: int, least: float) -> np.ndarray:
    """Which items are neighbours: near enough by signatures in some leaf."""
    near = np.zeros((len(low), len(low)), bool)
    for rows in _leaves(low, np.arange(len(low)), path):
        near[np.ix_(rows, rows)] |= _agreement(low[rows], low[rows]) >= least * COORDINATES
    near[np.arange(len(low)), np.arange(len(low))] = False
    return near


def _stars_of(low: np.ndarray, part: np.ndarray, near: np.ndarray) -> Iterator[np.ndarray]:
    """A part in groups of at most STAR: the items nearest to each of some hubs, those with the most neighbours of a draw, and the hub."""
    drawn = part[:: max(1, len(part) // (4 * HUBS))]
    hubs = drawn[np.argsort(-near[np.ix_(drawn, part)].sum(1), kind="stable")[: max(8, len(drawn) // 4)]]
    others = np.setdiff1d(part, hubs)
    best = _agreement(low[others], low[hubs]).argmax(1)
    yield from np.split(hubs, range(STAR, len(hubs), STAR))
    for h, hub in enumerate(hubs):
        mine = others[best == h]
        for at in range(0, len(mine), STAR - 1):
            yield np.r_[hub, mine[at : at + STAR - 1]]


def _candidates(least: float):
    """(part, size, item): what is to be confirmed together first, of each unit (a node)."""

    def rows(batches):
        for table in _groups(batches, "unit"):
            low, items = _lows(table), table["item"].to_pylist()
            near = _near(low, table["unit"][0].as_py() & (1 << 63) - 1, least)
            for part in _parts(near):
                for group in [part] if len(part) <= STAR else _stars_of(low, part, near):
                    members = sorted({items[i] for i in group})
                    key = _key_of(members)
                    for item in members:
                        yield key, len(members), item, True

    return lambda batches: _batches(rows(batches), *_PART)


def _chunks(weight: np.ndarray, most: int) -> list[np.ndarray]:
    """Places in runs whose weights add up to at most ``most``, unless one alone has more."""
    out, start, total = [], 0, 0
    for i, w in enumerate(weight.tolist()):
        if i > start and total + w > most:
            out.append(np.arange(start, i))
            start, total = i, 0
        total += w
    return [*out, np.arange(start, len(weight))]


def _remaining(least: float):
    """(part, size, item, rest): items of each unit with pairs that are near and not connected, of parts that were not confirmed whole.

    side: 0 for an item that meets all of its unit, 1 for one of the rest, which meets those of side 2.  Of every such pair one item
    is of the rest: what hangs together most is left out as soon as all others meet it.
    """

    def rows(batches):
        for table in _groups(batches, "unit"):
            low, side, weight = _lows(table), table["side"].to_numpy(), table["n_shingles"].to_numpy()
            items, label = table["item"].to_pylist(), _codes(table["label"].to_pylist())
            if side[0] == 0:
                near = _near(low, table["unit"][0].as_py() & (1 << 63) - 1, least)
                for part in _parts(near):
                    if len(part) <= STAR:
                        near[part] = False  # confirmed whole
            else:
                near = np.zeros((len(low), len(low)), bool)
                of, to = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
                near[np.ix_(of, to)] = _agreement(low[of], low[to]) >= least * COORDINATES
                near |= near.T
            near &= label[:, None] != label
            rest = near.any(1) & (label != np.bincount(label).argmax())
            for part in _parts(near):
                half = PART_SHINGLES if weight[part].sum() <= PART_SHINGLES else PART_SHINGLES // 2
                chunks = [part[c] for c in _chunks(weight[part], half)]
                for i, a in enumerate(chunks):
                    for b in chunks[i:] if len(chunks) == 1 else chunks[i + 1 :]:
                        some = a if a is b else np.r_[a, b]
                        if not near[np.ix_(a, b)].any() and not (len(chunks) > 1 and (near[np.ix_(a, a)].any() or near[np.ix_(b, b)].any())):
                            continue
                        members = dict(sorted({items[k]: bool(rest[k]) for k in some}.items()))
                        key = _key_of(list(members))
                        for item, of_rest in members.items():
                            yield key, len(members), item, of_rest

    return lambda batches: _batches(rows(batches), *_PART)


_PART = ["part", "size", "item", "rest"], [pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
_PART_SQL = "part bigint, size int, item binary, rest boolean"


def _codes(names: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(x, len(known)) for x in names], np.int64)


def links_among(sets: list[np.ndarray], percent: int, rest: np.ndarray | None = None) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for every two sets (of distinct numbers) of which one is of the ``rest``.

    Intersections are products of incidence matrices over the numbers that several sets have, block by block.  No set is linked with itself.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    column = np.cumsum(np.r_[True, value[1:] != value[:-1]]) - 1
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    kept = shared[column]
    column, owner, columns = number[column[kept]], owner[kept], int(shared.sum())
    linked = np.zeros((n, n), bool)
    some = np.arange(n) if rest is None else np.flatnonzero(rest)
    place = np.full(n, -1)
    for a in range(0, len(some), ROWS):
        of = some[a : a + ROWS]
        place[:] = -1
        place[of] = np.arange(len(of))
        both = np.zeros((len(of), n), np.float32)  # counts under 2 ** 24 are exact
        for at in range(0, columns, COLUMNS):
            i, j = np.searchsorted(column, [at, at + COLUMNS])
            own = place[owner[i:j]] >= 0
            left = np.zeros((len(of), COLUMNS), np.float32)
            left[place[owner[i:j][own]], column[i:j][own] - at] = 1
            for b in range(0, n, ROWS):
                these = (owner[i:j] >= b) & (owner[i:j] < b + ROWS)
                right = np.zeros((min(ROWS, n - b), COLUMNS), np.float32)
                right[owner[i:j][these] - b, column[i:j][these] - at] = 1
                both[:, b : b + ROWS] += left @ right.T
        common = both.astype(np.int64)  # of ROWS rows
        linked[of] = 100 * common >= percent * (size[of][:, None] + size - common)
    linked |= linked.T
    linked[np.arange(n), np.arange(n)] = False
    return linked


def _confirm(percent: int):
    """Links of each part, confirmed on full sets, as stars around the smallest of what hangs together."""

    def rows(batches):
        for table in _groups(batches, "part"):
            items = table["item"].to_pylist()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
            for part in _parts(links_among(sets, percent, table["rest"].to_numpy(zero_copy_only=False))):
                names = sorted(items[i] for i in part)
                for name in names[1:]:
                    yield name, names[0]

    return lambda batches: _batches(rows(batches), ["a", "b"], [pa.binary(), pa.binary()])


def _sets(batches):
    """(item, shingles) of rows (item, text) whose text has the set that the item names."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            made = [(item, s) for item, text in zip(part.column(0).to_pylist(), part.column(1), strict=True) if _key(s := shingles(text.as_buffer().to_pybytes())) == item]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.binary()), pa.array([s.tobytes() for _, s in made], pa.binary())], ["item", "shingles"])


class Search:
    """What hangs together of items (item, doc_id, n_shingles, roots, low), whose texts are in ``rows`` (doc_id, text), and of ``links`` (a, b)."""

    def __init__(self, items: DataFrame, rows: DataFrame, percent: int, links: DataFrame | None = None):
        self.items, self.percent, self.least = items, percent, _tolerance(percent)
        self.rows = rows.filter("doc_id is not null and text is not null")
        self.slim = items.select("item", "low")
        self.weights = items.select("item", "n_shingles")
        self.links = links  # that are known: stars, once something has been confirmed
        self.labels: DataFrame | None = None

    def labelled(self, df: DataFrame, item: str = "item", label: str = "label") -> DataFrame:
        """``label``: the smallest item that each is connected with so far."""
        if self.labels is None:
            return df.withColumn(label, F.col(item))
        labels = self.labels.select(F.col("item").alias(item), F.col("label").alias(label))
        return df.join(labels, item, "left").withColumn(label, F.coalesce(label, item))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(item, shingles) of the items that are wanted."""
        ids = self.items.join(wanted.select("item").distinct(), "item", "left_semi").select("item", "doc_id")
        return self.rows.join(ids, "doc_id").select("item", "text").mapInArrow(_sets, "item binary, shingles binary").dropDuplicates(["item"])

    def confirm(self, parts: DataFrame, sets: DataFrame) -> None:
        """Adds the links of parts (part, item, rest) to what hangs together so far, of which a star is left."""
        met = _dealt(parts.select("part", "item", "rest").join(sets, "item"), "part", "item")
        links = cut(met.mapInArrow(_confirm(self.percent), "a binary, b binary"))
        self.links = stars(links if self.links is None else self.links.unionByName(links))
        self.labels = self.links.select(F.col("a").alias("item"), F.col("b").alias("label"))

    def grown(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of rows (node, item), (node, item, low, m) of nodes that one task looks through, and of larger ones."""
        sizes = nodes.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1")
        met = cut(nodes.join(sizes, "node").join(self.slim, "item"))
        return met.filter(F.col("m") <= NODE), met.filter(F.col("m") > NODE)

    def star(self, large: DataFrame, depth: int) -> DataFrame:
        """Connects what it can by hubs; (node, alike) of the large nodes."""
        drawn = Window.partitionBy("node").orderBy(F.xxhash64("item", "node", F.lit(depth)))
        hubs = large.withColumn("nth", F.row_number().over(drawn)).filter(F.col("nth") <= HUBS)
        units = F.ceil(F.col("m") / MEETING).cast("int")
        unit = lambda at: F.xxhash64("node", at).alias("unit")
        others = large.select(unit(F.pmod(F.xxhash64("item", "node"), units).cast("int")), "node", "item", "low", F.lit(False).alias("hub"))
        every = hubs.withColumn("at", F.explode(F.sequence(F.lit(0), units - 1))).select(unit(F.col("at")), "node", "item", "low", F.lit(True).alias("hub"))
        met = cut(_dealt(others.unionByName(every), "unit").mapInArrow(_stars(self.least), "node bigint, item binary, hub binary, agree double"))
        near = met.filter("item is not null").groupBy("item").agg(F.max_by("hub", F.struct("agree", "hub")).alias("hub"))
        near = self.labelled(self.labelled(near, "item", "own"), "hub", "other")
        near = cut(near.filter("own <> other").select("item", "hub"))
        if not near.isEmpty():
            chunks = near.groupBy("hub").agg(F.ceil(F.count("*") / STAR).cast("int").alias("chunks"))
            part = lambda at: F.xxhash64("hub", at).alias("part")
            rays = near.join(chunks, "hub").select(part(F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int")), "item")
            centres = chunks.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(part(F.col("at")), F.col("hub").alias("item"))
            parts = cut(rays.unionByName(centres).withColumn("rest", F.lit(True)))
            self.confirm(parts, self.sets(parts))
        return met.filter("item is null").groupBy("node").agg(F.max("agree").alias("alike"))

    def run(self) -> DataFrame:
        """(item, label): the smallest item that any other is connected with."""
        roots = F.array(*[F.xxhash64(F.lit(at), F.get("roots", F.lit(at))) for at in range(ROOTS)])
        small, large = self.grown(self.items.select(F.explode(roots).alias("node"), "item"))
        nodes, blocks, depth = [small], [], 0
        while not large.isEmpty():
            alike = self.star(large, depth)
            placed = cut(self.labelled(large))
            sizes = placed.groupBy("node", "label").agg(F.count("*").alias("k")).groupBy("node").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("m"), F.max("k").alias("most"))
            plan = sizes.filter("m > most").join(alike, "node").withColumn("rest", F.col("m") - F.col("most")).select("node", "main", *_ways(F.col("m"), F.col("rest"), F.col("alike")))
            placed = cut(placed.drop("m").join(plan, "node"))
            blocks.append(cut(_blocks(placed.filter("NOT branches"))))
            children = placed.filter("branches").select(F.explode(F.array(*[_child(i) for i in range(BRANCH)])).alias("node"), "item").distinct()
            small, large = self.grown(children)
            nodes.append(small)
            depth += 1
        self.compare(reduce(DataFrame.unionByName, nodes), blocks)
        return self.labels

    def compare(self, nodes: DataFrame, blocks: list[DataFrame]) -> None:
        """Candidates of all nodes and blocks, confirmed."""
        units = nodes.select(F.col("node").alias("unit"), "item", "low")
        found = _dealt(units, "unit", "item").mapInArrow(_candidates(self.least), _PART_SQL)
        parts = cut(found.repartition(partitions(units.sparkSession), "item").distinct(), dealt=True)  # an item is in few parts
        # a part that lies in a larger one is not needed: then all its items have that one as their largest
        largest = parts.groupBy("item").agg(F.max(F.struct("size", "part")).alias("largest"))
        inner = parts.join(largest, "item").groupBy("part").agg(F.min("largest.part").alias("low"), F.max("largest.part").alias("high")).filter("low = high and part <> low").select("part")
        again = nodes.filter(F.col("m") > STAR).select(F.col("node").alias("unit"), "item", "low")
        wanted = reduce(DataFrame.unionByName, [x.select("item") for x in (parts, again, *blocks)])
        sets = cut(self.sets(wanted), dealt=True)
        self.confirm(parts.join(inner, "part", "left_anti"), sets)
        units = self.labelled(again).withColumn("side", F.lit(0))
        for some in blocks:
            units = units.unionByName(self.labelled(some).select(units.columns))
        units = units.join(self.weights, "item")
        left = cut(_dealt(units, "unit", "item").mapInArrow(_remaining(self.least), _PART_SQL).groupBy("part", "size", "item").agg(F.max("rest").alias("rest")))
        if not left.isEmpty():
            self.confirm(left, sets)


def _child(i: int) -> Column:
    """The i-th child of each node: its coordinate follows from the hash of the path."""
    at = F.pmod(F.xxhash64("node", F.lit(0)) + i * (1 + F.pmod(F.xxhash64("node", F.lit(1)), F.lit(COORDINATES - 1))), F.lit(COORDINATES)).cast("int")
    return F.xxhash64("node", at, F.substring("low", at + 1, F.lit(1)))


def _ways(m: Column, rest: Column, alike: Column) -> list[Column]:
    """chunks and cuts (numbers of blocks of the rest and of the node), and whether branching takes fewer rows than they do.

    A level of branching leaves a share ``alike`` of a node in a child, BRANCH * alike rows for one.  Its rows count LEVEL
    times, for the steps that a level takes and for children that shrink less than the mean.
    """
    chunks, cuts = F.ceil(rest / BLOCK), F.ceil(m / BLOCK)
    p = F.least(F.greatest(alike, F.lit(0.01)), F.lit(0.999))
    levels = F.greatest(F.lit(1.0), F.log(m / NODE) / -F.log(p))
    ratio = BRANCH * p
    branching = m * F.when(F.abs(ratio - 1) < 0.01, levels).otherwise((F.pow(ratio, levels + 1) - ratio) / (ratio - 1))
    return [chunks.cast("int").alias("chunks"), cuts.cast("int").alias("cuts"), (LEVEL * branching < m * chunks + rest * cuts).alias("branches")]


def _blocks(placed: DataFrame) -> DataFrame:
    """(unit, item, low, side): every block of a node's rest beside every block of the node."""
    spot = lambda n: F.pmod(F.xxhash64("item", "node"), n).cast("int")
    count = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    unit = F.xxhash64("node", "chunk", "block").alias("unit")
    rest = placed.filter("label <> main").withColumn("chunk", spot(F.col("chunks"))).withColumn("block", count(F.col("cuts"))).select(unit, "item", "low", F.lit(1).alias("side"))
    every = placed.withColumn("block", spot(F.col("cuts"))).withColumn("chunk", count(F.col("chunks"))).select(unit, "item", "low", F.lit(2).alias("side"))
    return rest.unionByName(every)


def link(df: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest id
    reachable over links, kept says whether that is the document's own.  A text without words (or null) is linked with
    nothing.  Rows that share an id are linked with each other, whatever their texts, and are rows of their own in the
    result.  A row with a null id is linked with nothing, is kept, and has no component.  Other columns are not looked at; an
    empty table gives an empty table.
    """
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = cut(rows.mapInArrow(_sign, _SIGNED_SQL))
    known = signed.filter("n_shingles > 0 and doc_id is not null")
    by_item = known.groupBy("item").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("roots").alias("roots"), F.first("low").alias("low"))
    items = cut(by_item.repartition(partitions(df.sparkSession), "item"), dealt=True)  # joins by item below find it dealt already
    # rows that share an id but not a set hang together by the id
    ids = known.groupBy("doc_id").agg(F.min("item").alias("one"), F.max("item").alias("other")).filter("one <> other").select("doc_id", "one")
    by_id = cut(known.join(ids, "doc_id").filter("item <> one").select(F.col("item").alias("a"), F.col("one").alias("b")).distinct())
    labels = Search(items, rows, percent, None if by_id.isEmpty() else by_id).run()
    placed = items.select("item", "doc_id").join(labels, "item", "left").withColumn("label", F.coalesce("label", "item"))
    placed = placed.join(placed.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("item", "component_id")
    done = signed.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "item").join(placed, "item").select("doc_id", "n_shingles", "component_id")
    # a document that has an id with others that have words goes with them
    bare = signed.filter("n_shingles = 0 and doc_id is not null").select("doc_id", "n_shingles")
    bare = bare.join(done.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    lone = signed.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"))
    return done.unionByName(bare).unionByName(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
