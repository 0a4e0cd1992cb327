"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and items become words, padded with single spaces.  A window of an item is WINDOW consecutive words, or all words of an item that
has fewer; its padded form is a pattern, and it occurs where the pattern does.  Patterns are searched for in classes of
similar length.  A class looks at the first ``m`` bytes of its patterns (``m`` is its shortest pattern's length) in blocks of ``b`` bytes:

* the shift table says, for the block that ends at a place, how far no pattern's first ``m`` bytes can end, so that these
  places are skipped;
* where the shift is zero, the bucket of that block's hash has the patterns whose first ``m`` bytes end in such a block;
* those whose first bytes fit are compared with the text, byte by byte.

A worker puts texts one behind the other and lets many pointers run over them at once, each over a stretch of its own, so a
step is a few array operations for all of them.

Documents are not shuffled.  Patterns are broadcast in blocks of at most BLOCK_BYTES, whatever the size of the benchmark; every block meets all
documents, and what blocks find of a document is put together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .words import padded, starts, words

WINDOW = 10
#: Bytes of patterns (and eight for each item that has one) behind one broadcast.
BLOCK_BYTES = 32 << 20
#: Bytes of words that are searched at once (unless one text is longer), and bytes of a pointer's stretch.
TEXT_BYTES, STRETCH = 2 << 20, 512
#: Lengths of patterns from which classes begin, and the most bytes of a block.
CLASSES, WIDEST = (0, 8, 16, 32), 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Class:
    """Tables of patterns of similar length."""

    def __init__(self, patterns: list[bytes], numbers: np.ndarray):
        self.patterns, self.numbers = patterns, numbers
        self.m = m = min(map(len, patterns))
        self.block = max(1, min(WIDEST, m // 2))
        self.drop = np.uint64(8 * (8 - self.block))
        # eight bytes before the first m, so that every block can be read as the end of eight bytes
        heads = np.frombuffer(b"".join(b"\0" * 8 + p[:m] for p in patterns), np.uint8).reshape(len(patterns), m + 8)
        ends = np.arange(self.block - 1, m)
        self.bits = np.uint64(64 - min(22, max(8, (4 * len(patterns) * len(ends)).bit_length())))
        self.shift = np.full(1 << int(np.uint64(64) - self.bits), m - self.block + 1, np.uint8 if m < 250 else np.int32)
        for end in ends:
            eight = np.ascontiguousarray(heads[:, end + 1 : end + 9]).view("<u8").ravel()
            np.minimum.at(self.shift, self.hash(eight), m - 1 - end)
        last = self.hash(np.ascontiguousarray(heads[:, m : m + 8]).view("<u8").ravel())
        self.order = np.argsort(last, kind="stable")
        counts = np.bincount(last, minlength=len(self.shift))
        self.first = np.r_[0, np.cumsum(counts)].astype(np.int32)
        self.prefix = np.ascontiguousarray(heads[self.order, 8 : 8 + min(8, m)])

    def hash(self, eight: np.ndarray) -> np.ndarray:
        """Of the last ``block`` of eight bytes each."""
        return ((eight >> self.drop) * _MIX >> self.bits).astype(np.int64)

    def search(self, text: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of all occurrences; ``text`` has eight bytes in front that are in no pattern."""
        eights = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))  # eights[i] ends at byte i + 7
        begin = np.arange(8 + self.m - 1, len(text), STRETCH)  # where a pattern's first m bytes may end
        end = np.minimum(begin + STRETCH, len(text))
        at, stop, places = begin, end, []
        while len(at):
            shift = self.shift[self.hash(eights[at - 7])]
            if (hit := shift == 0).any():
                places.append(at[hit])
            at = at + np.maximum(shift, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        found_at, found = [], []
        if places:
            place = np.concatenate(places)
            bucket = self.hash(eights[place - 7])
            a, n = self.first[bucket], self.first[bucket + 1] - self.first[bucket]
            begins = np.repeat(place - (self.m - 1), n)
            candidates = np.repeat(a - starts(n), n) + np.arange(int(n.sum()))
            same = np.ones(len(begins), bool)
            for i in range(self.prefix.shape[1]):
                same[same] = text[begins[same] + i] == self.prefix[candidates[same], i]
            for start, i in zip(begins[same].tolist(), self.order[candidates[same]].tolist(), strict=True):
                if raw.startswith(self.patterns[i], start):
                    found_at.append(start)
                    found.append(i)
        return np.array(found_at, np.int64), self.numbers[np.array(found, np.int64)]


class Patterns:
    """Padded windows with the items that have them, in classes by length."""

    def __init__(self, patterns: list[bytes], items: list[list]):
        self.items = items
        self.words = np.array([p.count(b" ") - 1 for p in patterns], np.int64)
        lengths = np.array([len(p) for p in patterns], np.int64)
        belongs = np.searchsorted(CLASSES, lengths, "right")
        self.classes = [_Class([patterns[i] for i in np.flatnonzero(belongs == c)], np.flatnonzero(belongs == c)) for c in np.unique(belongs)]

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        """For each of the padded texts: its number of words, the runs (first, behind) of words that are hit, and the items."""
        raw = b"\n" * 8 + b"\n".join(texts) + b"\n"
        text = np.frombuffer(raw, np.uint8)
        spaces = np.flatnonzero(text == 0x20)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = 8 + starts(lengths + 1)
        first_space = np.searchsorted(spaces, begins)
        n_words = np.searchsorted(spaces, begins + lengths) - first_space - 1
        found = [c.search(text, raw) for c in self.classes]
        at, which = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        doc = np.searchsorted(begins, at, "right") - 1
        order = np.lexsort((at, doc))
        at, which, doc = at[order], which[order], doc[order]
        word = np.searchsorted(spaces, at) - first_space[doc]
        behind = word + self.words[which]
        ranges = np.searchsorted(doc, np.arange(len(texts) + 1))
        for n, a, b in zip(n_words.tolist(), ranges[:-1].tolist(), ranges[1:].tolist(), strict=True):
            items = set().union(*(self.items[w] for w in set(which[a:b].tolist())))
            yield n, runs(zip(word[a:b].tolist(), behind[a:b].tolist(), strict=True)), items


def runs(spans) -> list[tuple[int, int]]:
    """The union of (first, behind) in order of first."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                patterns, ids = [], []
                for item_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = words(text)
                    for i in range(max(1, len(found) - window + 1) if found else 0):
                        patterns.append(padded(found[i : i + window]))
                        ids.append(item_id)
                yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.binary()), pa.array(ids, pa.int64())], ["pattern", "item_id"])

    return run


def item_windows(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """pattern and item_id, each pair once; items without words, or with a null id, have none."""
    rows = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).cast("binary").alias("text")).filter("item_id is not null and text is not null")
    return rows.mapInArrow(_windows(window), "pattern binary, item_id bigint").distinct()


def _by_bytes(batches: Iterator[pa.RecordBatch], texts_at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with their texts as padded words, of about TEXT_BYTES."""
    for batch in batches:
        begin, held, size = 0, [], 0
        column = batch.column(texts_at)
        for i in range(batch.num_rows):
            held.append(padded(words(column[i].as_py())))
            size += len(held[-1])
            if size >= TEXT_BYTES or i == batch.num_rows - 1:
                yield batch.slice(begin, i + 1 - begin), held
                begin, held, size = i + 1, [], 0


_HIT = pa.schema([("n_words", pa.int64()), ("hit", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.int64()))])
_FIELDS = "n_words bigint, hit array<array<int>>, items array<bigint>"
_tables: dict[str, Patterns] = {}


def _search(name: str, shared):
    """``name`` is that of the broadcast: its tables are kept from task to task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _tables:
            _tables.clear()
            _tables[name] = Patterns(*shared.value)
        tables = _tables[name]
        for part, texts in _by_bytes(batches, 0):
            n, hit, items = zip(*tables.search(texts), strict=True)
            columns = [pa.array(c, f.type) for c, f in zip((n, hit, map(sorted, items)), _HIT, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], [*part.schema.names[1:], *_HIT.names])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What several blocks of patterns found of one text made one."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            hit = [runs(sorted(tuple(s) for spans in lists for s in spans)) for lists in part.column("hits").to_pylist()]
            items = [sorted({i for some in lists for i in some}) for lists in part.column("item_lists").to_pylist()]
            arrays = [part.column("doc_id"), part.column("n_words"), pa.array(hit, _HIT.field("hit").type), pa.array(items, _HIT.field("items").type), part.column("times")]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "hit", "items", "times"])


def occurrences(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, hit (runs of words inside occurrences, first and behind) and items (ids, ascending) of every row.

    A null text has no words.  Rows that share an id are looked at each for itself, and so are rows with a null id.  An item with a
    null id or without words is in no text; rows that repeat an item's id are one item with the windows of all.  Texts of
    any length are searched whole.  Other columns are not looked at.  An empty table gives an empty table; an empty benchmark hits nothing.
    """
    spark = df.sparkSession
    patterns = cut(item_windows(benchmark, window))
    total = patterns.agg(F.sum(F.octet_length("pattern") + 8)).first()[0] or 0
    blocks = max(1, ceil(total / BLOCK_BYTES))
    dealt = patterns.withColumn("block", F.pmod(F.xxhash64("pattern", "item_id"), F.lit(blocks)))  # an item that many have is dealt too
    rows = df.select(F.col(text).cast("binary").alias("text"), F.col(doc_id).cast("bigint").alias("doc_id"))
    found = []
    for block in range(blocks):
        own = dealt.filter(F.col("block") == block).groupBy("pattern").agg(F.sort_array(F.collect_list("item_id")).alias("items")).collect()
        shared = spark.sparkContext.broadcast(([bytes(r[0]) for r in own], [r[1] for r in own]))
        keyed = rows if blocks == 1 else rows.withColumn("of", F.xxhash64("text"))
        fields = f"doc_id bigint, {'' if blocks == 1 else 'of bigint, '}{_FIELDS}"
        found.append(keyed.mapInArrow(_search(uuid.uuid4().hex, shared), fields))
    if blocks == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # rows alike in id and text found the same in every block; ``times`` is how many there are
    met = every.groupBy("doc_id", "of", "n_words").agg(F.collect_set("hit").alias("hits"), F.collect_set("items").alias("item_lists"), (F.count("*") / blocks).cast("int").alias("times"))
    whole = met.drop("of").mapInArrow(_joined, f"doc_id bigint, {_FIELDS}, times int")
    return whole.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the item ids as strings, sorted, with commas between) and contaminated."""
    hits = occurrences(df, benchmark, window)
    n_hit = F.aggregate("hit", F.lit(0).cast("bigint"), lambda n, r: n + (F.get(r, 1) - F.get(r, 0)))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    rows = hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)
