"""Ranked lexical search with Block-Max WAND.

Documents are dealt to index shards as they are read, some thousands in a shard, in order of id.  A term's postings in a shard
are cut into blocks of BLOCK documents.  A block is compressed (gaps between documents, and occurrences, each in as few
bytes as its largest needs) and stands beside its last document and the largest impact that the term has in it.

A query follows its terms' lists through a shard.  Between two block ends no list changes its block, so that the sum of
maxima over the blocks that the lists' shallow pointers stand at bounds every document there.  Stretches whose bound does not pass the k-th best
score so far are skipped, with blocks unread.  Where it does, blocks are decompressed, first their documents: only those whose
own lists' maxima pass the threshold are pivots, and only pivots are scored.  Stretches next to each other are taken
together (up to RUN documents), so that each step is a few array operations.

The score of a document is the sum over the query's terms (repeats included) of  weight * ((10^9 * tf) div (1000 * tf + 12 * m)),  with
weight = floor(1000 * ln((2N + 2) / (2 df + 1)))  and  m = 75 + (25 * n * N) div L;  N documents with a term, L terms in all, n in the
document, df documents with the term, tf times in the document.  All but the logarithm is whole numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .words import starts, words

TOP, BLOCK, RUN = 20, 128, 1024
#: Documents and bytes of text of a shard at most (but for one longer text).
SHARD_DOCS, SHARD_BYTES = 16_384, 48 << 20
#: Bytes of query texts behind one broadcast.
QUERY_BYTES = 8 << 20
#: Documents whose terms are counted together.
COUNTED = 200
#: Decompressed blocks that a worker keeps.
KEPT_BLOCKS = 20_000

_INDEX_SQL = "n_docs int, doc_ids array<bigint>, lengths binary, terms array<binary>, dfs array<int>, firsts binary, lasts binary, maxima binary, widths binary, offsets binary, data binary"


class _Known(dict):
    """Numbers of terms; -1 for one that is not asked for."""

    def __missing__(self, term: bytes) -> int:
        return -1


class _Every(dict):
    """Numbers of terms, given as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def norm(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 75 + (25 * lengths.astype(np.int64) * n_docs) // max(1, n_terms)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Gathers documents, then cuts their postings into blocks."""

    def __init__(self, known: set[bytes] | None):
        self.numbers = _Every() if known is None else _Known({t: i for i, t in enumerate(sorted(known))})
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (document, term, times)
        self.waiting: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        found = words(text)
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.bytes += len(text or b"")
        self.waiting.append(np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found)))
        if len(self.waiting) >= COUNTED:
            self.count()

    def count(self) -> None:
        first = len(self.ids) - len(self.waiting)
        term = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(first, len(self.ids)), [len(x) for x in self.waiting])
        keys, times = np.unique((doc << 32 | term)[term >= 0], return_counts=True)
        self.parts.append(((keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32)))
        self.waiting = []

    def row(self, n_docs: int, n_terms: int) -> list:
        self.count()
        by_id = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        rank = np.empty(len(by_id), np.int64)
        rank[by_id] = np.arange(len(by_id))
        lengths = np.array(self.lengths, np.int32)[by_id]
        doc, term, times = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        doc = rank[doc]
        order = np.lexsort((doc, term))
        doc, term, times = doc[order], term[order].astype(np.int64), times[order].astype(np.int64)
        begins = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][: len(term)])
        df = np.diff(np.r_[begins, len(term)])
        blocks = -(-df // BLOCK)
        block_of = np.repeat(np.arange(len(df)), blocks)
        first = begins[block_of] + (np.arange(int(blocks.sum())) - np.repeat(starts(blocks), blocks)) * BLOCK
        behind = np.minimum(first + BLOCK, (begins + df)[block_of])
        gaps = np.diff(doc, prepend=-1)
        gaps[begins] = doc[begins] + 1
        maxima = np.maximum.reduceat(impact(times, norm(lengths, n_docs, n_terms)[doc]), first) if len(first) else np.zeros(0, np.int64)
        wide = lambda x: (np.searchsorted([1 << 8, 1 << 16], np.maximum.reduceat(x, first), "right") if len(first) else np.zeros(0, np.int64)).tolist()
        gap_width, time_width = wide(gaps), wide(times)
        kinds = (np.uint8, np.uint16, np.uint32)
        data = [gaps[a:b].astype(kinds[g]).tobytes() + times[a:b].astype(kinds[t]).tobytes() for a, b, g, t in zip(first.tolist(), behind.tolist(), gap_width, time_width, strict=True)]
        names = dict(zip(self.numbers.values(), self.numbers, strict=True))
        raw = lambda x, kind: np.asarray(x).astype(kind).tobytes()
        return [
            len(self.ids), [self.ids[i] for i in by_id], lengths.tobytes(), [names[t] for t in term[begins].tolist()], df.tolist(), raw(np.r_[starts(blocks), blocks.sum()], np.int32), raw(doc[behind - 1] if len(first) else [], np.int32),
            raw(maxima, np.int32), raw(np.array(gap_width, np.uint8) * 4 + np.array(time_width, np.uint8), np.uint8), raw(np.r_[0, np.cumsum([len(d) for d in data])], np.int64), b"".join(data),
        ]


_INDEX = pa.schema([
    ("n_docs", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("terms", pa.list_(pa.binary())), ("dfs", pa.list_(pa.int32())), ("firsts", pa.binary()), ("lasts", pa.binary()),
    ("maxima", pa.binary()), ("widths", pa.binary()), ("offsets", pa.binary()), ("data", pa.binary()),
])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for text in batch.column(0):
            n = len(words(text.as_py()))
            docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["docs", "terms"])


def statistics(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """N and L: documents with at least one term, and terms of all documents with repeats."""
    counted = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(_count, "docs bigint, terms bigint")
    n_docs, n_terms = counted.agg(F.sum("docs"), F.sum("terms")).first()
    return n_docs or 0, n_terms or 0


def _build(n_docs: int, n_terms: int, only):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if only is None else only.value
        shard = Shard(known)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                shard.add(doc_id.as_py(), text.as_py())
                if len(shard.ids) >= SHARD_DOCS or shard.bytes >= SHARD_BYTES:
                    yield _one(shard.row(n_docs, n_terms))
                    shard = Shard(known)
        if shard.ids:
            yield _one(shard.row(n_docs, n_terms))

    return run


def _one(row: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _INDEX, strict=True)], schema=_INDEX)


def build_index(docs: DataFrame, n_docs: int, n_terms: int, only: Iterable[bytes] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each shard: its documents, and every term's blocks.  ``only`` leaves out the postings of other terms.

    Written to the checkpoint folder.  One pass without a shuffle; a shard is what one task reads, in parts of bounded size.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    shared = None if only is None else docs.sparkSession.sparkContext.broadcast(set(only))
    return cut(rows.mapInArrow(_build(n_docs, n_terms, shared), _INDEX_SQL))


class Searcher:
    """One shard, as it is searched."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        array = lambda name, kind: np.frombuffer(row[name], kind)
        self.term = {t: i for i, t in enumerate(row["terms"])}
        self.doc_ids, self.m = row["doc_ids"], norm(array("lengths", np.int32), n_docs, n_terms)
        self.firsts, self.lasts, self.maxima = array("firsts", np.int32), array("lasts", np.int32), array("maxima", np.int32).astype(np.int64)
        self.widths, self.offsets, self.data = array("widths", np.uint8), array("offsets", np.int64), row["data"]
        self.docs: dict[int, np.ndarray] = {}
        self.impacts: dict[int, np.ndarray] = {}
        #: blocks whose documents were decompressed, counted with repeats
        self.opened = 0

    def _kinds(self, block: int) -> tuple[np.dtype, np.dtype, int]:
        gap, times = (np.dtype((np.uint8, np.uint16, np.uint32)[w]) for w in divmod(int(self.widths[block]), 4))
        return gap, times, int(self.offsets[block + 1] - self.offsets[block]) // (gap.itemsize + times.itemsize)

    def documents(self, block: int, first: int) -> np.ndarray:
        """Of a block of the list whose first block is ``first``."""
        self.opened += 1
        if (found := self.docs.get(block)) is None:
            gap, _, n = self._kinds(block)
            base = int(self.lasts[block - 1]) if block > first else -1
            found = base + np.cumsum(np.frombuffer(self.data, gap, n, int(self.offsets[block])), dtype=np.int64)
            if len(self.docs) >= KEPT_BLOCKS:
                self.docs.clear()
                self.impacts.clear()
            self.docs[block] = found
        return found

    def impact(self, block: int, docs: np.ndarray) -> np.ndarray:
        if (found := self.impacts.get(block)) is None:
            gap, times, n = self._kinds(block)
            tf = np.frombuffer(self.data, times, n, int(self.offsets[block]) + n * gap.itemsize).astype(np.int64)
            found = self.impacts[block] = impact(tf, self.m[docs])
        return found

    def top(self, query: dict[bytes, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the shard (by place) and scores of the k best, for terms and their weights."""
        lists = [(int(self.firsts[t]), int(self.firsts[t + 1]), w) for term, w in query.items() if w > 0 and (t := self.term.get(term)) is not None]
        best, scores, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if not lists:
            return best, scores
        ends = np.unique(np.concatenate([self.lasts[a:b] for a, b, _ in lists])).astype(np.int64)
        # the shallow pointers: for each stretch that ends at a block's end, the block that each list stands at
        pointers = [a + np.searchsorted(self.lasts[a:b], ends) for a, b, _ in lists]
        bound = np.zeros(len(ends), np.int64)
        for (a, b, w), at in zip(lists, pointers, strict=True):
            on = at < b
            bound[on] += w * self.maxima[at[on]]
        at = 0
        while at < len(ends):
            live = bound[at:] > threshold
            if not live.any():
                break
            at += int(live.argmax())  # past all stretches under the threshold
            low = int(ends[at - 1]) if at else -1
            stop = at + int(np.r_[bound[at:] > threshold, False].argmin())
            stop = max(at + 1, min(stop, int(np.searchsorted(ends, low + RUN, "right"))))
            high = int(ends[stop - 1])
            bounds, held = np.zeros(high - low, np.int64), []
            for (a, b, w), place in zip(lists, pointers, strict=True):
                for block in range(int(place[at]), min(int(place[stop - 1]) + 1, b)):
                    docs = self.documents(block, a)
                    i, j = np.searchsorted(docs, (low + 1, high + 1))
                    if i < j:
                        bounds[docs[i:j] - low - 1] += w * self.maxima[block]
                        held.append((block, docs, i, j, w))
            pivot = bounds > threshold
            total = np.zeros(high - low, np.int64)
            for block, docs, i, j, w in held:
                own = docs[i:j] - low - 1
                if (on := pivot[own]).any():
                    total[own[on]] += w * self.impact(block, docs)[i:j][on]
            more = np.flatnonzero(total > threshold)
            if len(more):
                best, scores = np.r_[best, more + low + 1], np.r_[scores, total[more]]
                order = np.lexsort((best, -scores))[:k]
                best, scores = best[order], scores[order]
                threshold = int(scores[-1]) if len(scores) == k else 0
            at = stop
        return best, scores


def _search(name: str, shared, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                searcher = Searcher(batch.slice(i, 1).to_pylist()[0], n_docs, n_terms)
                number, ids, scores = [], [], []
                for q, query in enumerate(queries):
                    best, score = searcher.top(query, k)
                    number += [q] * len(best)
                    ids += [searcher.doc_ids[d] for d in best.tolist()]
                    scores += score.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["query", "doc_id", "score"])

    return run


def search(index: DataFrame, queries: list[tuple[int | None, dict[bytes, int]]], n_docs: int, n_terms: int, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each of these queries (a bounded number), over all shards.

    Each shard gives its k best; shards are not shuffled.
    """
    spark = index.sparkSession
    terms = {t for _, counts in queries for t in counts}
    frequency = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    asked = F.broadcast(spark.createDataFrame([(bytearray(t),) for t in sorted(terms)], "term binary"))
    df = {bytes(r[0]): r[1] for r in frequency.join(asked, "term").groupBy("term").agg(F.sum("df")).collect()}  # of the queries' terms alone
    weighted = [{t: n * weight(n_docs, df[t]) for t, n in counts.items() if t in df} for _, counts in queries]
    found = index.mapInArrow(_search(uuid.uuid4().hex, spark.sparkContext.broadcast(weighted), n_docs, n_terms, k), "query int, doc_id bigint, score bigint")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = F.broadcast(spark.createDataFrame([(i, item) for i, (item, _) in enumerate(queries)], "query int, item_id bigint"))
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")


def _counts(text: bytes | None) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for w in words(text):
        out[w] = out.get(w, 0) + 1
    return out


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score: the k documents of highest score above zero for each item, equal scores by ascending id.

    A null text has no terms.  Every row of documents is one of its own, those with a null id stand behind others of equal score.
    Items that repeat in id and text are one; items that share an id but not the text are ranked each for itself; items
    without terms, and those whose terms are all in no document, have no rows.  Texts of any length count whole.  Other columns are not looked at.
    Items are taken in blocks of at most QUERY_BYTES; more than one block search an index of all terms, one block an index of its own.
    """
    n_docs, n_terms = statistics(docs, text)
    asked = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(query).cast("binary").alias("text")).filter("text is not null").distinct()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(total / QUERY_BYTES))
    dealt = cut(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))))
    index, out = None if blocks == 1 else build_index(docs, n_docs, n_terms, None, doc_id, text), None
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).select("item_id", "text").collect()
        queries = sorted(((r[0], _counts(bytes(r[1]))) for r in rows), key=lambda q: (q[0] is None, q[0] or 0))
        own = index if index is not None else build_index(docs, n_docs, n_terms, {t for _, c in queries for t in c}, doc_id, text)
        found = search(own, queries, n_docs, n_terms, k)
        out = found if out is None else out.unionByName(found)
    return out
