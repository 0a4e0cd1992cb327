"""Removal of repeated passages: every byte covered by a ``match``-byte string that also starts in a document with a smaller id.

Texts are cut into phrases by prefix-free parsing (see ``phrases``), so that each window of ``match`` bytes lies in exactly
one phrase.  What many documents share then becomes one entry of a dictionary of phrases, with the smallest document that
holds it:

1. Phrases meet by the hash of their trigger.  An equal phrase in a smaller document settles all its windows at once.
2. Different phrases around the same trigger may still share windows (where a passage begins or ends).  Only for these the
   dictionary's bytes are fetched, and its suffixes sorted to the depth of a window; in each run of equal suffix heads the
   smallest document is the first in corpus order.
3. Spans go back to their documents, which are read again and cut.

Between steps, rows carry packed arrays: one row for a block of documents and a bucket of hashes.  A phrase that is common
reaches its bucket once for each block, whatever the number of documents that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import phrases
from .common import claim, cut

MATCH = 50
#: Bytes of text in a block that is parsed at once (unless one text is longer), and those behind a bucket.
BLOCK_BYTES, BUCKET_BYTES, BLOCK_TEXTS = 3 << 20, 6 << 20, 60_000
#: Suffixes sorted at once, unless one trigger alone has more.
SORTED_AT_ONCE = 1 << 20

_ROW = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
_ROW_SQL = "bucket int, payload binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one string: the number of items of each, then their bytes."""
    return np.array([len(a) for a in arrays], np.uint32).tobytes() + b"".join(a.tobytes() for a in arrays)


def unpack(payload: bytes, *kinds: str) -> list[np.ndarray]:
    at, out = 4 * len(kinds), []
    for n, kind in zip(np.frombuffer(payload, np.uint32, len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(payload, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    for a, b in zip(first, [*first[1:], len(order)], strict=True):
        yield int(sorted_[a]), order[a:b]


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_ROW)


def _used(of: np.ndarray, *tables: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows of the tables that ``of`` refers to, and ``of`` in terms of these."""
    used, new = np.unique(of, return_inverse=True)
    return *(t[used] for t in tables), new


def text_key(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw)


#: Kinds of the arrays between the steps: ids and keys of texts, then ...
PHRASES = "i8 u8 u4 u8 u2 u4 u1 u2 u4 u4".split()  # trigger, phrase, text, first window, windows; text, start, length of settled spans
SPANS = "i8 u8 u4 u4 u4 u4 u4 u1 u4".split()  # text, start, length of settled spans; text, first window, windows, trigger of open phrases
OPEN = "i8 u8 u4 u4 u4 u1 u1".split()  # text, trigger, first window, windows, bytes


def _settle(ids: np.ndarray, phrase: np.ndarray, more: np.ndarray | None = None):
    """Order by (more, phrase, id), and the smallest id of each phrase at each place of that order."""
    order = np.lexsort((ids, phrase) if more is None else (ids, phrase, more))
    p = phrase[order]
    new = np.r_[True, p[1:] != p[:-1]]
    if more is not None:
        new |= np.r_[True, more[order][1:] != more[order][:-1]]
    group = np.cumsum(new) - 1
    return order, new, group, ids[order][new][group]


def _merged(text: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Spans of each text, those that touch made one."""
    if not len(text):
        return text, start, length
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    stop = start + length[order]
    base = text.astype(np.int64) << 40  # in one line of numbers, texts far apart
    reach = np.maximum.accumulate(base + stop)
    new = np.r_[True, base[1:] + start[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(new) - 1]
    return text[new], start[new], (reach[last] - base[new]) - start[new]


def _parse_blocks(buckets: int, match: int):
    def block(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        keys = np.array([text_key(t) for t in texts], np.uint64)
        ids = np.array(ids, np.int64)
        ends = np.cumsum([len(t) for t in texts])
        text, low, count, trigger, phrase = phrases.parse(np.frombuffer(b"".join(texts), np.uint8), ends, match)
        order, _, _, smallest = _settle(ids[text], phrase)
        settled = order[ids[text][order] > smallest]
        open_ = np.sort(order[ids[text][order] == smallest])
        spans = _merged(text[settled], low[settled], count[settled] + match - 1)
        rows = []
        bucket = (trigger[open_] >> np.uint64(32)) % np.uint64(buckets)
        home = spans[0] % buckets  # settled spans ride along
        riders = dict(_by(home))
        for b, at in _by(bucket.astype(np.int64)):
            at, ride = open_[at], riders.pop(b, np.zeros(0, np.int64))
            rows.append((b, at, ride))
        rows += [(b, np.zeros(0, np.int64), ride) for b, ride in riders.items()]
        out = []
        for b, at, ride in rows:
            i, k, new = _used(np.r_[text[at], spans[0][ride]], ids, keys)
            out.append((b, pack(i, k, trigger[at].astype("u4"), phrase[at], new[: len(at)].astype("u2"), low[at].astype("u4"), count[at].astype("u1"), new[len(at) :].astype("u2"), spans[1][ride].astype("u4"), spans[2][ride].astype("u4"))))
        return _batch(out)

    def run(batches):
        claim("phrases", phrases.forget)
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(raw) < match or doc_id is None:
                    continue
                if texts and (size + len(raw) > BLOCK_BYTES or len(texts) >= BLOCK_TEXTS):
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield block(ids, texts)

    return run


def _meet(buckets: int, match: int):
    """Phrases with the same trigger hash, from all blocks: settled spans and open phrases, by bucket of documents."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(p.as_py(), *PHRASES) for p in table["payload"]]
        shift = np.cumsum([0, *(len(p[0]) for p in parts)]).tolist()
        glue = lambda i: np.concatenate([p[i] for p in parts])
        moved = lambda i: np.concatenate([p[i].astype(np.int64) + s for p, s in zip(parts, shift, strict=False)])
        ids, keys, trigger, phrase, text, low, count = glue(0), glue(1), glue(2), glue(3), moved(4), glue(5).astype(np.int64), glue(6).astype(np.int64)
        ride = moved(7), glue(8).astype(np.int64), glue(9).astype(np.int64)
        if len(text):
            order, new, _, smallest = _settle(ids[text], phrase, trigger)
            t = trigger[order]
            group = np.cumsum(np.r_[True, t[1:] != t[:-1]]) - 1
            starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            settled = ids[text][order] > smallest
            mixed = np.minimum.reduceat(smallest, starts) < np.maximum.reduceat(smallest, starts)
            done, open_ = order[settled], order[~settled & mixed[group]]
        else:
            done = open_ = np.zeros(0, np.int64)
        spans = [np.concatenate(x) for x in zip(ride, (text[done], low[done], count[done] + match - 1), strict=True)]
        bucket = bucket_of(ids, buckets)
        every = np.r_[spans[0], text[open_]]
        out = []
        for b, at in _by(bucket[every]):
            s, o = at[at < len(spans[0])], open_[at[at >= len(spans[0])] - len(spans[0])]
            i, k, new = _used(np.r_[spans[0][s], text[o]], ids, keys)
            out.append((b, pack(i, k, new[: len(s)].astype("u4"), spans[1][s].astype("u4"), spans[2][s].astype("u4"), new[len(s) :].astype("u4"), low[o].astype("u4"), count[o].astype("u1"), trigger[o])))
        return pa.Table.from_batches([_batch(out)])

    return run


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (phrases.mixed(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _texts(table: pa.Table) -> dict[tuple[int, int], tuple[int, bytes]]:
    """By (id, key of the text): the row and its bytes."""
    out: dict[tuple[int, int], bytes] = {}
    for doc_id, text in zip(table["doc_id"].to_pylist(), table["text"], strict=True):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        out[doc_id, text_key(raw)] = raw
    return out


def _fetch(buckets: int, match: int):
    """Bytes of the open phrases of a bucket's documents, by bucket of triggers."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        ids, keys, _, _, _, text, low, count, trigger = _spans(marks)
        if not len(text):
            return _ROW.empty_table()
        texts = _texts(docs)
        raws = [texts[x] for x in zip(ids.tolist(), keys.tolist(), strict=True)]
        out = []
        for b, at in _by(trigger.astype(np.int64) % buckets):
            i, k, new = _used(text[at], ids, keys)
            raw = b"".join(raws[t][a : a + c + match - 1] for t, a, c in zip(text[at].tolist(), low[at].tolist(), count[at].tolist(), strict=True))
            out.append((b, pack(i, k, new.astype("u4"), trigger[at].astype("u4"), low[at].astype("u4"), count[at].astype("u1"), np.frombuffer(raw, np.uint8))))
        return pa.Table.from_batches([_batch(out)])

    return run


def _spans(marks: pa.Table) -> list[np.ndarray]:
    parts = [unpack(p.as_py(), *SPANS) for p in marks["payload"]]
    if not parts:
        return [np.zeros(0, k) for k in SPANS]
    shift = np.cumsum([0, *(len(p[0]) for p in parts)]).tolist()
    return [np.concatenate([p[i].astype(np.int64) + s * (i in (2, 5)) if i > 1 else p[i] for p, s in zip(parts, shift, strict=False)]) for i in range(len(SPANS))]


def suffix_heads(data: np.ndarray, places: np.ndarray, depth: int) -> list[np.ndarray]:
    """The first ``depth`` bytes from each place on, as numbers that sort as the bytes do (most significant first)."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    heads = [np.ascontiguousarray(eight[places + at]).view(">u8").ravel().astype(np.uint64) for at in range(0, depth, 8)]
    if depth % 8:
        heads[-1] = heads[-1] >> np.uint64(64 - 8 * (depth % 8))
    return heads


def _sort_suffixes(buckets: int, match: int):
    """Windows of open phrases that start in a smaller document too, as spans by bucket of documents."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(p.as_py(), *OPEN) for p in table["payload"]]
        shift = np.cumsum([0, *(len(p[0]) for p in parts)]).tolist()
        glue = lambda i: np.concatenate([p[i] for p in parts])
        ids, keys, trigger, low, count, data = glue(0), glue(1), glue(3), glue(4).astype(np.int64), glue(5).astype(np.int64), glue(6)
        text = np.concatenate([p[2].astype(np.int64) + s for p, s in zip(parts, shift, strict=False)])
        place = np.cumsum(np.r_[0, count[:-1] + match - 1])
        order = np.argsort(trigger, kind="stable")
        t = trigger[order]
        breaks = np.r_[np.flatnonzero(np.r_[True, t[1:] != t[:-1]]), len(t)]
        windows = np.r_[0, np.cumsum(count[order])]
        found, a = [], 0
        while a < len(breaks) - 1:
            b = max(a + 1, np.searchsorted(windows[breaks], windows[breaks[a]] + SORTED_AT_ONCE, "right") - 1)
            some = order[breaks[a] : breaks[b]]
            n = count[some]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(some, n)
            heads = suffix_heads(data, place[owner] + inside, match)
            doc = ids[text[owner]]
            by = np.lexsort((doc, *heads[::-1]))
            new = np.r_[True, np.zeros(len(by) - 1, bool)]
            for h in heads:
                new[1:] |= h[by][1:] != h[by][:-1]
            smallest = doc[by][new][np.cumsum(new) - 1]
            hit = by[doc[by] > smallest]
            found.append((text[owner[hit]], low[owner[hit]] + inside[hit]))
            a = b
        hit, start = [np.concatenate(x) for x in zip(*found, strict=True)]
        hit, start, length = _merged(hit, start, np.full(len(hit), match, np.int64))
        out, none = [], np.zeros(0, np.int64)
        for b, at in _by(bucket_of(ids, buckets)[hit]):
            i, k, new = _used(hit[at], ids, keys)
            out.append((b, pack(i, k, new.astype("u4"), start[at].astype("u4"), length[at].astype("u4"), none, none, none, none)))
        return pa.Table.from_batches([_batch(out)])

    return run


def kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, length in spans:
        parts.append(raw[at:start])
        at = start + length
    return b"".join([*parts, raw[at:]])


def _spans_by_text(marks: pa.Table) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Spans in order, apart from each other, by (id, key of the text)."""
    ids, keys, text, start, length = _spans(marks)[:5]
    # one number for each document, however many payloads name it
    names = list(zip(ids.tolist(), keys.tolist(), strict=True))
    number = {name: i for i, name in enumerate(dict.fromkeys(names))}
    text = np.array([number[x] for x in names], np.int64)[text] if len(text) else text
    by_number = list(number)
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for t, a, n in zip(*(x.tolist() for x in _merged(text, start, length)), strict=True):
        out.setdefault(by_number[t], []).append((a, n))
    return out


def _cut_out(schema: pa.Schema, make):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        of = _spans_by_text(marks)
        rows = []
        for row, (doc_id, value) in enumerate(zip(docs["doc_id"].to_pylist(), docs["text"], strict=True)):
            raw = value.as_buffer().to_pybytes() if value.is_valid else b""
            rows.append(make(docs, row, raw, of.get((doc_id, text_key(raw)), []), value.is_valid))
        return pa.Table.from_pylist(rows, schema)

    return run


def spans_of(rows: DataFrame, match: int = MATCH) -> tuple[DataFrame, DataFrame, int]:
    """Documents with the bucket they are in, the marks (packed spans) by that bucket, and the number of buckets."""
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, ceil(size / BUCKET_BYTES))
    parsed = rows.select("doc_id", "text").mapInArrow(_parse_blocks(buckets, match), _ROW_SQL)
    met = cut(parsed.groupBy("bucket").applyInArrow(_meet(buckets, match), _ROW_SQL))
    fetched = _docs(rows, buckets).groupBy("bucket").cogroup(met.groupBy("bucket")).applyInArrow(_fetch(buckets, match), _ROW_SQL)
    more = fetched.groupBy("bucket").applyInArrow(_sort_suffixes(buckets, match), _ROW_SQL)
    return _docs(rows, buckets), met.unionByName(more), buckets


def _docs(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt to buckets by the hash that ``bucket_of`` works out in arrays."""

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).fill_null(-1).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket_of(ids, buckets), pa.int32())], [*batch.schema.names, "bucket"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, fields + ", bucket int")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _digest(docs, row, raw, spans, valid):
    return {"doc_id": docs["doc_id"][row].as_py(), "n_bytes": len(raw), "n_removed": sum(n for _, n in spans), "n_spans": len(spans), "kept_sha256": sha256(kept(raw, spans)).hexdigest()}


def _apply(rows: DataFrame, schema: pa.Schema, fields: str, make, match: int) -> DataFrame:
    docs, marks, _ = spans_of(rows, match)
    return docs.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(_cut_out(schema, make), fields)


def _input(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", match: int = MATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; see ``remove`` for what is removed."""
    fields = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return _apply(_input(df, doc_id, text), _DIGEST, fields, _digest, match)


def _clean(raw: bytes) -> str:
    """Text of what is left: bytes of a character that was cut in two go."""
    return raw.decode("utf-8", "ignore")


def shorten(df: DataFrame, doc_id: str = "doc_id", text: str = "text", match: int = MATCH) -> DataFrame:
    """All columns of ``df``, with texts shortened as ``remove`` does; rows whose text is thereby emptied go.

    Bytes of a character that a cut went through go with it.  n_chars, if there is such a column, follows the text.
    """
    keys = {"doc_id": doc_id, "text": text}
    named = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys.values()]).alias("rest")) if len(df.columns) > 2 else df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    shorter = _apply_rows(named, match)
    rest = [c for c in df.columns if c not in keys.values()]
    values = {doc_id: F.col("doc_id").cast(df.schema[doc_id].dataType), text: F.col("text")} | {c: F.col(f"rest.`{c}`") for c in rest}
    if "n_chars" in rest:
        values["n_chars"] = F.length("text").cast(df.schema["n_chars"].dataType)
    return shorter.select(*[values[c].alias(c) for c in df.columns])


def _apply_rows(rows: DataFrame, match: int) -> DataFrame:
    """The rows with shortened texts, without those that are emptied."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        docs = docs.drop_columns(["bucket"])
        of = _spans_by_text(marks)
        texts, stay = [], []
        for doc_id, value in zip(docs["doc_id"].to_pylist(), docs["text"], strict=True):
            raw = value.as_buffer().to_pybytes() if value.is_valid else b""
            spans = of.get((doc_id, text_key(raw)))
            texts.append(_clean(kept(raw, spans)) if spans else value.as_py())
            stay.append(not spans or bool(texts[-1]))
        at = docs.schema.get_field_index("text")
        return docs.set_column(at, "text", pa.array(texts, pa.string())).filter(pa.array(stay, pa.bool_()))

    docs, marks, _ = spans_of(rows, match)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return docs.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(run, fields)


_KEPT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary())])


def remove(df: DataFrame, doc_id: str = "doc_id", text: str = "text", match: int = MATCH) -> DataFrame:
    """doc_id and kept (bytes) of every row, without the bytes that a smaller document holds in a run of ``match`` or more.

    A null text is an empty one.  Rows that share an id do not take from each other, each is a row of its own.  A row with a
    null id neither takes nor loses.  Other columns are not looked at.  An empty table gives an empty table.
    """
    make = lambda docs, row, raw, spans, valid: {"doc_id": docs["doc_id"][row].as_py(), "kept": kept(raw, spans) if valid else None}
    return _apply(_input(df, doc_id, text), _KEPT, "doc_id bigint, kept binary", make, match)
