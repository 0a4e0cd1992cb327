"""Training-order materialisation of token ids in fixed-stride shards.

Each task packs its documents end to end, each followed by an end mark, and cuts them into sequences of LENGTH ids.  A sequence is
numbered by where it begins: the document and the offset in it.  A keyed Feistel permutation of these numbers, with cycle-walking
back into their range, gives each sequence its place; places are spread evenly, so ranges of them are alike in size.  Partitions are ranges
of places; each writes its sequences in order, one file a shard, LENGTH ids a record and nothing else.  A sequence's global slot is its rank.

So record r of a shard starts at byte r * stride, and reading may start at any slot without anything else being read.  What lies
where in a record (documents, their offsets, and how much of the last record is filling) is a small table beside the shards.

Token ids are shuffled once.  A file gets a name of its own, and is valid by the row that names it: what a lost or repeated task left behind is
named by none, and nothing is moved onto a name.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder
from . import bpe
from .common import claim, cut, partitions

#: Ids of a sequence, bytes of text behind a shard, and rounds of the permutation.
LENGTH, SHARD_BYTES, ROUNDS = 1024, 64 << 20, 6
KEY = 20_261
#: The id that ends a document; it is free in the vocabulary, and ids need two bytes with it.
END, WIDTH = 50_256, 2
#: Records that are read at once.
READ = 256


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def permute(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Places of numbers in [0, n): a permutation of [0, n)."""
    half = max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = numbers.astype(np.uint64)
    walking = np.arange(len(x))
    while len(walking):
        left, right = x[walking] >> np.uint64(half), x[walking] & mask
        for i in range(ROUNDS):
            left, right = right, left ^ _round(right, key * 0x1F123BB5 + i) & mask
        x[walking] = left << np.uint64(half) | right
        walking = walking[x[walking] >= n]
    return x.astype(np.int64)


_encoders: dict[tuple[str, str], tiktoken.Encoding] = {}
#: A piece of so many characters is one that the library would take long for; its text is encoded by the segment tree.
_LONG = 4000


def _encoder(ranks: str, pattern: str) -> tiktoken.Encoding:
    claim("training_order", _encoders.clear)
    if (ranks, pattern) not in _encoders:
        _encoders.clear()
        _encoders[ranks, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=bpe.load_ranks(ranks), special_tokens={})
    return _encoders[ranks, pattern]


def _long(text: str) -> bool:
    """Whether a piece may be that long: it would fill a stretch of half its length, with no space in it or nothing else."""
    half = _LONG // 2
    stretches = (text[i : i + half] for i in range(0, len(text) - half + 1, half))
    return any(s.isspace() if s[0].isspace() else " " not in s for s in stretches)


def _packed(text: str, ranks: str, pattern: str) -> bytes:
    if not _long(text):
        return _encoder(ranks, pattern).encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()
    return np.frombuffer(bpe.Codec.of(ranks, pattern).encode(text), "<u4").astype("<u2").tobytes()


def encode(df: DataFrame, text: str = "text", ranks: str = bpe.RANKS, pattern: str = bpe.PATTERN) -> DataFrame:
    """Adds ``tokens``, the ids of ``bpe.encode`` in two bytes each; a null text has none."""

    def apply(texts):
        return [[_packed(t or "", ranks, pattern) for t in texts]]

    return bpe._with(df, text, "tokens binary", [("tokens", pa.binary())], apply)


_DOC = pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("at", pa.int32())]))
_DOCS = "array<struct<doc_id: bigint, offset: bigint, at: int>>"
_SEQUENCE = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("place", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int32()), ("docs", _DOC), ("ids", pa.binary())])
_SEQUENCE_SQL = f"part int, shard int, place bigint, tie bigint, n_tokens int, docs {_DOCS}, ids binary"


def _pack(low: int, span: int, most: int, shards: int, parts: int, length: int, width: int, end: int, key: int):
    """Sequences of a task's documents.  ``span`` documents' ids from ``low`` on (the last of them for null), each with ``most`` offsets."""
    domain = span * most

    def batch(held: list[tuple]) -> pa.RecordBatch:
        numbers = [((span - 1 if docs[0]["doc_id"] is None else docs[0]["doc_id"] - low) * most + docs[0]["offset"]) for docs, _, _ in held]
        place = permute(np.array(numbers, np.int64), domain, key)
        shard = [int(p) * shards // domain for p in place.tolist()]
        columns = [[s * parts // shards for s in shard], shard, place.tolist(), [zlib.crc32(ids) for _, _, ids in held], [n for _, n, _ in held], [docs for docs, _, _ in held], [ids for _, _, ids in held]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEQUENCE, strict=True)], schema=_SEQUENCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, mark = length * width, end.to_bytes(width, "little")
        docs, buffer, held = [], bytearray(), []
        for rows in batches:
            for doc_id, tokens in zip(rows.column(0), rows.column(1), strict=True):
                doc_id, ids, at = doc_id.as_py(), (tokens.as_py() or b"") + mark, 0
                while at < len(ids):
                    docs.append({"doc_id": doc_id, "offset": at // width, "at": len(buffer) // width})
                    taken = ids[at : at + step - len(buffer)]
                    buffer += taken
                    at += len(taken)
                    if len(buffer) == step:
                        held.append((docs, length, bytes(buffer)))
                        docs, buffer = [], bytearray()
                        if len(held) >= 1000:
                            yield batch(held)
                            held = []
        if buffer:
            held.append((docs, len(buffer) // width, bytes(buffer) + mark * (length - len(buffer) // width)))
        if held:
            yield batch(held)

    return run


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


_RECORDS = pa.schema([("shard", pa.int32()), ("record", pa.int32()), ("path", pa.string()), ("n_tokens", pa.int32()), ("docs", _DOC)])
_RECORDS_SQL = f"shard int, record int, path string, n_tokens int, docs {_DOCS}"


def _write(folder: str):
    """Shards of sequences in order, a file each; a row for each record, given once its file is whole."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        now, out, path, rows = None, None, "", []

        def done() -> Iterator[pa.RecordBatch]:
            out.close()
            for at in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_pylist(rows[at : at + 5000], _RECORDS)

        for batch in batches:
            for shard, n, docs, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "n_tokens", "docs", "ids")), strict=True):
                if shard != now:
                    if out is not None:
                        yield from done()
                    now, rows, name = shard, [], f"shard-{shard:08d}-{uuid.uuid4().hex}"
                    system.create_dir(root)
                    out, path = system.open_output_stream(f"{root}/{name}"), f"{folder}/{name}"
                out.write(ids)
                rows.append({"shard": shard, "record": len(rows), "path": path, "n_tokens": n, "docs": docs})
        if out is not None:
            yield from done()

    return run


def materialise(df: DataFrame, tokens: Column, width: int = WIDTH, end: int = END, doc_id: str = "doc_id", sizes: DataFrame | None = None, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """Writes the shards; a row for each record: slot, shard, record, path, n_tokens (without filling) and docs.

    ``tokens`` is a binary column of ids of ``width`` bytes each; ``end`` follows every document and fills the last record of a task.  ``sizes``
    (doc_id, size) has a bound of each document's number of ids, from a table that is cheap to read (else ids are worked out twice).  ``docs`` tells the documents
    of a record, from which of its ids on (offset) and where in the record (at).  A null or empty one is its end mark alone.  A null id is null in ``docs``.
    Rows that share an id are documents of their own; sequences that begin alike go by their ids' checksum, and equal ones in any order.  Other
    columns are not looked at.  An empty table gives no record.  The files lie in a folder of their own below ``spark.checkpoint.dir``, for whoever
    asked for them; ``discard`` removes them.
    """
    spark = df.sparkSession
    known = df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(tokens) / width).alias("size")) if sizes is None else sizes
    bound = F.coalesce("size", F.lit(0)) + 1
    low, high, most, total = known.agg(F.min("doc_id"), F.max("doc_id"), F.max(bound).cast("bigint"), F.sum(bound).cast("bigint")).first()
    low, span, most = low or 0, (high or 0) - (low or 0) + 2, most or 1
    if span * most >= 1 << 62:
        raise ValueError("ids and lengths are too far apart to be numbered in 62 bits")
    p = partitions(spark)
    shards = max(p, ceil((total or 0) / SHARD_BYTES))
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), tokens.alias("tokens"))
    sequences = rows.mapInArrow(_pack(low, span, most, shards, p, length, width, end, key), _SEQUENCE_SQL)
    dealt = sequences.repartitionById(p, "part").sortWithinPartitions("shard", "place", "tie")
    records = cut(dealt.select("shard", "n_tokens", "docs", "ids").mapInArrow(_write(f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"), _RECORDS_SQL))
    counts = records.groupBy("shard").agg(F.count("*").alias("n"))  # a row a shard
    first = counts.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return records.join(F.broadcast(first), "shard").select((F.col("first") + F.col("record")).alias("slot"), "shard", "record", "path", "n_tokens", "docs")


def _read(width: int, stride: int):
    """Adds ``ids`` to rows of records; records that follow each other in a file are read together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = file = None
        for batch in batches:
            for at in range(0, batch.num_rows, READ):
                part = batch.slice(at, READ)
                paths, numbers, counts = (part.column(c).to_pylist() for c in ("path", "record", "n_tokens"))
                ids, i = [], 0
                while i < len(paths):
                    j = i + 1
                    while j < len(paths) and paths[j] == paths[i] and numbers[j] == numbers[j - 1] + 1:
                        j += 1
                    if paths[i] != path:
                        if file is not None:
                            file.close()
                        system, place = _filesystem(path := paths[i])
                        file = system.open_input_file(place)
                    data = file.read_at((j - i) * stride, numbers[i] * stride)
                    ids += [data[k * stride : k * stride + counts[i + k] * width] for k in range(j - i)]
                    i = j
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], [*part.schema.names, "ids"])
        if file is not None:
            file.close()

    return run


def read(records: DataFrame, width: int = WIDTH, length: int = LENGTH, from_slot: int = 0) -> DataFrame:
    """slot, shard, byte_offset, n_tokens, docs and ids (filling left out) from a slot on; what lies before it is not read, nothing is shuffled."""
    stride = width * length
    wanted = records.filter(F.col("slot") >= from_slot).select("slot", "shard", "record", "path", "n_tokens", "docs")
    rows = wanted.mapInArrow(_read(width, stride), f"slot bigint, shard int, record int, path string, n_tokens int, docs {_DOCS}, ids binary")
    return rows.select("slot", "shard", (F.col("record").cast("bigint") * stride).alias("byte_offset"), "n_tokens", "docs", "ids")


def discard(records: DataFrame) -> None:
    """Removes the files of shards, and what repeated tasks left beside them."""
    path = records.select("path").first()  # all lie in one folder
    if path is not None:
        system, folder = _filesystem(path[0].rpartition("/")[0])
        system.delete_dir(folder)
