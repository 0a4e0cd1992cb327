"""Byte-level BPE encoding and decoding.

A piece of text is merged with a segment tree over its byte positions: leaf ``i`` holds the rank of the pair made of the
live token that starts at ``i`` and its right neighbour, every inner node the least (rank, position) below it, so the root
names the leftmost pair of least rank.  A merge changes three leaves, each in logarithmic time.

Texts are cut at spaces that stand alone between two characters that are not white space.  No match of the pre-tokenizer
pattern crosses such a cut, so the ids of a cut are the same wherever it occurs and are kept in a bounded table per worker.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import claim

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Entries of each of a worker's two tables of encoded cuts, and the longest cut that is kept.
TABLE_ENTRIES, TABLE_CHARS = 250_000, 40
#: Rows and bytes of text that a worker encodes at a time, unless one text alone is longer.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20
#: Bytes of the longest piece that is merged side by side with others.
SIDE_BY_SIDE = 64
_NONE = 1 << 62
_LOW = (1 << 32) - 1
_MIXED_SPACE = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    leaves = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * leaves)
    rank_of = ranks.get
    for i in range(n - 1):
        rank = rank_of(piece[i : i + 2])
        if rank is not None:
            tree[leaves + i] = rank << 32 | i
    for v in range(leaves - 1, 0, -1):
        a, b = tree[2 * v], tree[2 * v + 1]
        tree[v] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree[1]) != _NONE:
        i = least & _LOW
        j = after[i]
        k = after[i] = after[j]
        rank = None
        if k < n:
            before[k] = i
            rank = rank_of(piece[i : after[k]])
        changes = [(j, _NONE), (i, _NONE if rank is None else rank << 32 | i)]
        if (h := before[i]) >= 0:
            rank = rank_of(piece[h:k])
            changes.append((h, _NONE if rank is None else rank << 32 | h))
        for leaf, value in changes:
            v = leaves + leaf
            tree[v] = value
            while v > 1:
                other = tree[v ^ 1]
                if other < value:
                    value = other
                v >>= 1
                if tree[v] == value:
                    break
                tree[v] = value
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class _Pairs:
    """The rank that two neighbouring ids merge to, for arrays of pairs: a hash table with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [
            (ranks[token[:at]] << 32 | ranks[token[at:]], rank)
            for token, rank in ranks.items()
            for at in range(1, len(token))
            if token[:at] in ranks and token[at:] in ranks
        ]
        keys = np.array([key for key, _ in pairs], np.int64)
        values = np.array([value for _, value in pairs], np.int64)
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int64)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
        at = self.slot(keys)
        while len(wrong := np.flatnonzero(self.keys[at] != keys)):
            at[wrong] = at[wrong] + 1 & (1 << self.bits) - 1
        self.values[at] = values

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slot = self.slot(keys)
        out = self.values[slot]
        at = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        out[(self.keys[slot] == -1)] = _NONE
        while len(at):
            slot[at] = slot[at] + 1 & (1 << self.bits) - 1
            out[at] = self.values[slot[at]]
            at = at[(self.keys[slot[at]] != keys[at]) & (self.keys[slot[at]] != -1)]
        return out


def merge_many(pieces: list[bytes], ranks: dict[bytes, int], pairs: _Pairs, leaves: int) -> list[bytes]:
    """Packed ids of many pieces of at most ``leaves`` bytes: one segment tree a row, a merge in every row at a time."""
    d, depth = len(pieces), leaves.bit_length() - 1
    letters = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(d, leaves)
    size = np.fromiter(map(len, pieces), np.int64, d)
    ids = np.array([ranks[bytes([x])] for x in range(256)], np.int64)[letters]
    place = np.arange(leaves)
    live = place < size[:, None]
    tree = np.full((d, 2 * leaves), _NONE, np.int64)
    rank = pairs.merged(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(d, leaves - 1)
    found = (rank != _NONE) & live[:, 1:]
    tree[:, leaves:-1] = np.where(found, rank << 32 | place[:-1], _NONE)
    for level in range(depth - 1, -1, -1):
        below = tree[:, 2 << level : 4 << level]
        tree[:, 1 << level : 2 << level] = np.minimum(below[:, ::2], below[:, 1::2])
    # one spare column: the place after the last byte, and (as -1) the one before the first
    after = np.minimum(np.tile(place + 1, (d, 1)), size[:, None])
    before = np.tile(place - 1, (d, 1))
    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        least = tree[rows, 1]
        i = least & _LOW
        j = after[rows, i]
        k = after[rows, j]
        ids[rows, i] = least >> 32
        live[rows, j] = False
        after[rows, i] = k
        leaf_i = np.full(len(rows), _NONE)
        inner = np.flatnonzero(k < size[rows])
        r, x, y = rows[inner], i[inner], k[inner]
        before[r, y] = x
        rank = pairs.merged(ids[r, x], ids[r, y])
        leaf_i[inner] = np.where(rank == _NONE, _NONE, rank << 32 | x)
        tree[rows, leaves + j] = _NONE
        tree[rows, leaves + i] = leaf_i
        h = before[rows, i]
        inner = np.flatnonzero(h >= 0)
        r, x, y = rows[inner], h[inner], i[inner]
        rank = pairs.merged(ids[r, x], ids[r, y])
        tree[r, leaves + x] = np.where(rank == _NONE, _NONE, rank << 32 | x)
        for row, leaf in ((rows, j), (rows, i), (r, x)):
            v = leaves + leaf
            for _ in range(depth):
                v = v >> 1
                tree[row, v] = np.minimum(tree[row, 2 * v], tree[row, 2 * v + 1])
        rows = rows[tree[rows, 1] != _NONE]
    ends = np.cumsum(live.sum(1)) * 4
    packed = ids[live].astype("<u4").tobytes()
    return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class _Table(dict):
    """Packed ids by cut.  A cut that is not there is noted, and learnt later together with others."""

    def __init__(self):
        self.missed: list[str] = []
        self.long: list[str] = []

    def __missing__(self, cut: str) -> bytes:
        self.missed.append(cut)
        return b""

    def learn(self, codec: Codec, lead: str) -> None:
        cuts = list(dict.fromkeys(self.missed))
        self.missed.clear()
        for at in range(0, len(cuts), 50_000):
            some = cuts[at : at + 50_000]
            self.update(zip(some, codec.pack_many([lead + cut for cut in some]), strict=True))
        self.long += [cut for cut in cuts if len(cut) > TABLE_CHARS]

    def trim(self) -> None:
        if len(self) > TABLE_ENTRIES:
            self.clear()
        for cut in self.long:
            self.pop(cut, None)
        self.long.clear()


class Codec:
    """Encoder and decoder for one rank file and pattern; keeps two bounded tables of cuts and their packed ids."""

    _made: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str = RANKS, pattern: str = PATTERN):
        self.ranks = load_ranks(path)
        self.pairs = _Pairs(self.ranks)
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.first, self.spaced = _Table(), _Table()
        self.cuts_hold = pattern == PATTERN

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        claim("bpe", cls._made.clear)
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def pack_many(self, cuts: list[str]) -> list[bytes]:
        """Packed ids of each cut."""
        found = [self.find(cut) for cut in cuts]
        known: dict[str, bytes] = {}
        by_size: dict[int, list[str]] = {}
        for piece in set().union(*found):
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                known[piece] = rank.to_bytes(4, "little")
            elif len(raw) > SIDE_BY_SIDE:
                known[piece] = array("I", merge(raw, self.ranks)).tobytes()
            else:
                by_size.setdefault(1 << (len(raw) - 1).bit_length(), []).append(piece)
        for leaves, pieces in by_size.items():
            known.update(zip(pieces, merge_many([p.encode() for p in pieces], self.ranks, self.pairs, leaves), strict=True))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in found]

    def cut(self, text: str) -> tuple[str, list[str]]:
        """The first cut, and the later ones without the space that each starts with."""
        if not self.cuts_hold:
            return text, []
        if _MIXED_SPACE.search(text) is None:
            head, *rest = text.split(" ")
            return head, rest
        starts = [m.start() for m in _CUT.finditer(text)]
        head, *rest = (text[a:b] for a, b in zip([0, *starts], [*starts, len(text)], strict=True))
        return head, [cut[1:] for cut in rest]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.cut(text or "") for text in texts]
        first, spaced = self.first, self.spaced
        out: list[bytes] = [b""] * len(texts)
        todo = range(len(texts))
        while todo:
            again = []
            for i in todo:
                misses = len(first.missed) + len(spaced.missed)
                head, rest = parts[i]
                out[i] = first[head] + b"".join(map(spaced.__getitem__, rest))
                if len(first.missed) + len(spaced.missed) > misses:
                    again.append(i)
            todo = again
            for table, lead in ((first, ""), (spaced, " ")):
                table.learn(self, lead)
        for table in (first, spaced):
            table.trim()
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, packed: bytes | None) -> bytes:
        ids = array("I")
        ids.frombytes(packed or b"")
        return b"".join(map(self.tokens.__getitem__, ids))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices that keep a worker's memory small."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > start and (i - start >= SLICE_ROWS or size + (n or 0) > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def _run(batches: Iterator[pa.RecordBatch], column: str, made: list[tuple[str, pa.DataType]], apply) -> Iterator[pa.RecordBatch]:
    """Appends made columns to each batch."""
    for batch in batches:
        for part in slices(batch, column):
            values = apply(part.column(column).to_pylist())
            arrays = [pa.array(v, kind) for v, (_, kind) in zip(values, made, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *(name for name, _ in made)])


def _with(df: DataFrame, column: str, fields: str, made, apply) -> DataFrame:
    taken = {name.lower() for name, _ in made}
    kept = df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [fields])
    return kept.mapInArrow(lambda batches: _run(batches, column, made, apply), schema)


def encode(df: DataFrame, text: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Adds ``token_bytes`` (ids as little-endian unsigned 32-bit integers) and ``n_tokens``.

    One pass without a shuffle.  A null or empty text has no tokens.  Other columns stay as they are; columns that already
    bear the new names are replaced.  Repeated rows are encoded each for itself.  An empty table gives an empty table.
    """

    def apply(texts):
        packed = Codec.of(ranks, pattern).encode_many(texts)
        return packed, [len(p) // 4 for p in packed]

    return _with(df, text, "token_bytes binary, n_tokens bigint", [("token_bytes", pa.binary()), ("n_tokens", pa.int64())], apply)


def decode(df: DataFrame, tokens: str = "token_bytes", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Adds ``decoded``, the bytes that the ids of ``tokens`` stand for; null ids decode to no bytes."""
    return _with(df, tokens, "decoded binary", [("decoded", pa.binary())], lambda packed: [list(map(Codec.of(ranks, pattern).decode, packed))])


def digests(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every text encoded, the ids decoded again, and digests of both.

    One pass in one worker a task, so that only digests leave it.  A null text is an empty one; rows that repeat are rows of
    their own; other columns are not looked at; an empty table gives an empty table.
    """

    def apply(texts):
        codec = Codec.of(ranks, pattern)
        packed = codec.encode_many(texts)
        return [len(p) // 4 for p in packed], [sha256(p).hexdigest() for p in packed], [sha256(codec.decode(p)).hexdigest() for p in packed]

    def run(batches):
        for batch in _run(batches, "text", made, apply):
            yield batch.select(names)

    made = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
