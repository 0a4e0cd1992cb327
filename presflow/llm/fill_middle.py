"""Fill-in-the-middle texts, cut at seeded token boundaries that are found once for each distinct text.

A token is white space followed by other characters, or white space at a text's end.  Identical texts are grouped, and a
group's boundaries (where its tokens end, in code points) make one Elias-Fano list: the low bits of each boundary as they are, the high
bits in unary.  Every document of the group then selects its two seeded cuts from that list; nothing is searched again.

Texts are shuffled once.  A task first groups what it holds by the texts themselves and sends each text once, with the ids
that bear it, by a digest.  Where groups meet, equal digests are confirmed on the texts.  A group that has more than CROWD
documents in one task is large enough to be indexed where it is: it goes under its own smallest id, so that the copies of a
very frequent text are spread over as many tasks as hold many of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: The control strings, and the shares (of a hundred) of texts that are cut, and of those in suffix-first order.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT, SUFFIX_FIRST = 50, 80
SEED = 42
#: Documents of one text in one task from which the group goes under a key of its own, and ids of a group that travel in one row.
CROWD = 256
#: Characters of distinct texts that a task gathers before it sends them on.
GATHERED = 16 << 20
#: Rows and characters of an output batch.
ROWS, CHARS = 1000, 4 << 20


class Boundaries:
    """An ascending list of numbers below ``limit``, in Elias-Fano form."""

    def __init__(self, ascending: np.ndarray, limit: int):
        self.n = len(ascending)
        self.low_bits = max(0, (limit // max(1, self.n)).bit_length() - 1)
        values = ascending.astype(np.int64)
        high = (values >> self.low_bits) + np.arange(self.n)  # the i-th one of the unary bits stands here
        unary = np.zeros(int(high[-1]) + 1 if self.n else 0, np.uint8)
        unary[high] = 1
        self.high = np.packbits(unary)
        low = (values[:, None] >> np.arange(self.low_bits) & 1).astype(np.uint8)
        self.low = np.packbits(low.ravel())
        #: ones before each byte of the unary bits
        self.ones = np.r_[0, np.cumsum(np.bitwise_count(self.high), dtype=np.int64)]

    def select(self, i: int) -> int:
        byte = int(np.searchsorted(self.ones, i, "right")) - 1
        bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1]))
        high = 8 * byte + int(bits[i - int(self.ones[byte])]) - i
        at = i * self.low_bits
        low = np.unpackbits(self.low[at // 8 : (at + self.low_bits + 7) // 8])[at % 8 : at % 8 + self.low_bits]
        return high << self.low_bits | int((low.astype(np.int64) << np.arange(self.low_bits)).sum())

    @property
    def size(self) -> int:
        """Bytes of the list, without the count of ones that helps to select."""
        return len(self.high) + len(self.low)


def token_ends(text: str) -> np.ndarray:
    """Where the tokens of a text end, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64)
    space = (points == 0x20) | (points - np.uint32(9) < 5)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.r_[ends, len(points)]  # the last token ends with the text, in white space or not


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits, from the hex digest of seed:id."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


class Distinct:
    """A text with its boundaries, to be cut again and again."""

    def __init__(self, text: str):
        self.text, ends = text, token_ends(text)
        self.ends = Boundaries(ends, len(text) + 1)
        self.marked = not text or PREFIX in text or SUFFIX in text or MIDDLE in text

    def end(self, tokens: int) -> int:
        return self.ends.select(tokens - 1) if tokens else 0

    def made(self, doc_id: int | None, seed: int, cut: int, suffix_first: int) -> tuple:
        """n, form, prefix_chars, middle_chars and output for one document that has this text."""
        n, text = self.ends.n, self.text
        h1, h2, h3, h4 = draws(doc_id, seed)
        if self.marked or h3 % 100 >= cut:
            return n, "plain", None, None, text
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = self.end(a), self.end(b)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < suffix_first:
            return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of."""
    at = lambda mark: F.instr(output, mark)
    between = lambda a, b: output.substr(at(a) + 3, at(b) - at(a) - 3)
    rest = output.substr(at(MIDDLE) + 3, F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), rest, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), rest, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


_GROUP = pa.schema([("key", pa.binary()), ("part", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int64()))])
_GROUP_SQL = "key binary, part bigint, text string, ids array<bigint>"


def _least(ids: list[int | None]) -> int:
    return min((i for i in ids if i is not None), default=-1)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text of the task: digest, part (0, or for a crowd its smallest id and more), text and ids."""
    held: dict[str, list[int | None]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        texts, step = list(held), max(1, len(held) * CHARS // (size + 1))
        for at in range(0, len(texts), step):
            some = texts[at : at + step]
            keys = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in some]
            parts = [0 if len(held[t]) <= CROWD else 1 + (_least(held[t]) & 0x7FFFFFFF) for t in some]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(parts, pa.int64()), pa.array(some, pa.string()), pa.array([held[t] for t in some], _GROUP.field("ids").type)], schema=_GROUP)
        held.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = held.get(text)
                if ids is None:
                    ids = held[text] = []
                    size += len(text)
                ids.append(doc_id)
            if size >= GATHERED:
                yield from sent()
                size = 0
    if held:
        yield from sent()


_MADE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
_MADE_SQL = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def _cut(seed: int, cut: int, suffix_first: int):
    def rows(batches) -> Iterator[tuple]:
        key, met = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if (row["key"], row["part"]) != key:
                        key, met = (row["key"], row["part"]), []
                    known = next((d for d in met if d.text == row["text"]), None)  # equal digests are not taken for equal texts
                    if known is None:
                        met.append(known := Distinct(row["text"]))
                    for doc_id in row["ids"]:
                        yield (doc_id, *known.made(doc_id, seed, cut, suffix_first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _MADE, strict=True)], schema=_MADE)
        for row in rows(batches):
            held.append(row)
            size += len(row[-1])
            if len(held) >= ROWS or size >= CHARS:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return run


def fill_in_middle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every row.

    A null text is an empty one, and stays plain, as texts do that hold a control string.  Rows that share an id are cut alike
    if their texts are equal, each for itself; a null id draws from the seed with nothing behind it.  Texts of any length are
    cut whole.  Other columns are not looked at.  An empty table gives an empty table.
    """
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    groups = rows.mapInArrow(_grouped, _GROUP_SQL)
    dealt = groups.repartition(partitions(df.sparkSession), "key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(_cut(seed, cut, suffix_first), _MADE_SQL)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text that is read back from it."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(df).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )
