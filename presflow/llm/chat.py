"""Chat formatting in budgeted windows.

Each conversation becomes windows of whole turns.  Prefix sums of the turns' token counts, as they are formatted, choose how far a window goes: it
opens with the system turn (if the conversation starts with one), repeats as much of the latest history as a share of the
budget allows, and goes on with new turns while they fit.  Each turn is new in exactly one window; there, an assistant's
text is a target.  In repeated history it is masked.

Template, with fixed control strings:  [INST] text [/INST]  for a user,  <a>text</s>  for an assistant,  <<SYS>>text<</SYS>>
for the system, and  [ROLE name]text[/ROLE]  for any other role.  Inside texts and names, a backslash goes before every
backslash and every control string, so no text can close or open a turn and every text can be read back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import partitions

#: Opening and closing control strings by role, and those of any other role.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<a>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE ", "]", "[/ROLE]")
_CONTROL = r"\[/?INST\]|</?a>|</?s>|<</?SYS>>|\[/?ROLE"
_TO_ESCAPE = re.compile(rf"\\|\]|(?={_CONTROL})")
_ESCAPED = re.compile(r"\\(.)", re.S)
_OPENING = re.compile(r"\[INST\] |<a>|<<SYS>>|\[ROLE ((?:\\.|[^\\\]])*)\]", re.S)
_CLOSING = {role: re.compile(r"((?:\\.|[^\\])*?)" + re.escape(close), re.S) for role, (_, close) in MARKS.items()}
_CLOSING[None] = re.compile(r"((?:\\.|[^\\])*?)" + re.escape(OTHER[2]), re.S)
_OPENS = {"[INST] ": "user", "<a>": "assistant", "<<SYS>>": "system"}

BUDGET, HISTORY_SHARE = 1024, 0.25
WINDOW_FIELDS = "conv_id bigint, window int, formatted string, n_repeated int, loss_spans array<struct<start: int, stop: int>>, n_tokens bigint"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_WINDOW = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("formatted", pa.string()), ("n_repeated", pa.int32()), ("loss_spans", _SPANS), ("n_tokens", pa.int64())])


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and where its text starts and stops."""
    start, stop = MARKS.get(role) or (f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2])
    body = escape(text)
    return start + body + stop, len(start), len(start) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, stop) of each turn of a window."""
    at = 0
    while at < len(formatted):
        opening = _OPENING.match(formatted, at)
        role = _OPENS.get(opening[0])
        closing = _CLOSING[role].match(formatted, opening.end())
        yield role if role else unescape(opening[1]), unescape(closing[1]), closing.start(1), closing.end(1)
        at = closing.end()


class _Windows:
    """Windows of the conversation whose turns are given one by one; holds no more than one window and its history."""

    def __init__(self, conv_id: int, budget: int, share: float):
        self.conv_id, self.budget, self.share = conv_id, budget, share
        self.n = self.tokens = 0
        self.system = None  # (role, text, tokens)
        self.turns: list[tuple[str, str, int]] = []  # of the open window, without the system turn
        self.repeated = 0

    def give(self, role: str, text: str, tokens: int) -> list[dict]:
        if self.n == self.tokens == 0 and not self.turns and self.system is None and role == "system":
            self.system, self.tokens = (role, text, tokens), tokens
            return []
        out = []
        if len(self.turns) > self.repeated and self.tokens + tokens > self.budget:
            out.append(self.close())
            self.history(tokens)
        self.turns.append((role, text, tokens))
        self.tokens += tokens
        return out

    def history(self, coming: int) -> None:
        base = self.system[2] if self.system else 0
        room = min(self.share * self.budget, self.budget - base - coming)
        at, used = len(self.turns), 0
        while at and used + self.turns[at - 1][2] <= room:
            at -= 1
            used += self.turns[at][2]
        self.turns = self.turns[at:]
        self.repeated, self.tokens = len(self.turns), base + used

    def close(self) -> dict:
        head = [self.system] if self.system else []
        masked = self.repeated + len(head) * (self.n > 0)
        parts, spans, at = [], [], 0
        for i, (role, text, _) in enumerate(head + self.turns):
            turn, start, stop = write_turn(role, text)
            if role == "assistant" and i >= masked:
                spans.append({"start": at + start, "stop": at + stop})
            parts.append(turn)
            at += len(turn)
        self.n += 1
        return {"conv_id": self.conv_id, "window": self.n - 1, "formatted": "".join(parts), "n_repeated": masked, "loss_spans": spans, "n_tokens": self.tokens}

    def end(self) -> list[dict]:
        return [self.close()] if self.n == 0 or len(self.turns) > self.repeated else []


def _in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _format(budget: int, share: float, ranks: str):
    def rows(batches):
        codec, open_ = bpe.Codec.of(ranks, bpe.PATTERN), None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                turns = part.to_pylist()
                # marks, names and escapes count; where two turns meet, their ends may be cut up otherwise, for which each has one more
                for turn, packed in zip(turns, codec.encode_many([write_turn(t["role"], t["text"])[0] for t in turns]), strict=True):
                    if open_ is None or open_.conv_id != turn["conv_id"]:
                        if open_ is not None:
                            yield from open_.end()
                        open_ = _Windows(turn["conv_id"], budget, share)
                    yield from open_.give(turn["role"], turn["text"], len(packed) // 4 + 1)
        if open_ is not None:
            yield from open_.end()

    return lambda batches: _in_batches(rows(batches), _WINDOW)


def format_windows(df: DataFrame, budget: int = BUDGET, history_share: float = HISTORY_SHARE, ranks: str = bpe.RANKS, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, window, formatted, n_repeated (turns at the front that are masked), loss_spans (code points) and n_tokens (a bound of the formatted window's tokens).

    Turns go by turn number, then role, then text (a null number first); repeated rows are turns of their own.  A null text
    or role is an empty one; rows with a null conv_id belong to one conversation with that id.  A turn longer than the budget gets a
    window of its own, whole.  Other columns are not looked at.  An empty table gives an empty table.
    One shuffle, by conversation; a worker streams over sorted turns and holds one window, however long a conversation is.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    dealt = rows.repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format(budget, history_share, ranks), WINDOW_FIELDS)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches):
    def rows():
        now = None
        for batch in batches:
            for window in batch.to_pylist():
                if now is None or now[0] != window["conv_id"]:
                    if now is not None:
                        yield now
                    now = [window["conv_id"], 0, sha256(), 0, sha256(), 0]
                formatted = window["formatted"]
                now[5] += len(formatted)
                for i, (role, text, _, _) in enumerate(read_turns(formatted)):
                    if i >= window["n_repeated"]:
                        now[1] += 1
                        now[2].update(f"{role}\n{text}\n".encode())
                for span in window["loss_spans"]:
                    text = unescape(formatted[span["start"] : span["stop"]])
                    now[3] += len(text)
                    now[4].update(text.encode())
        if now is not None:
            yield now

    done = ({"conv_id": r[0], "n_turns": r[1], "turns_sha256": r[2].hexdigest(), "loss_chars": r[3], "loss_sha256": r[4].hexdigest(), "formatted_chars": r[5]} for r in rows())
    yield from _in_batches(done, _DIGEST)


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read from the formatted windows alone."""
    dealt = windows.select("conv_id", "window", "formatted", "n_repeated", "loss_spans").repartition(partitions(windows.sparkSession), "conv_id")
    fields = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return dealt.sortWithinPartitions("conv_id", "window").mapInArrow(_read_back, fields)
