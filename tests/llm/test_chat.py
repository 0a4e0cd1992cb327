"""Chat formatting against a plain model."""

import random
from hashlib import sha256

import pytest

from presflow.llm import bpe, chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PARTS = ["[INST] ", " [/INST]", "<a>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE x]", "[/ROLE]", "\\", "]", "<", "[", "a", " word", "\n", "é", ""]


def expected(rows):
    turns, loss = sha256(), sha256()
    for role, text in rows:
        turns.update(f"{role or ''}\n{text or ''}\n".encode())
        if role == "assistant":
            loss.update((text or "").encode())
    return len(rows), turns.hexdigest(), sum(len(t or "") for r, t in rows if r == "assistant"), loss.hexdigest()


def test_turn_round_trip():
    rng = random.Random(5)
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "a]b\\", "[/ROLE]"]), "".join(rng.choices(PARTS, k=rng.randint(0, 6)))) for _ in range(rng.randint(0, 4))]
        formatted = "".join(chat.write_turn(*t)[0] for t in turns)
        assert [(r, t) for r, t, _, _ in chat.read_turns(formatted)] == turns


@pytest.mark.parametrize("budget", [1, 20, 10_000])
def test_windows_read_back(spark, budget):
    rng = random.Random(budget)
    rows = []
    for conv in range(40):
        roles = ["system"] * (conv % 3 == 0) + [rng.choice(["user", "assistant", "tool", "system", None]) for _ in range(rng.randint(0, 12))]
        rows += [(conv, i, role, None if rng.random() < 0.1 else "".join(rng.choices(PARTS, k=rng.randint(0, 9)))) for i, role in enumerate(roles)]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    by_conv = {}
    for conv, _, role, text in rows:
        by_conv.setdefault(conv, []).append((role, text))
    rng.shuffle(rows)
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget=budget)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
    assert got == {conv: expected(turns) for conv, turns in by_conv.items()}
    codec = bpe.Codec.of(bpe.RANKS, bpe.PATTERN)
    for w in windows.collect():
        assert len(codec.encode(w.formatted)) // 4 <= w.n_tokens
    if budget == 20:
        for w in windows.collect():
            new = [t for i, t in enumerate(chat.read_turns(w.formatted)) if i >= w.n_repeated]
            assert new and (w.n_tokens <= budget or len(new) == 1 or w.window == 0 and len(new) == 2)


def test_history_is_repeated_and_masked(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn number {i} says a few words") for i in range(1, 30)]
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget=60).orderBy("window").collect()
    assert len(windows) > 3
    for w in windows[1:]:
        turns = list(chat.read_turns(w.formatted))
        assert turns[0][:2] == ("system", "be kind") and w.n_repeated >= 2
        spans = {(s.start, s.stop) for s in w.loss_spans}
        assert spans == {(a, b) for i, (role, _, a, b) in enumerate(turns) if role == "assistant" and i >= w.n_repeated}


def test_marks_count(spark):
    """Many turns of one word: what is formatted fits into the budget, not only the words."""
    rows = [(1, i, "user" if i % 2 else "assistant", "ok") for i in range(400)] + [(2, i, "a role with a long name", "\\[INST] ]") for i in range(60)]
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget=100).collect()
    codec = bpe.Codec.of(bpe.RANKS, bpe.PATTERN)
    assert len(windows) > 20 and max(len(codec.encode(w.formatted)) // 4 for w in windows) <= 100


def test_empty_nulls_and_clashing_columns(spark):
    assert chat.format_windows(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, None, "x", 3), (1, None, None, None, "x", 3), (None, 1, "assistant", "hi", "y", 4)]
    df = spark.createDataFrame(rows, SCHEMA + ", formatted string, window int")
    got = {r.conv_id: r.n_turns for r in chat.read_back(chat.format_windows(df)).collect()}
    assert got == {1: 2, None: 1}
