"""Benchmark windows against a plain search over words."""

import random
import re
from hashlib import sha256

from presflow.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def model(text, items, window=10):
    found, hit, ids = words(text), set(), set()
    for item_id, item in items:
        own = words(item)
        if item_id is None or not own:
            continue
        n = min(window, len(own))
        wanted = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(found) - n + 1):
            if tuple(found[i : i + n]) in wanted:
                hit.update(range(i, i + n))
                ids.add(item_id)
    digest = sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    return len(found), len(hit), len(ids), digest, bool(hit)


def tables(seed=1):
    rng = random.Random(seed)
    few = ["Ab", "b", "ÉTÉ", "c3", "dé", "ee"]
    say = lambda n: rng.choice([" ", "-", ".\n"]).join(rng.choice(few) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(20)]
    items += [(100, None), (101, ""), (102, "?!"), (None, "b b b"), (3, "one more text of an item that is there twice in all so"), (103, "x" * 300), (104, items[5][1].upper())]
    texts = [None, "", "...", "x" * 300, "y" + "x" * 300, "one more text of an item that is there twice in all", "One more text of AN item; that is there twice in all so"]
    for _ in range(80):
        parts = [say(rng.randint(0, 12)), rng.choice(items)[1] or "", say(rng.randint(0, 8)), rng.choice(items)[1] or ""]
        texts.append(rng.choice([" ", "", "\x00"]).join(parts))
    texts.append(say(40_000) + " " + items[8][1] + " " + "z" * 120_000)
    return [(i, t, "n_hit") for i, t in enumerate(texts)] + [(2, texts[9], ""), (2, texts[9], ""), (None, texts[10], "")], items


def collected(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()], key=str)


def test_against_plain_search(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STRETCH", 64)
    rows, items = tables()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_hit string").repartition(3)
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    want = sorted([(r[0], *model(r[1], items)) for r in rows], key=str)
    assert collected(decontaminate.decontaminate(df, benchmark)) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)  # a benchmark that needs many blocks
    assert collected(decontaminate.decontaminate(df, benchmark)) == want
    assert decontaminate.decontaminate(df.limit(0), benchmark).count() == 0


def test_without_items(spark):
    rows, _ = tables(2)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_hit string")
    empty = spark.createDataFrame([(5, None), (6, "")], "item_id bigint, text string")
    assert collected(decontaminate.decontaminate(df, empty)) == sorted([(r[0], *model(r[1], [])) for r in rows], key=str)


def test_places_are_skipped():
    """A pointer over text that holds no pattern's words visits few of its places."""
    patterns = [b" " + b" ".join(w * 5 for w in (b"ab", b"cd", b"ef", b"gh")) + b" "]
    one = decontaminate._Class(patterns, decontaminate.np.arange(1))
    visited = []
    plain = one.hash
    one.hash = lambda eight: visited.append(len(eight)) or plain(eight)
    raw = b"\n" * 8 + b" xyz uvw" * 4000 + b"\n"
    at, _ = one.search(decontaminate.np.frombuffer(raw, decontaminate.np.uint8), raw)
    assert not len(at) and sum(visited) < len(raw) / 10
    raw += patterns[0] * 2
    at, found = one.search(decontaminate.np.frombuffer(raw, decontaminate.np.uint8), raw)
    assert at.tolist() == [len(raw) - 2 * len(patterns[0]), len(raw) - len(patterns[0])]
