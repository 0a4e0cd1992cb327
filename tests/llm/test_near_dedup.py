"""Near-duplicate components against brute force."""

import random

import numpy as np
import pytest

from presflow.llm import near_dedup
from presflow.llm.common import cut
from presflow.llm.components import stars
from presflow.llm.shingles import linked, shingles, signature

SCHEMA = "doc_id bigint, text string"


def words_of(text):
    out, word = [], ""
    for c in (text or "").translate({i: i + 32 for i in range(65, 91)}):
        if c in " \t\n\x0b\x0c\r":
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def set_of(text):
    words = words_of(text)
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent=85):
    sets = {i: set_of(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def corpus(rng, n, group):
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(500)]
    prose = lambda k: rng.choices(vocabulary, k=k)
    passage, base = prose(40), prose(150)
    rows = [None, "", "  \t", "two words", "Two  WORDS", "two words "]
    for _ in range(group):  # near copies of one text, each with edits
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    for _ in range(n):
        words = prose(rng.randint(1, 120))
        if rng.random() < 0.5:
            words[rng.randint(0, len(words)) : 0] = passage
        rows.append(" ".join(words))
        while rng.random() < 0.5:
            if rng.random() < 0.7:
                words = list(words)
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(rng.choice([" ", "\n"]).join(words).upper() if rng.random() < 0.2 else " ".join(words))
    rng.shuffle(rows)
    return [(3 * i - 50, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed, n, group", [(1, 250, 0), (2, 150, 400)])
def test_against_brute_force(spark, seed, n, group):
    rows = corpus(random.Random(seed), n, group)
    got = near_dedup.link(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_sets_and_signatures():
    rng = random.Random(3)
    for _ in range(200):
        a = "".join(rng.choices(["a", "B", "c", " ", "\n", "\x0b", " ", "é", "  "], k=rng.randint(0, 40)))
        b = a + rng.choice(["", " x", " a b c d e f"])
        s, t = set_of(a), set_of(b)
        x, y = shingles(a.encode()), shingles(b.encode())
        assert (len(x), len(y)) == (len(s), len(t))
        if s and t:
            both = len(s & t)
            assert linked(x, y, 85) == (100 * both >= 85 * len(s | t))
    a = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.r_[a[:1800], a[:200] + np.uint64(7)]
    assert abs((signature(np.unique(a)) == signature(np.unique(b))).mean() - 1800 / 2200) < 0.2


def test_nulls_repeats_and_extra_columns(spark):
    text = "some words that are long enough to be shingled well in this test"
    rows = [(4, text, 1, 2), (4, text, 1, 2), (9, text, 3, 4), (None, text, 5, 6), (1, None, 7, 8), (2, "", 9, 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", sig int, node int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.link(df).collect() if r.doc_id is not None)
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (4, 9, 4, True), (4, 9, 4, True), (9, 9, 4, False)]
    assert [(r.component_id, r.kept) for r in near_dedup.link(df).collect() if r.doc_id is None] == [(None, True)]
    assert near_dedup.link(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_nodes_branch_or_meet_in_blocks(spark, monkeypatch):
    for name, value in {"LEAF": 8, "NODE": 30, "HUBS": 6, "MEETING": 40, "STAR": 8, "BLOCK": 16}.items():
        monkeypatch.setattr(near_dedup, name, value)
    levels = []
    monkeypatch.setattr(near_dedup.Search, "star", lambda self, large, depth, star=near_dedup.Search.star: levels.append(depth) or star(self, large, depth))
    rows = corpus(random.Random(4), 60, 90)
    got = near_dedup.link(spark.createDataFrame(rows, SCHEMA).repartition(3), 80).collect()
    assert sorted(map(tuple, got)) == brute(rows, 80) and levels


def test_ids_with_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "pq")
    rows = [(5, a), (5, b), (7, a + " more"), (9, b + " tail"), (5, None), (3, "alone with other words than these"), (9, b + " tail")]
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.link(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(3, 3), (5, 5), (5, 5), (5, 5), (7, 5), (9, 5), (9, 5)]


def test_links_by_matrix():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60))).astype(np.uint64) for _ in range(60)]
    found = near_dedup.links_among(sets, 30)
    assert all(found[i, j] == (i != j and linked(sets[i], sets[j], 30)) for i in range(60) for j in range(60)) and found.any()


def test_branching_keeps_alike_items_together():
    rng = np.random.default_rng(5)
    n, depth = 4000, 8

    def kept(left, right):
        """Whether two signatures meet in a node of that depth."""
        nodes = [(i, left[i]) for i in range(near_dedup.ROOTS) if left[i] == right[i]]
        for level in range(depth):
            places = [(hash((p, level)) + i * (1 + hash((p, level, 1)) % 63)) % 64 for p in nodes for i in range(near_dedup.BRANCH)]
            nodes = [(p, i, left[at]) for (p, i), at in zip([(p, i) for p in nodes for i in range(near_dedup.BRANCH)], places, strict=True) if left[at] == right[at]][:200]
        return bool(nodes)

    left = rng.integers(0, 1 << 30, (n, 64))
    for s, least in ((0.85, 0.999), (0.80, 0.995)):
        right = np.where(rng.random((n, 64)) < s, left, -1)
        assert np.mean([kept(a, b) for a, b in zip(left.tolist(), right.tolist(), strict=True)]) >= least


def test_rest_and_chunks():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60))).astype(np.uint64) for _ in range(40)]
    rest = np.arange(40) % 3 == 0
    every, some = near_dedup.links_among(sets, 30), near_dedup.links_among(sets, 30, rest)
    assert (some == every & (rest[:, None] | rest)).all() and some.any()
    assert [c.tolist() for c in near_dedup._chunks(np.array([3, 1, 9, 1, 1]), 4)] == [[0, 1], [2], [3, 4]]


def test_settled_links_are_not_gone_through_again(spark):
    n = 16
    rows = corpus(random.Random(6), 60, 120)
    conf = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in conf}
    sc = spark.sparkContext
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        sc.setJobGroup("near_dedup", "")
        got = near_dedup.link(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sorted(map(tuple, got)) == brute(rows)
    tracker = sc.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("near_dedup") for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
    assert tasks < 90 * n


def test_checkpoints_tell_how_they_are_dealt(spark):
    rows = spark.range(1000).selectExpr("id % 77 AS item", "id")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    kept = cut(rows.groupBy("item").count().repartition(4, "item"), dealt=True)
    assert kept._jdf.queryExecution().optimizedPlan().outputPartitioning().numPartitions() == 4
    assert spark.conf.get("spark.sql.adaptive.enabled") == before and kept.count() == 77


@pytest.mark.parametrize("seed", range(3))
def test_stars(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(45)] + [(7, 7), (500, 200), (500, 200), (200, 500)]
    up = {i: i for e in edges for i in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    found = stars(cut(spark.createDataFrame(edges, "a bigint, b bigint"))).collect()
    assert sorted(map(tuple, found)) == sorted((a, b) for a, b in up.items() if a != b)
    assert stars(cut(spark.createDataFrame([], "a bigint, b bigint"))).count() == 0
