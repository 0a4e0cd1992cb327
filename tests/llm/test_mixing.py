"""Raking and the draw."""

import numpy as np
from pyspark.sql import functions as F

from presflow.llm import mixing


def test_rake_meets_marginals():
    rng = np.random.default_rng(1)
    a, b, c = (x.ravel() for x in np.meshgrid(range(4), range(3), range(2), indexing="ij"))
    available = rng.integers(100, 1000, 24).astype(float)
    targets = [mixing.tempered(np.bincount(p, available) / available.sum(), 0.6) for p in (a, b, c)]
    weight = mixing.rake(available, [a, b, c], targets, 0.3)
    for place, target in zip((a, b, c), targets):
        assert np.allclose(np.bincount(place, weight) / weight.sum(), target, atol=1e-6)
    assert np.isclose(weight.sum(), 0.3 * available.sum()) and (weight <= available).all()


def test_mix(spark):
    rows = [(i, f"w {i} " * (i % 9 + 1), "a" if i % 3 else "b", ["en", "de", None][i % 5 % 3], 1) for i in range(6000)] + [(None, None, None, "en", 2), (7, "", "a", None, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, probability int")
    mixed = mixing.mix(df, {"source": {"a": 0.5, "b": 0.5}}, budget=0.4).cache()
    assert mixed.count() == len(rows)
    got = {(r.dimension, r.category): r for r in mixing.marginals(mixed).collect()}
    total = sum(r.expected for k, r in got.items() if k[0] == "source")
    assert abs(got["source", "a"].expected / total - 0.5) < 1e-6
    kept = mixed.filter("kept").agg(F.sum("n_tokens")).first()[0]
    assert abs(kept / total - 1) < 0.1
    assert mixing.mix(df.limit(0)).count() == 0


def test_tables_of_cells_are_raked_alike(spark, monkeypatch):
    rows = [(i, "w " * (i % 9 + 1), f"s{i % 5}", f"l{i % 3}") for i in range(400)] + [(None, "w w", "s1", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    want = sorted((str(r.doc_id), round(r.probability, 6), r.kept) for r in mixing.mix(df, budget=0.4).collect())
    monkeypatch.setattr(mixing, "MOST_CELLS", 3)
    assert sorted((str(r.doc_id), round(r.probability, 6), r.kept) for r in mixing.mix(df, budget=0.4).collect()) == want


def test_given_tokens_and_topics(spark):
    rows = [(i, "some text", "a", "en", i % 4 + 1, f"t{i % 2}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n int, t string")
    got = mixing.mix(df, topic=F.col("t"), tokens=F.col("n")).collect()
    assert sum(r.n_tokens for r in got) == sum(r[4] for r in rows) and {r.topic for r in got} == {"t0", "t1"}
    assert mixing.drawn(df, budget=0.5).columns == df.columns
