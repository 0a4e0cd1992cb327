"""Language identification on held-out rows."""

import os
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from presflow.llm import language
from presflow.llm.common import id_crc_mod5

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve", "de": "en er ch de ei te in nd ie ge un sch st be ung ich au ne es auf", "fr": "es le de en re nt on er ou ai te et eu que la qu é è eau", "es": "de es en el la os ar ue ra re er as on st do ad ñ ción"}


def rows(rng, n):
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        out.append((i, " ".join(words), lang if i % 10 else None, 0.5))
    return out


def test_held_out_accuracy(spark):
    data = rows(random.Random(7), 900) + [(5000, None, "en", 0.1), (5001, "123 !?", "en", 0.1), (5002, "", None, 0.1), (None, "the other", "en", 0.1)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, score double")
    got = language.identify(df, id_crc_mod5(F.col("doc_id")) == 0).collect()
    assert len(got) == len(data)
    truth = {r[0]: r for r in rows(random.Random(7), 900)}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900 and truth[r.doc_id][2]]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (5000, 5001, 5002))
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in language.identify(df, F.lit(False)).collect()] == ["und"]
    assert language.identify(df.limit(0), F.lit(False)).count() == 0


def test_families():
    assert language.family_of("en") == language.family_of("de-AT") == "germanic" and language.family_of("xx") == "xx"


def test_held_out_accuracy_on_the_test_tables(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("the test tables are not here")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    told = language.identify(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).filter("held_out and lang is not null and lang_pred <> 'und'")
    right, n = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.95, (right, n)


def test_the_sample_is_bounded_for_any_number_of_languages(spark):
    """300 languages and 120 rows: no more rows are learned from, the machines are no larger than the sample, and what was learned is told apart."""
    names = [f"x{i:03d}" for i in range(300)]
    word = lambda i: "".join("bcdfghjklmnpqrstvwz"[(i * 7 + j * j * (i % 13 + 1)) % 19] + "aeiou"[(i + j * (i % 5 + 1)) % 5] for j in range(6))
    data = [(k * 300 + i, " ".join([word(i)] * 12), name) for k in range(3) for i, name in enumerate(names)]
    df = spark.createDataFrame([*data, *[(9000 + i, "the same text again", "en") for i in range(50)], (9100, "\u0645 " * 40_000, None)], "row_key bigint, text string, lang string").repartition(4)
    model = language.train(df, 120)
    learned = [c for d in model.within.values() for c in d.classes]
    assert len(learned) <= 120 and "en" in learned and model.sample.shape[0] <= 120
    duels = model.families
    assert duels.rows is not None and sum(len(at) for at, _ in duels.factors) <= 2 * duels.count and duels.weights.size == 0
    got = language.predict(df, model).filter(F.col("lang").isin(learned)).collect()
    assert len(got) > 300 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.9


def test_factored_machines_equal_plain_ones():
    """Machines kept as sums of sample rows decide as machines kept as weights, and as a plain loop over duels."""
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(size=(40, language.FEATURES))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = [f"l{i % 7}" for i in range(40)]
    plain = language._Duels(x, (x @ x.T).astype(float), labels)
    assert plain.rows is None
    factored = language._Duels(x, (x @ x.T).astype(float), labels)
    factored.rows, factored.factors = np.arange(40), []
    pairs = list(combinations(range(7), 2))
    for a, b in pairs:
        at = np.array([i for i in range(40) if i % 7 == a] + [i for i in range(40) if i % 7 == b])
        y = np.array([1.0 if i % 7 == a else -1.0 for i in at])
        factored.factors.append((at, language.svm((x[at] @ x[at].T).astype(float), y).astype(np.float32)))
    for got, want in zip(factored.decide(x, x), plain.decide(x, x[:0]), strict=True):
        assert np.allclose(got, want, atol=1e-4)
    margins = x @ plain.weights
    for i, (best, least) in enumerate(zip(*plain.decide(x, x[:0]), strict=True)):
        won, sums = [0] * 7, [0.0] * 7
        for k, (a, b) in enumerate(pairs):
            won[a if margins[i, k] > 0 else b] += 1
            sums[a] += margins[i, k]
            sums[b] -= margins[i, k]
        assert best == max(range(7), key=lambda c: (won[c], sums[c], -c))
        assert np.isclose(least, min(margins[i, k] if best == a else -margins[i, k] for k, (a, b) in enumerate(pairs) if best in (a, b)), atol=1e-5)


def test_repeated_rows_and_clashing_columns(spark):
    data = [(i, t, lang, "kept", 7) for i, t, lang, _ in rows(random.Random(3), 120)]
    df = spark.createDataFrame([*data, data[1], data[1]], "doc_id bigint, text string, lang string, Lang_Pred string, held_out int")
    got = language.identify(df, F.col("doc_id") % 5 == 0).collect()
    assert len(got) == 122 and all(isinstance(r.held_out, bool) and r.lang_pred != "kept" for r in got)
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == data[1][0]}) == 1
