"""The pipeline's stages on a small table."""

import random
from hashlib import sha256

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from presflow.llm import bpe, mixing, queries
from test_near_dedup import brute as near_brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    words = {"en": ["the", "and", "thing", "wheel", "north", "house", "water"], "de": ["der", "und", "ding", "rad", "norden", "haus", "wasser"], "fr": ["le", "et", "chose", "roue", "nord", "maison", "eau"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(words))
        text = " ".join("".join(rng.choices(words[lang], k=2)) for _ in range(rng.randint(8, 60)))
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    base = rows[3][1] + " " + rows[9][1] + " " + rows[12][1]
    rows += [(300, base, "en", "s1", len(base)), (301, base, "en", "s1", len(base)), (302, base + " more", "en", "s2", len(base) + 5)]
    rows += [(400, None, "en", "s0", 0), (401, "", None, "s0", 0), (402, "12 34 !!", "en", "s0", 8), (403, "x", None, None, 1)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()), key=str)


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = {"documents": docs}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{name}")
        before = done[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe_encoding":
            assert before.columns == docs.columns and before.dtypes == docs.dtypes
    first = {r[0] for r in rows_of(done["language_id"])}
    assert {400, 401, 402}.isdisjoint(first) and set(range(240)) <= first

    found = rows_of(done["language_id"])
    kept = {i for i, _, _, stays in near_brute([(i, t) for i, t, _ in found], corpus_pipeline.NEAR_PERCENT) if stays}
    assert rows_of(done["minhash_near_dedup"]) == [r for r in found if r[0] in kept] and {301, 302}.isdisjoint(kept)

    want = []
    found = rows_of(done["minhash_near_dedup"])
    starts = {}
    for i, t, _ in found:
        for at in range(len(t.encode()) - 49):
            starts[t.encode()[at : at + 50]] = min(i, starts.get(t.encode()[at : at + 50], i))
    for i, t, s in found:
        raw, gone = t.encode(), set()
        for at in range(len(raw) - 49):
            if starts[raw[at : at + 50]] < i:
                gone |= set(range(at, at + 50))
        left = bytes(b for n, b in enumerate(raw) if n not in gone).decode("utf-8", "ignore")
        want += [(i, left, s)] if left or not gone else []
    assert rows_of(done["suffix_array_dedup"]) == sorted(want, key=str)

    cells, words = {}, lambda r: len(r.text.split())
    everyone = done["suffix_array_dedup"].collect()
    mixed = {r.doc_id: r for r in mixing.mix(done["suffix_array_dedup"], budget=corpus_pipeline.MIX_BUDGET).collect()}
    for r in everyone:
        key = mixed[r.doc_id].source, mixed[r.doc_id].lang, mixed[r.doc_id].topic
        assert key[0] == (r.source or "") and key[1] == (r.lang or "") and mixed[r.doc_id].n_tokens == words(r)
        cells[key] = cells.get(key, 0) + words(r)
    keys = sorted(cells)
    available = np.array([cells[k] for k in keys], float)
    places = [np.unique([k[d] for k in keys], return_inverse=True)[1] for d in range(3)]
    weight = mixing.rake(available, places, [mixing.tempered(np.bincount(p, available) / available.sum()) for p in places], corpus_pipeline.MIX_BUDGET)
    chance = dict(zip(keys, weight / available, strict=True))
    assert all(abs(m.probability - chance[m.source, m.lang, m.topic]) < 1e-9 for m in mixed.values())
    assert rows_of(done["mixing"]) == [r for r in rows_of(done["suffix_array_dedup"]) if mixed[r[0]].kept]

    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    texts = {r.doc_id: r.text for r in done["mixing"].collect()}
    coded = done["bpe_encoding"].collect()
    assert sorted(r.doc_id for r in coded) == sorted(texts)
    for r in coded:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(texts[r.doc_id].encode()).hexdigest())


def test_odd_rows_through_the_stages(spark, tmp_path):
    text = "the north wheel and the house of water thing and the wheel north of the house by the water"
    rows = [(5, text, "en", "a", 9, 1.0, 2), (5, text, "en", "a", 9, 1.0, 2), (7, text + " more", "en", None, 9, None, 3), (None, text, "en", "b", 9, 0.5, 4), (None, None, None, None, None, None, None), (9, "", "en", "a", 0, 0.1, 5)]
    wide = SCHEMA + ", probability double, kept int"
    for some in (rows, []):
        docs = spark.createDataFrame(some, wide)
        for name, stage in corpus_pipeline.STAGES[1:]:
            stage(spark, docs, "").write.mode("overwrite").parquet(f"{tmp_path}/{len(some)}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{len(some)}-{name}")
            if name == "minhash_near_dedup" and some:
                assert sorted((r.doc_id for r in docs.collect()), key=str) == [5, 9, None, None]
        assert docs.count() == 0 or some


def test_every_operator_has_a_query():
    assert [sum(name.startswith(f"op{n}_") for name in queries.QUERIES) for n in range(1, 11)] == [1] * 10


def test_run_writes_between_stages(spark, sf_dir, monkeypatch):
    read = []

    def stage(spark, docs, sf_dir):
        read.append({f.rsplit("/", 2)[1] for f in docs.inputFiles()})
        return docs.filter("doc_id > 5")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage), ("three", stage)])
    assert corpus_pipeline.run(spark, sf_dir).filter("doc_id <= 5").count() == 0
    assert read == [{"documents.parquet"}, {"one"}, {"two"}]
