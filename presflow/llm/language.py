"""Language identification in two steps: the family first, then languages within it.

Features are counts of hashed byte 1- to 4-grams of the lower-cased text with other characters blanked, scaled by their
square roots and to unit length.  Families are told apart by linear support vector machines of each against each, and so
are the languages of a family; the most duels won decide, then the sum of margins.  All machines are trained here, by dual
coordinate descent on a bounded sample of labelled rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import claim

#: Families of languages by code.  A language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af yi lb fy fo",
    "romance": "fr es it pt ro ca gl oc la sc ast",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt tk",
    "indo-aryan": "hi bn ur pa gu mr ne si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he am mt",
    "sinitic": "zh yue wuu",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms jv su tl mg",
    "tai": "th lo",
    "bantu": "sw zu xh st sn rw",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Labelled rows that are learned from: never more than SAMPLE, an equal share for each language; of more than SAMPLE languages the most frequent.
SAMPLE = 1200
FEATURES = 1 << 14
GRAMS = 4
UNKNOWN = "und"
_BLANK = bytes(x if x >= 128 or 97 <= x <= 122 else 32 for x in range(256))
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIER = np.uint32(2654435761)


def family_of(language: str) -> str:
    return _FAMILY.get(language.split("-")[0].split("_")[0].lower(), language)


def features(text: str) -> np.ndarray | None:
    """A unit vector, or None if the text has no letter."""
    raw = text.lower().encode().translate(_BLANK)
    if not raw.strip() or (raw.isascii() is False and _LETTER.search(text) is None):
        return None
    x = np.frombuffer(b" " + b" ".join(raw.split()) + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(FEATURES)
    gram = x.copy()
    for n in range(1, GRAMS + 1):
        if n > 1:
            gram = (gram[:-1] << np.uint32(8)) | x[n - 1 :] if len(gram) > 1 else gram[:0]
        counts += np.bincount(((gram + np.uint32(n)) * _MULTIPLIER) >> np.uint32(32 - 14), minlength=FEATURES)
    counts = np.sqrt(counts)
    return (counts / np.sqrt((counts**2).sum())).astype(np.float32)


def svm(gram: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Signed dual weights of the rows of a linear machine with hinge loss; ``gram`` has their inner products, y is -1 or 1."""
    alpha, margin = np.zeros(len(y)), np.zeros(len(y))
    rng = np.random.default_rng(len(y))
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * margin[i] - 1) / gram[i, i], 0.0), c)
            if new != alpha[i]:
                margin += (new - alpha[i]) * y[i] * gram[i]
                alpha[i] = new
    return alpha * y


class _Duels:
    """Machines of each class against each."""

    def __init__(self, x: np.ndarray, gram: np.ndarray, labels: list[str | None]):
        """Rows whose label is None take no part."""
        self.classes = sorted({label for label in labels if label is not None})
        names = np.array([label if label is not None else "" for label in labels])
        used = np.array([label is not None for label in labels], bool)
        pairs = np.array(list(combinations(range(len(self.classes)), 2)), int).reshape(-1, 2)
        #: For each class the duels it leads and those it is the second of.
        self.duels = [(np.flatnonzero(pairs[:, 0] == c), np.flatnonzero(pairs[:, 1] == c)) for c in range(len(self.classes))]
        of = [np.flatnonzero(used & (names == c)) for c in self.classes]
        # a machine is a sum of sample rows: with more machines than rows the sums' factors are less than the sums
        self.rows = np.flatnonzero(used) if len(pairs) > used.sum() else None
        self.factors = []
        weights = np.zeros((0 if self.rows is not None else len(pairs), x.shape[1]), np.float32)
        for k, (a, b) in enumerate(pairs):
            either = np.concatenate([of[a], of[b]])
            dual = svm(gram[np.ix_(either, either)], np.repeat([1.0, -1.0], [len(of[a]), len(of[b])])).astype(np.float32)
            if self.rows is None:
                weights[k] = dual @ x[either]
            else:
                self.factors.append((np.searchsorted(self.rows, either).astype(np.int32), dual))
        self.weights, self.count = weights.T, len(pairs)

    def margins(self, x: np.ndarray, sample: np.ndarray) -> np.ndarray:
        if self.rows is None:
            return x @ self.weights
        near = x @ sample[self.rows].T
        return np.array([near[:, at] @ dual for at, dual in self.factors]).T

    def decide(self, x: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers, and the least margin of the winner in its duels (infinite if there are none)."""
        margins = self.margins(x, sample)
        n = len(self.classes)
        won, sums, least = np.zeros((len(x), n)), np.zeros((len(x), n)), np.full((len(x), n), np.inf)
        for c, (first, second) in enumerate(self.duels):
            own = np.hstack([margins[:, first], -margins[:, second]])
            won[:, c] = (margins[:, first] > 0).sum(1) + (margins[:, second] <= 0).sum(1)
            sums[:, c], least[:, c] = own.sum(1), own.min(1, initial=np.inf)
        best = np.lexsort((np.tile(-np.arange(n), (len(x), 1)), sums, won))[:, -1] if n > 1 else np.zeros(len(x), int)
        return best, least[np.arange(len(x)), best]


class Model:
    """Family machines, and machines of the languages of each family."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        gram = (x @ x.T).astype(np.float64)
        self.sample = x
        self.families = _Duels(x, gram, [family_of(language) for language in languages])
        self.within = {}
        for family in self.families.classes:
            self.within[family] = _Duels(x, gram, [language if family_of(language) == family else None for language in languages])
        if all(d.rows is None for d in [self.families, *self.within.values()]):
            self.sample = x[:0]  # no machine needs it any more

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        vectors = [(i, v) for i, text in enumerate(texts) if text and (v := features(text)) is not None]
        if not vectors or not self.families.classes:
            return names, scores
        x = np.array([v for _, v in vectors])
        family, margin = self.families.decide(x, self.sample)
        for f, name in enumerate(self.families.classes):
            rows = np.flatnonzero(family == f)
            if len(rows):
                best, inner = self.within[name].decide(x[rows], self.sample)
                for row, b, m in zip(rows, best, np.minimum(margin[rows], inner), strict=True):
                    i = vectors[row][0]
                    names[i] = self.within[name].classes[b]
                    scores[i] = round(float(np.clip((1 + m) / 2, 0.0, 1.0)), 6)  # sums differ in the last digits with the rows of a batch; a margin of 1 or more is sure, one of -1 or less is not
        return names, scores


def _vectors(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            made = [(lang, v) for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if (v := features(text)) is not None]
            if made:
                places = [np.flatnonzero(v) for _, v in made]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang for lang, _ in made]), pa.array([p.astype("u2").tobytes() for p in places]), pa.array([v[p].tobytes() for (_, v), p in zip(made, places, strict=True)])],
                    ["lang", "places", "values"],
                )


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of rows (row_key, lang, text).  Which rows are taken follows from a hash of the key, then the text, and each language's count;
    at most ``sample`` rows of at most FEATURES numbers reach the driver, whatever the texts' length and however many languages there are."""
    labelled = labelled.filter("lang is not null and text is not null")
    counts = dict(labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect())  # one row a language
    share = sample // max(1, len(counts))
    spot = F.pmod(F.xxhash64("row_key"), F.lit(1 << 40))
    # some rows more than the share are asked for, as the draw is by chance
    rate = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, int(min(1.0, (1.25 * share + 8) / n) * (1 << 40)))]) if counts else F.create_map().cast("map<string,bigint>")
    drawn = labelled.select("lang", "text", spot.alias("_spot")).filter(F.col("_spot") < rate[F.col("lang")])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_spot", F.xxhash64("text"), "text"))
    rows = drawn.withColumn("_n", first).filter(F.col("_n") <= share).select("lang", "text").mapInArrow(_vectors, "lang string, places binary, values binary").collect()
    x, languages = np.zeros((len(rows), FEATURES), np.float32), []
    for row in sorted(rows, key=lambda r: (r.lang, bytes(r.places), bytes(r["values"]))):
        x[len(languages), np.frombuffer(row.places, "u2")] = np.frombuffer(row["values"], np.float32)
        languages.append(row.lang)
    del rows
    return Model(x, languages)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1) in place of columns of these names; ``und`` and 0 for a null text or one without a letter.

    The model is sent once: never more numbers than the sample has, FEATURES a row, and twice a row for each class.  One pass without a shuffle; repeated rows
    are rows of their own, an empty table gives an empty table.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in ("lang_pred", "score")])

    def run(batches):
        claim("language", lambda: None)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                names, scores = sent.value.predict(part.column(part.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, fields + ", lang_pred string, score double")


def identify(df: DataFrame, held_out: Column, row_key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """All columns, with held_out, lang_pred and score: learned from the rows with a language that are not held out.

    ``held_out`` is a condition on the row key; where it is null (a null key), the row counts as held out.
    """
    marked = df.drop("held_out").withColumn("held_out", F.coalesce(held_out, F.lit(True)))
    rows = marked.filter(~F.col("held_out")).select(F.col(row_key).alias("row_key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    return predict(marked, train(rows, sample), text)
