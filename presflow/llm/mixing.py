"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  The cells' token weights are raked until their marginals meet the
targets; a cell's weight over its available tokens gives the probability with which each of its documents is kept.  A weight
never passes what the cell has (a probability of one), and the raking goes on with that bound.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Share of all tokens to keep, and the power of the available shares that makes default targets (1: as they are, 0: all alike).
BUDGET, TEMPER = 0.5, 0.7
SWEEPS, CLOSE = 500, 1e-9
#: Cells that the driver rakes, a row each; more are raked as a table.
MOST_CELLS = 200_000
DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A coarse topic from the whole text: empty, marked, numeric, lines or prose, by the share of such characters."""
    n = F.length(text)
    share = lambda chars: (n - F.length(F.translate(text, chars, ""))) / n
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(share("#$%&*@^_|<>{}=~") >= 0.03, "marked").when(share("0123456789") >= 0.03, "numeric").when(share("\n") >= 0.02, "lines").otherwise("prose")
    )


def rake(available: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], budget: float) -> np.ndarray:
    """Tokens to keep of each cell; places[d] is the cell's category in dimension d and targets[d] the categories' shares.

    Warns with the largest miss if the sweeps end without agreement, as they do where targets ask for more than there is.
    """
    total = available.sum() * budget
    weight = available * budget
    for _ in range(SWEEPS):
        before = weight
        for place, target in zip(places, targets, strict=True):
            now = np.bincount(place, weight, len(target))
            weight = weight * np.divide(target * total, now, out=np.ones(len(target)), where=now > 0)[place]
        weight = np.minimum(weight, available)
        if np.abs(weight - before).max(initial=0) <= CLOSE * total:
            return weight
    missed = max(np.abs(np.bincount(p, weight, len(t)) - t * total).max(initial=0) for p, t in zip(places, targets, strict=True))
    warnings.warn(f"after {SWEEPS} sweeps a marginal is missed by {missed / max(total, 1):.2%} of the budget", stacklevel=2)
    return weight


def rake_table(cells: DataFrame, shares: dict[str, DataFrame], budget: float) -> DataFrame:
    """cells (dimensions, tokens) with ``weight``, as ``rake`` finds it, for any number of cells; shares[d] is (d, target).

    A sweep is a sum and a join for each dimension, and is written, so that neither plan nor lineage grows.
    """
    total = (cells.agg(F.sum("tokens")).first()[0] or 0) * budget
    now = cut(cells.withColumn("weight", F.col("tokens") * F.lit(float(budget))))
    for _ in range(SWEEPS):
        new = now.withColumn("_was", F.col("weight"))
        for d in DIMENSIONS:
            factor = new.groupBy(d).agg(F.sum("weight").alias("_now")).join(shares[d], d, "left")
            factor = factor.select(d, F.when(F.col("_now") > 0, F.coalesce("target", F.lit(0.0)) * total / F.col("_now")).otherwise(1.0).alias("_by"))
            new = new.join(factor, d).withColumn("weight", F.col("weight") * F.col("_by")).drop("_by")
        new = cut(new.withColumn("weight", F.least("weight", F.col("tokens").cast("double"))))
        moved = new.agg(F.max(F.abs(F.col("weight") - F.col("_was")))).first()[0] or 0.0
        now = new.drop("_was")
        if moved <= CLOSE * total:
            return now
    warnings.warn(f"{SWEEPS} sweeps ended without agreement", stacklevel=2)
    return now


def tempered(shares: np.ndarray, power: float = TEMPER) -> np.ndarray:
    x = np.where(shares > 0, shares, 0) ** power * (shares > 0)
    return x / x.sum() if x.sum() else x


def _rates(cells: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float) -> tuple[DataFrame, bool]:
    """(dimensions, probability) of each cell, and whether these are few."""
    spark = cells.sparkSession
    few = cells.orderBy(*DIMENSIONS).limit(MOST_CELLS + 1).collect()
    if len(few) > MOST_CELLS:
        shares = {}
        for d in DIMENSIONS:
            has = cells.groupBy(d).agg(F.sum("tokens").alias("n"))
            given = (targets or {}).get(d)
            power = F.pow(F.col("n").cast("double"), F.lit(TEMPER))
            wanted = has.join(spark.createDataFrame(list(given.items()), f"{d} string, w double"), d, "left").select(d, F.coalesce("w", F.lit(0.0)).alias("w")) if given else has.select(d, F.when(F.col("n") > 0, power).otherwise(0.0).alias("w"))
            shares[d] = wanted.crossJoin(F.broadcast(wanted.agg(F.sum("w").alias("_all")))).select(d, F.when(F.col("_all") > 0, F.col("w") / F.col("_all")).otherwise(0.0).alias("target"))
        raked = rake_table(cells, shares, budget)
        return raked.select(*DIMENSIONS, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(float(budget)).alias("probability")), False
    available = np.array([c.tokens for c in few], float)
    places, wanted = [], []
    for d in DIMENSIONS:
        names, place = np.unique(np.array([c[d] for c in few], object).astype(str), return_inverse=True) if few else (np.array([], str), np.zeros(0, int))
        has = np.bincount(place, available, len(names)) if few else np.zeros(0)
        given = (targets or {}).get(d)
        shares = np.array([given.get(str(x), 0.0) for x in names]) if given else tempered(has / max(1.0, has.sum()))
        places.append(place)
        wanted.append(shares / shares.sum() if shares.sum() else shares)
    weight = rake(available, places, wanted, budget)
    rates = [(*[c[d] for d in DIMENSIONS], float(w / a) if a else float(budget)) for c, w, a in zip(few, weight, available, strict=True)]
    return spark.createDataFrame(rates, "source string, lang string, topic string, probability double"), True


def _drawn(df: DataFrame, targets, budget, doc_id, text, source, lang, topic, tokens, seed) -> DataFrame:
    """Every row as a struct ``row``, beside its cell, n_tokens, probability and kept."""
    label = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    words = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"\S+")), F.lit(0)) if tokens is None else F.coalesce(tokens, F.lit(0))
    key = F.col(f"`{doc_id}`")
    drawn_by = F.when(key.isNotNull(), F.xxhash64(key, F.lit(seed))).otherwise(F.xxhash64(F.col(f"`{text}`"), F.lit(seed)))
    spot = F.pmod(drawn_by, F.lit(1 << 52)) / float(1 << 52)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), label(source).alias("source"), label(lang).alias("lang"), (topic_of(F.col(f"`{text}`")) if topic is None else topic).alias("topic"), words.cast("bigint").alias("n_tokens"), spot.alias("spot"))
    rates, few = _rates(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), targets, budget)
    met = rows.join(F.broadcast(rates) if few else rates, list(DIMENSIONS))
    return met.withColumn("kept", F.col("spot") < F.col("probability"))


def mix(
    df: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, tokens: Column | None = None, seed: int = 5
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and kept of every row.

    ``targets`` gives shares by category for any of source, lang and topic; the others' targets are the available shares to
    the power TEMPER.  ``topic`` and ``tokens`` may give each row's; without, tokens are words and topics coarse ones of the
    text.  A null source or language is a category of its own (an empty string).  A document without tokens is kept with the
    overall probability.  The draw is by a hash of the id, so that repeated rows share one, and of the text where the id is
    null.  Other columns are not looked at.  An empty table gives an empty table.
    One pass for the cells and one for the draw; texts are not shuffled, unless there are more than MOST_CELLS cells.
    """
    rows = _drawn(df, targets, budget, doc_id, text, source, lang, topic, tokens, seed)
    return rows.select(F.col(f"row.`{doc_id}`").alias("doc_id"), *DIMENSIONS, "n_tokens", "probability", "kept")


def drawn(df: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, tokens: Column | None = None, seed: int = 5) -> DataFrame:
    """The rows that ``mix`` keeps, with all their columns and no others."""
    return _drawn(df, targets, budget, doc_id, text, source, lang, topic, tokens, seed).filter("kept").select("row.*")


def marginals(mixed: DataFrame) -> DataFrame:
    """dimension, category, tokens there and expected to be kept."""
    frames = [mixed.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("category")).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected")) for d in DIMENSIONS]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


