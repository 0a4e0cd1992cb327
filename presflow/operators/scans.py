"""Running values over ordered rows in two levels, for keys with very many rows.

A window over a key puts all its rows into one task.  Here rows are dealt by key and bin (``width`` of the first order column), values
run within a bin, and what each bin comes to (its largest, sum, first or last row) runs over the bins: a table of one row a
bin.  The carries go back to the rows of their bin.  Each step of a scan must be associative: maxima, minima, sums, first and last values.

The rows are shuffled once a scan and both levels read that shuffle: Spark takes it twice only if both need the same columns of it, so
ties are told apart by a hash of the whole row, which both look at.  Select what is needed before a scan.  Where the bins' table is
too large to be broadcast, it is joined on the key and bin by which the rows lie, and are sorted, already.

A scan names its input twice, so a plan of scans over scans doubles with each; Spark runs a shuffle once, but plans all of it.  ``settled``
writes what lies between, where such a plan would be long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoints

#: Width of a bin: a minute of milliseconds.
WIDTH = 60_000
_AGGREGATES = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, None)}


@dataclass(frozen=True)
class Step:
    kind: str
    value: Column
    how: str = "max"


def before(value: Column, how: str = "max") -> Step:
    """The largest (min, sum) value of all earlier rows; null, or 0 for a sum, where there is none."""
    return Step("before", value, how)


def upto(value: Column, how: str = "sum") -> Step:
    """The same with the row itself."""
    return Step("upto", value, how)


def after(value: Column, how: str = "min") -> Step:
    """The same of all later rows."""
    return Step("after", value, how)


def following(value: Column) -> Step:
    """The next row's value; null where there is none."""
    return Step("following", value)


def preceding(value: Column) -> Step:
    """The row before's value."""
    return Step("preceding", value)


#: What comes after is what comes before in falling order: a frame that has no end is worked out anew for each row.
_FRAMES = {"before": (Window.unboundedPreceding, -1), "upto": (Window.unboundedPreceding, 0), "after": (Window.unboundedPreceding, -1)}


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that what reads it several times has a short plan and finds it worked out."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def scan(df: DataFrame, keys: list[str], order: list[str], width: int = WIDTH, **steps: Step) -> DataFrame:
    """``df`` with a column for each step, over the rows of a key in order (nulls first; equal rows of ``order`` by a hash of the row).

    The first column of ``order`` is a number; the others tell its ties apart.  Keys may be null.  No column may be a map.
    """
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.withColumn("_key", key).withColumn("_bin", F.coalesce(F.floor(F.col(order[0]) / width), F.lit(-(1 << 62))))
    dealt = rows.repartition("_key", "_bin")
    row = F.xxhash64(*df.columns)
    inner, outer = Window.partitionBy("_key", "_bin").orderBy(*order, row), Window.partitionBy("_key").orderBy("_bin")
    falling, falling_bins = Window.partitionBy("_key", "_bin").orderBy(*[F.desc(c) for c in order], row.desc()), Window.partitionBy("_key").orderBy(F.desc("_bin"))
    place = F.struct(*[F.col(c) for c in order], row)
    local, totals, carries, whole = [], [F.max(row).alias("_seen")], [], {}
    for name, s in steps.items():
        own, total, carry = f"_l_{name}", f"_t_{name}", f"_c_{name}"
        if s.kind in _FRAMES:
            aggregate, join = _AGGREGATES[s.how]
            within, across = (falling, falling_bins) if s.kind == "after" else (inner, outer)
            local.append(aggregate(s.value).over(within.rowsBetween(*_FRAMES[s.kind])).alias(own))
            totals.append(aggregate(s.value).alias(total))
            carries.append(aggregate(total).over(across.rowsBetween(*_FRAMES["before"])).alias(carry))
            zero = lambda c: F.coalesce(F.col(c), F.lit(0))
            whole[name] = zero(own) + zero(carry) if join is None else join(own, carry)
        else:
            near, end = (F.lead, F.min_by) if s.kind == "following" else (F.lag, F.max_by)
            boxed = F.struct(s.value.alias("v"))  # a null value is not the same as no row
            local.append(near(boxed).over(inner).alias(own))
            totals.append(end(boxed, place).alias(total))
            carries.append(near(total).over(outer).alias(carry))
            whole[name] = F.coalesce(own, carry)["v"]
    bins = dealt.groupBy("_key", "_bin").agg(*totals).filter("_seen is not null").select("_key", "_bin", *carries)
    out = dealt.select("*", *local).join(bins, ["_key", "_bin"])
    return out.select(*[F.col(c) for c in df.columns if c not in steps], *[c.alias(name) for name, c in whole.items()])
