"""Document fingerprints by Order MinHash, in DataFrame functions alone.

A text's k-mers (over its UTF-8 bytes) are numbered by occurrence.  Every numbered k-mer falls into one of BINS bins by its
hash; in each bin the PER_BIN least k-mers are selected, put back into text order and hashed as a tuple.  The fingerprint
holds one tuple hash a bin, so it changes with the k-mers and with their order, as edit distance does.

Bins are filled by the hash of the bare k-mer, least first, so k-mers of small hash settle them.  A pass keeps the positions
whose hash lies under a limit, about KEPT of them, and of these the MOST least (hash, occurrence).  If they fill every bin, no
other k-mer of the text can be among the least of one.  If they don't (about one long text in a hundred, and texts of few
different k-mers), the MOST least of the whole text are taken, and if these leave a bin open, the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions

K, BINS, PER_BIN = 12, 48, 2
KEPT, MOST = 512, 1024
_TOP = 9.223372036854775e18


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signature(text: Column) -> Column:
    """array<bigint>: bin << 32 | tuple hash, a bin each; a null or empty text has none, one under K bytes a single k-mer."""
    return _let(F.coalesce(text, F.lit("")).cast("binary"), _of_bytes)


def _of_bytes(b: Column) -> Column:
    n = F.greatest(F.octet_length(b) - (K - 1), F.least(F.octet_length(b), F.lit(1)))
    hashed = lambda i: F.xxhash64(F.substring(b, i, F.lit(K)))
    places = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    limit = ((2.0 * F.least(F.lit(1.0), KEPT / F.greatest(n, F.lit(1))) - 1.0) * _TOP).cast("bigint")
    few = lambda n: _let(limit, lambda most: F.filter(places(n), lambda i: hashed(i) <= most))
    by_hash = lambda at: F.sort_array(F.transform(at, lambda i: F.struct(hashed(i).alias("h"), i.alias("at"))))
    whole = lambda n: _let(by_hash(places(n)), lambda rows: _let(_let(F.slice(rows, 1, MOST), _selected), lambda s: F.when(_full(s) | (F.size(rows) <= MOST), s).otherwise(_selected(rows))))
    least = lambda n: _let(few(n), lambda some: _let(_let(F.slice(by_hash(some), 1, MOST), _selected), lambda s: F.when(_full(s) | (F.size(some) == n) & (n <= MOST), s).otherwise(whole(n))))
    return _let(_let(n, least), _tuples)


def _full(selected: Column) -> Column:
    """Whether every bin has its PER_BIN k-mers."""
    return F.size(selected) == BINS * PER_BIN


def _selected(rows: Column) -> Column:
    """The PER_BIN least of each bin, bins in order, of rows (h, at) in order."""

    def numbered(hashes: Column) -> Column:
        def row(r: Column, t: Column) -> Column:
            first = (t == 0) | (F.get(hashes, t - 1) != r["h"])
            occurrence = F.when(first, 0).otherwise(t - F.array_position(hashes, r["h"]).cast("int") + 1)
            return _let(F.xxhash64(r["h"], occurrence), lambda g: F.struct(F.pmod(g, F.lit(BINS)).alias("bin"), r["h"].alias("h"), r["at"].alias("at"), g.alias("g")))

        return F.sort_array(F.transform(rows, row))

    return _let(_let(rows["h"], numbered), _least)


def _least(rows: Column) -> Column:
    return F.filter(rows, lambda r, t: (t < PER_BIN) | (F.get(rows, t - PER_BIN)["bin"] != r["bin"]))


def _tuples(rows: Column) -> Column:
    """One number for each bin; rows of a bin stand together."""
    starts = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda t: (t == 0) | (F.get(rows, t - 1)["bin"] != F.get(rows, t)["bin"]))

    def number(t: Column) -> Column:
        a, b = F.get(rows, t), F.get(rows, t + 1)
        alone = b.isNull() | (b["bin"] != a["bin"])
        both = F.when(a["at"] < b["at"], F.xxhash64(a["g"], b["g"])).otherwise(F.xxhash64(b["g"], a["g"]))
        return F.shiftleft(a["bin"], 32).bitwiseOR(F.when(alone, F.xxhash64(a["g"])).otherwise(both).bitwiseAND(F.lit(0xFFFFFFFF)))

    return F.when(F.size(rows) > 0, F.transform(starts, number)).otherwise(F.array().cast("array<bigint>"))


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins that either text fills; 1 for two texts without k-mers."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def neighbours(ids: DataFrame) -> DataFrame:
    """doc_id, next_id, previous_id and previous_n of distinct ids in ascending order; after the last comes the first.

    Ids are dealt to ranges once (written, so that the ranges stay); rows meet their neighbours within a range, and the ends
    of ranges, one row a range, meet each other.
    """
    slim = ids.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    slim = cut(slim.repartitionByRange(partitions(ids.sparkSession), "doc_id").withColumn("span", F.spark_partition_id()))
    ends = slim.groupBy("span").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max_by("n_chars", "doc_id").alias("high_n"))
    ring, whole = Window.orderBy("span"), Window.orderBy("span").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = lambda near, c, end: F.coalesce(near(c).over(ring), end(c).over(whole))
    ends = ends.select("span", around(F.lead, "low", F.first).alias("up"), around(F.lag, "high", F.last).alias("down"), around(F.lag, "high_n", F.last).alias("down_n"))
    inner = Window.partitionBy("span").orderBy("doc_id")
    near = slim.select("doc_id", "span", F.lead("doc_id").over(inner).alias("lead"), F.lag("doc_id").over(inner).alias("lag"), F.lag("n_chars").over(inner).alias("lag_n"))
    return near.join(F.broadcast(ends), "span").select(
        "doc_id", F.coalesce("lead", "up").alias("next_id"), F.coalesce("lag", "down").alias("previous_id"), F.coalesce("lag_n", "down_n").alias("previous_n")
    )


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document's.  A null text is an empty one.  Of rows that share an id each is a row of its own; their neighbours see
    the least of their texts.  A row with a null id has no next document: its half is replaced by nothing, near_next is null.
    Other columns are not looked at.  An empty table gives an empty table.
    Texts are shuffled once, by id, and the halves that replace others once more.
    """
    # a column that is renamed or cast below the shuffle keeps Spark from using the shuffle twice
    key = F.col(doc_id) if (doc_id, df.schema[doc_id].dataType.simpleString()) == ("doc_id", "bigint") else F.col(doc_id).cast("bigint").alias("doc_id")
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    near = neighbours(rows.select("doc_id", F.length("text").alias("n_chars")).filter(F.col("doc_id").isNotNull()))
    known = rows.filter(F.col("doc_id").isNotNull())
    # worked out once, and written: two branches of the plan below need them
    signed = cut(known.select("doc_id", F.xxhash64("text").alias("of"), signature(F.col("text")).alias("sig")))
    signed = signed.groupBy("doc_id").agg(F.collect_set(F.struct("of", "sig")).alias("sigs"))
    own = F.get(F.filter("sigs", lambda x: x["of"] == F.xxhash64("text")), 0)["sig"]
    placed = known.join(near.hint("merge"), "doc_id").join(signed.hint("merge"), "doc_id").withColumn("sig", own).drop("sigs")
    least = placed.groupBy("doc_id").agg(F.min(F.struct("text", "sig")).alias("least"), F.first("previous_id").alias("previous_id"), F.first("previous_n").alias("previous_n"))
    gifts = least.select(
        F.col("previous_id").alias("doc_id"), F.col("least.text").substr(F.lit(1), F.floor(F.col("previous_n") / 2).cast("int")).alias("gift"), F.col("least.sig").alias("next_sig")
    )
    joined = placed.select("doc_id", "text", "sig").join(gifts.hint("merge"), "doc_id")
    lone = rows.filter(F.col("doc_id").isNull()).select("doc_id", "text", signature(F.col("text")).alias("sig"), F.lit("").alias("gift"), F.lit(None).cast("array<bigint>").alias("next_sig"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("gift").substr(F.lit(1), half))
    both = joined.unionByName(lone).select("doc_id", n.cast("bigint").alias("n_chars"), "sig", "next_sig", edited.alias("edited"))
    both = both.select("doc_id", "n_chars", "sig", "next_sig", F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("edited")).alias("edited_sig"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
