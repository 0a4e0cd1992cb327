"""Identifiers, times and other strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_id(c: Column) -> Column:
    """Upper case; blanks and underscores become hyphens, anything else but letters, digits and hyphens goes; no doubled or edge hyphens."""
    x = F.regexp_replace(F.regexp_replace(F.upper(c), "[ _]", "-"), "[^A-Z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(x, "-+", "-"), "^-|-$", "")


def id_errors(c: Column) -> Column:
    """Array of what is wrong with an identifier; empty if nothing is."""
    wrong = lambda name, test: F.when(test, name)
    return F.array_compact(
        F.array(wrong("too_short", F.length(c) < 3), wrong("too_long", F.length(c) > 100), wrong("characters", ~c.rlike("^[A-Z0-9-]*$")), wrong("double_hyphen", c.contains("--")), wrong("edge_hyphen", c.startswith("-") | c.endswith("-")))
    )


def slug(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case with underscores; a slug that has an alias becomes that."""
    plain = _slug(c)
    if not aliases:
        return plain
    return F.coalesce(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[plain], plain)


def display_name(c: Column) -> Column:
    """Words of a slug with capitals."""
    return F.initcap(F.regexp_replace(c, "[_-]+", " "))


def _slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_|_$", "")


def safe_file_name(c: Column) -> Column:
    """Path parts gone, odd characters as underscores, no leading dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"[^A-Za-z0-9._-]", "_"), r"^\.+", "")


def clock(ms: Column) -> Column:
    """HH:MM:SS.mmm"""
    part = lambda n, of: F.floor(ms / n) % of if of else F.floor(ms / n)
    return F.format_string("%02d:%02d:%02d.%03d", part(3_600_000, None), part(60_000, 60), part(1000, 60), ms % 1000)


def parse_minutes(c: Column) -> Column:
    """Milliseconds of M:SS:mmm"""
    p = F.split(c, ":")
    return (p[0].cast("bigint") * 60 + p[1].cast("bigint")) * 1000 + p[2].cast("bigint")


def seconds_range(start_ms: Column, end_ms: Column) -> Column:
    """54.2s - 56.8s"""
    tenths = lambda ms: F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), (F.floor(ms / 100) % 10).cast("string"), F.lit("s"))
    return F.concat(tenths(start_ms), F.lit(" - "), tenths(end_ms))


def duration(seconds: Column) -> Column:
    """2m 30s, 45s, 1h 2m"""
    m, s, h = F.floor(seconds / 60) % 60, seconds % 60, F.floor(seconds / 3600)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def cluster_list(ids: Column, shown: int = 2) -> Column:
    """Clusters 1, 2 +5 more"""
    text = F.array_join(F.transform(F.slice(ids, 1, shown), lambda x: x.cast("string")), ", ")
    head = F.when(F.size(ids) == 1, F.lit("Cluster ")).otherwise(F.lit("Clusters "))
    return F.concat(head, text, F.when(F.size(ids) > shown, F.format_string(" +%d more", F.size(ids) - shown)).otherwise(""))
