"""Registered queries of the presence operators, by name, and the SQL that an oracle runs for them."""

from . import assembly, audits, clustering, intervals, records, recovery, registry, streams, summaries, tracking, vectors

MODULES = (intervals, assembly, vectors, audits, clustering, recovery, summaries, records, registry, tracking, streams)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
