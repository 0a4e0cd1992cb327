"""The decorator by which modules of plans register their queries."""

from __future__ import annotations

from collections.abc import Callable


def registry(queries: dict[str, Callable], sql: dict[str, str]) -> Callable:
    """``@query(sql)`` puts a function into ``queries`` by its name and, if it has one, its SQL into ``sql``."""

    def query(text: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return register

    return query
