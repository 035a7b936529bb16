"""Where queries and their SQL are registered."""

from __future__ import annotations

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register
