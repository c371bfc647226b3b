"""The query catalogue: each query applies operators to domain relations, with SQL for the same rows where SQL has it."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def catalogue() -> tuple[dict, dict[str, str]]:
    from . import graphs, history, lookups, relational, search, source_metrics, stores, streams, upkeep  # noqa: F401

    return dict(QUERIES), dict(SQL)
