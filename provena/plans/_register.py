from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir), with DuckDB's SQL for the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: embeddings in long form, for SQL
LONG = "(select vec_id r, unnest(range(0, 64))::bigint c, unnest(embedding)::double x from embeddings)"
