"""Registered queries and the DuckDB SQL that checks them."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL of the same rows if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register
