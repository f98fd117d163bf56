"""Whole jobs, and the registered queries with their SQL."""

from __future__ import annotations


def _load() -> None:
    from . import queries_frames, queries_sequences, queries_sources, queries_tables  # noqa: F401


def all_queries() -> dict:
    from .registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    from .registry import SQL

    _load()
    return dict(SQL)
