"""Registered queries by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import basket_queries, composed_queries, corpus_queries, fixed_queries, made_queries, more_queries, photo_queries, receipt_queries, replay_queries

_ALL = receipt_queries.QUERIES | corpus_queries.QUERIES | made_queries.QUERIES | more_queries.QUERIES | fixed_queries.QUERIES | basket_queries.QUERIES | composed_queries.QUERIES | photo_queries.QUERIES | replay_queries.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
