"""All queries of the comparison and reconciliation operators, each with SQL where SQL can express it."""

from __future__ import annotations

from . import compare_queries, reconcile_queries, scalar_queries, source_queries

MODULES = (scalar_queries, compare_queries, reconcile_queries, source_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: text for m in MODULES for name, (_, text) in m.QUERIES.items() if text}
