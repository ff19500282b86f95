"""Registered queries over the test tables, with independent SQL for each."""

from __future__ import annotations

from . import alerts, correlations, matching, metrics, predicates, shaping, storage, streams

MODULES = (predicates, matching, correlations, alerts, metrics, storage, shaping, streams)


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
