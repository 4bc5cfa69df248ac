"""Registered queries: name -> (spark builder, oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole provided tables.  The SQL next to it is the DuckDB statement that
must give the same rows (column names aliased identically).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(name: str, sql: str | None = None, ops: str = ""):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        OPERATORS[name] = ops
        return fn
    return deco


def load_all():
    # importing the modules registers their queries
    from tillcast.plans import q_core, q_reports, q_stock, q_external, q_model, q_state, q_views, q_io, q_rules, q_keyed, q_spatial  # noqa: F401
    return QUERIES, ORACLE
