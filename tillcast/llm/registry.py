"""Queries of this subpackage: name -> builder, and the DuckDB SQL where one exists."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from tillcast.llm.common import ship_package
from tillcast.session import checkpoint_dir

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

MODULES = ["source_mix", "grace_dedup", "token_counts", "decision_list", "site_quality", "shingle_join", "chat_windows", "link_trust", "token_shards", "piece_codec",
           "mean_ordered_kmeans", "phrase_mining", "suffix_dedup"]


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            ship_package(spark)
            checkpoint_dir(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> tuple[dict[str, Callable], dict[str, str]]:
    for m in MODULES:
        importlib.import_module(f"tillcast.llm.{m}")
    return QUERIES, ORACLE
