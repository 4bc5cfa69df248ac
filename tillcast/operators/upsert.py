"""Keyed upserts, deletes, resets and overlays.

Without a table format that has MERGE, an upsert is a left-anti join of the
target against the update keys plus a union of the updates: two shuffles on
the key at most, no driver work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep one row per key: the first by ``order`` (e.g. newest first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows of ``updates`` replace target rows with the same key; others are added.

    Of updates that repeat a key, the first by ``order`` (the latest) wins.
    """
    updates = dedupe_latest(updates, keys, order)
    kept = target.join(updates.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(updates.select(*target.columns))


def delete_keys(target: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """U6 delete: drop target rows whose key is in ``doomed``."""
    return target.join(doomed.select(*keys).distinct(), keys, "left_anti")


def patch(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """U6 patch: overwrite only the columns present in ``changes`` for matching keys."""
    cols = [c for c in changes.columns if c not in keys]
    ch = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = target.join(ch, keys, "left")
    return j.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in target.columns])


def reset(target: DataFrame) -> DataFrame:
    """An empty frame with the same schema."""
    return target.sparkSession.createDataFrame([], target.schema)


def overlay(base: DataFrame, fresh: DataFrame, as_of, *, key: str = "date", value: str = "value") -> DataFrame:
    """U8: fresh values replace stored ones on/after as_of (kept values elsewhere)."""
    f = fresh.select(key, F.col(value).alias("_fresh"))
    j = base.join(f, key, "full_outer")
    a = F.lit(str(as_of)).cast("date") if not hasattr(as_of, "_jc") else as_of
    v = F.when(F.col(key) >= a, F.coalesce(F.col("_fresh"), F.col(value))).otherwise(F.col(value))
    return j.select(key, v.alias(value)).where(F.col(value).isNotNull())
