"""Train/test splits and time folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _with_max_date(df: DataFrame) -> DataFrame:
    return df.withColumn("_max_date", df.agg(F.max("date")).scalar())


def split_by_date(df: DataFrame, *, test_days: int = 14) -> DataFrame:
    """One global cut at max(date) - test_days; adds ``split`` = train / test."""
    out = _with_max_date(df)
    return out.withColumn("split", F.when(F.col("date") > F.date_sub("_max_date", test_days), F.lit("test"))
                          .otherwise(F.lit("train"))).drop("_max_date")


def run_test_days(n_days: int, default: int = 28, short_below: int = 40) -> int:
    """The run-level holdout length (short histories use max(1, min(14, days // 4)))."""
    return default if n_days >= short_below else max(1, min(14, n_days // 4))


def train_test(df: DataFrame, *, test_days: int = 28):
    """(train, test) frames; an empty train falls back to all rows (decided on a count)."""
    s = split_by_date(df, test_days=test_days)
    train = s.where(F.col("split") == "train").drop("split")
    test = s.where(F.col("split") == "test").drop("split")
    return train, test


def date_tiles(df: DataFrame, *, n_tiles: int = 4) -> DataFrame:
    """M4: ntile over the *distinct dates* (a calendar-sized frame).

    Fold k trains on tiles <= k and tests on tile k+1.
    """
    dates = df.select("date").distinct()
    return dates.select("date", F.ntile(n_tiles).over(Window.orderBy("date")).cast("int").alias("tile"))


def fold_frames(df: DataFrame, tiles: DataFrame, k: int):
    """Train rows (tile <= k) and test rows (tile == k+1) of expanding fold k."""
    j = df.join(F.broadcast(tiles), "date")
    return j.where(F.col("tile") <= k).drop("tile"), j.where(F.col("tile") == k + 1).drop("tile")
