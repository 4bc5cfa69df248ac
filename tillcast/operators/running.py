"""Skew-safe running sums.

A plain ``sum().over(partitionBy(key).orderBy(...))`` puts every row of a key
in one task; if one key holds a third of the rows, so does one task.  Here
rows are range-partitioned by (key, order), so a hot key is cut into *blocks*
by its number of rows, whatever its ids or dates are.  The sum is taken inside
each block in parallel, and block offsets come from a per-key window over block
totals, at most one row per key and partition.  Result = block offset +
in-block running sum: exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.session import cut_lineage


def order_blocks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_blk``: contiguous runs of the total order (keys, order) of about equal row counts.

    Written once: block sums and block offsets must see the same cuts.
    """
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_blk", F.spark_partition_id()))


def exclusive_prefix_sum(df: DataFrame, *, keys: list[str], order: list[str], value: str, out: str = "prefix") -> DataFrame:
    """Sum of ``value`` over rows strictly before each row within ``keys``; ``order`` must be total."""
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rows = order_blocks(df, keys, order)
    inside = rows.withColumn("_in", F.coalesce(F.sum(value).over(before("_blk", *keys).orderBy(*order)), F.lit(0)))
    totals = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_blk").alias("_b")).agg(F.sum(value).alias("_bt"))
    per_key = before(*[f"_k{i}" for i in range(len(keys))]).orderBy("_b")
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_bt").over(per_key), F.lit(0))).drop("_bt")
    same = F.col("_blk") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return inside.join(offsets, same).select(*df.columns, (F.col("_off") + F.col("_in")).alias(out))


def global_row_number(df: DataFrame, order_cols: list, out: str) -> DataFrame:
    """1-based row number in a total order without a single-partition window.

    Rows are range-partitioned by the order, numbered inside each partition,
    and shifted by the row counts of the earlier partitions (a tiny table).
    """
    # written once: both branches below must see the same partitions
    parts = cut_lineage(df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols).withColumn("_pid", F.spark_partition_id()))
    local = parts.withColumn("_ln", F.row_number().over(Window.partitionBy("_pid").orderBy(*order_cols)))
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))      # one row per partition
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(F.broadcast(offs), "_pid").withColumn(out, (F.col("_off") + F.col("_ln")).cast("long")) \
                .drop("_pid", "_ln", "_off")
