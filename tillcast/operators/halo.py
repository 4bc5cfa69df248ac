"""Row windows over blocks with halo rows: a long series is not one task's.

A window by item runs in as many tasks as there are items.  Here rows are range
partitioned by (item, date), so a long series is cut into blocks by its number of
rows, and every block gets the rows of its item that come right before it, as many
as the widest frame looks back.  Frames that look back no further are then windows by
(item, block), equal to those by item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.session import scratch_path

BLOCK, OWN = "_block", "_own"


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_halo(rows: DataFrame, keys: list[str], order: str, back: int, blocks: int | None = None) -> DataFrame:
    """Rows with their block, and the ``back`` rows before each block of a series with ``_own`` false.

    Blocks are written before they are read twice, as sampling may cut them anew.
    """
    parts = (blocks,) if blocks else ()
    cut = _stored(rows.repartitionByRange(*parts, *keys, order).withColumn(BLOCK, F.spark_partition_id()), "halo-blocks")
    # one row per series and block
    counts = cut.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    line = Window.partitionBy(*keys).orderBy(BLOCK)
    counts = _stored(counts.withColumn("_to", F.sum("_n").over(line)).withColumn("_from", F.col("_to") - F.col("_n")), "halo-counts")
    inside = Window.partitionBy(*keys, BLOCK).orderBy(F.col(order).desc())
    tails = (cut.withColumn("_p", F.row_number().over(inside)).where(F.col("_p") <= back)
                .join(counts.select(*keys, BLOCK, "_to"), [*keys, BLOCK])
                .withColumn("_at", F.col("_to") - F.col("_p")).drop("_p", "_to").withColumnRenamed(BLOCK, "_home"))
    # a row stands before every later block of its series that starts at most ``back`` rows after it
    later = counts.select(*keys, F.col(BLOCK), F.col("_from"))
    halo = (tails.join(later, keys).where((F.col(BLOCK) > F.col("_home")) & (F.col("_from") - F.col("_at") <= back))
                 .select(*rows.columns, BLOCK, F.lit(False).alias(OWN)))
    return cut.withColumn(OWN, F.lit(True)).unionByName(halo)


def over_blocks(rows: DataFrame, keys: list[str], order: str, back: int, build: Callable[[Window], dict[str, Column]],
                blocks: int | None = None) -> DataFrame:
    """Adds the columns of ``build(window)``, whose frames look back ``back`` rows at most and never forward."""
    w = Window.partitionBy(*keys, BLOCK).orderBy(order)
    return (with_halo(rows, keys, order, back, blocks).withColumns(build(w)).where(F.col(OWN)).drop(BLOCK, OWN))
