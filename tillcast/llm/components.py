"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import stored

MAX_ROUNDS = 60


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours; combined on the map side, so hubs cost one row per task."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _least_neighbour(down)
    moved = down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(m.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge other than a loop; root is the least node of its component.

    ``edges`` has columns u and v of one orderable type; direction, loops and
    repeats don't matter, and null ends are left out.  Each round contracts
    neighbourhoods to stars, and the table stays as large as the edges at most.
    """
    cur = stored(edges.where("u is not null and v is not null and u != v").select("u", "v").distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        cur = stored(_small_star(_large_star(cur)), "stars")
        now = tuple(cur.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    root = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(root)
