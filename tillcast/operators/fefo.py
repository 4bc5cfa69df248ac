"""First-expired-first-out stock operators.

* ``fefo_expected_waste`` simulates a demand path against an item's lots.
  Lots are first summed into horizon buckets (expires on day 0, 1, ..,
  h-1, or not within the horizon), so the per-item state is an array of
  h+1 numbers however many lots exist; the simulation is an ``aggregate``
  fold over days on that array.  Exact: within a bucket the FEFO order
  does not change any total.
* ``fefo_deduction`` takes a waste quantity off a product's batches in
  expiry order with a skew-safe running sum (no loop, no per-key task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast import fixed
from tillcast.functions.dates import as_of_date
from tillcast.operators.running import exclusive_prefix_sum


def lot_buckets(lots: DataFrame, horizon: int, *, item_col="item_id", qty="qty",
                days="days_to_expire") -> DataFrame:
    """Per item: array of h+1 bucket quantities (bucket k expires at the start of day k; h never)."""
    b = F.least(F.greatest(F.col(days).cast("int"), F.lit(0)), F.lit(horizon))
    per = (lots.where(F.col(qty) > 0)
           .groupBy(item_col, b.alias("_b")).agg(F.sum(F.col(qty).cast("long")).alias("_q")))
    # at most h+1 entries per item: bounded by the horizon, not by the data
    per = per.groupBy(item_col).agg(F.map_from_entries(F.collect_list(F.struct("_b", "_q"))).alias("_m"))
    arr = F.transform(F.sequence(F.lit(0), F.lit(horizon)),
                      lambda k: F.coalesce(F.element_at(F.col("_m"), k), F.lit(0).cast("long")))
    return per.select(item_col, arr.alias("lot_buckets"))


def fefo_fold(buckets: Column, demand_path: Column) -> Column:
    """I6 fold: struct(waste, fulfilled, lost) for one item.

    ``buckets``: array<long> of length h+1; ``demand_path``: array<double>
    of length h (each day rounded half-even and floored at 0).
    """
    h = F.size(demand_path)
    cum = F.transform(buckets, lambda _, i: F.aggregate(F.slice(buckets, 1, i + 1), F.lit(0).cast("long"),
                                                           lambda a, x: a + x))
    total = F.element_at(cum, -1)
    init = F.struct(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("waste"),
                    F.lit(0).cast("long").alias("fulfilled"), F.lit(0).cast("long").alias("lost"))

    def step(acc, j):
        expired_upto = cum[j]                       # every lot with expiry <= day j is gone
        p1 = F.greatest(acc["p"], expired_upto)
        d = F.greatest(F.bround(demand_path[j], 0), F.lit(0.0)).cast("long")
        take = F.least(d, total - p1)
        return F.struct((p1 + take).alias("p"), (acc["waste"] + p1 - acc["p"]).alias("waste"),
                        (acc["fulfilled"] + take).alias("fulfilled"), (acc["lost"] + d - take).alias("lost"))

    days = F.sequence(F.lit(0), h - 1)
    res = F.aggregate(F.when(h > 0, days).otherwise(F.array().cast("array<int>")), init, step)
    return F.struct(res["waste"].alias("expected_waste_qty"),
                    res["fulfilled"].alias("expected_sales_fulfilled_qty"),
                    res["lost"].alias("expected_lost_sales_qty"))


def fefo_expected_waste(paths: DataFrame, lots: DataFrame, *, path_col: str, horizon: int,
                        item_col="item_id") -> DataFrame:
    """I6 per item: ``paths`` (item, path array) left-joined to bucketed lots."""
    b = lot_buckets(lots, horizon, item_col=item_col)
    j = paths.join(b, item_col, "left")
    empty = F.array_repeat(F.lit(0).cast("long"), horizon + 1)
    res = fefo_fold(F.coalesce(F.col("lot_buckets"), empty), F.slice(F.col(path_col), 1, horizon))
    return j.withColumn("_fefo", res).select("*", "_fefo.*").drop("_fefo", "lot_buckets")


def fefo_deduction(batches: DataFrame, waste: DataFrame, *, product_col="product_id",
                   qty_col="current_qty", expiry_col="expiration_date", id_col="batch_id",
                   waste_qty_col="quantity", tiebreak: list | None = None) -> DataFrame:
    """Subtract each product's total waste from its batches, earliest expiry first.

    Several waste events of one product are summed first (FEFO deductions
    compose).  Returns every batch with ``deducted`` and ``new_qty``.  The order is
    (expiry, id, *tiebreak) and must be total for a deterministic result.
    """
    w = waste.groupBy(product_col).agg(F.sum(waste_qty_col).cast("long").alias("_w"))
    live = batches.where(F.col(qty_col) > 0)
    pref = exclusive_prefix_sum(live, keys=[product_col], order=[expiry_col, id_col, *(tiebreak or [])], value=qty_col,
                                out="_prev")
    j = pref.join(w, product_col, "left")
    take = F.greatest(F.lit(0), F.least(F.col(qty_col), F.coalesce(F.col("_w"), F.lit(0)) - F.col("_prev")))
    live_out = j.withColumn("deducted", take.cast("long")).drop("_w", "_prev")
    dead = batches.where(~(F.col(qty_col) > 0) | F.col(qty_col).isNull()).withColumn("deducted", F.lit(0).cast("long"))
    return live_out.unionByName(dead).withColumn("new_qty", (F.col(qty_col) - F.col("deducted")).cast("long"))


def named_batch_waste(batches: DataFrame, waste: DataFrame, *, id_col="batch_id", qty_col="current_qty",
                      waste_batch_col="batch_id", waste_qty_col="quantity") -> DataFrame:
    """I9 named batch: subtract wastes aimed at a batch; floors at 0 and reports the excess."""
    w = waste.where(F.col(waste_batch_col).isNotNull()).groupBy(F.col(waste_batch_col).alias(id_col)) \
             .agg(F.sum(waste_qty_col).cast("long").alias("_w"))
    j = batches.join(w, id_col, "left").withColumn("_w", F.coalesce("_w", F.lit(0)))
    return (j.withColumn("new_qty", F.greatest(F.col(qty_col) - F.col("_w"), F.lit(0)).cast("long"))
             .withColumn("excess_waste", F.greatest(F.col("_w") - F.col(qty_col), F.lit(0)).cast("long"))
             .drop("_w"))


def expiring_batches(batches: DataFrame, product: DataFrame, as_of, *, days=fixed.EXPIRING_DAYS) -> DataFrame:
    """Batches expiring within [0, days] of as_of, with value at risk = price x qty."""
    left = F.datediff(F.col("expiration_date"), as_of_date(as_of))
    b = batches.withColumn("days_left", left).where(F.col("days_left").between(0, days))
    p = product.select("product_id", F.col("name").alias("product"), "selling_price")
    return (b.join(p, "product_id", "left")
             .withColumn("product", F.coalesce("product", F.lit("상품")))
             .withColumn("value_at_risk", F.coalesce(F.col("selling_price"), F.lit(0.0)) * F.coalesce(F.col("current_qty"), F.lit(0))))
