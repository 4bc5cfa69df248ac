"""Shared inputs for the registered queries (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast import tables
from tillcast.operators import demand

AS_OF = tables.AS_OF_SALES
AS_OF_EVENTS = tables.AS_OF_EVENTS


def daily(spark, d):
    """Daily demand per p_type with a promo flag (max discount >= 0.08)."""
    s = tables.product_day_sales(spark, d)
    return demand.daily_demand(s, extra_aggs={"promo": (F.max("max_discount") >= 0.08).cast("int")})


def raw(spark, d):
    """Daily demand enriched with the model's exogenous and operating columns (P1 + W9)."""
    return demand.enrich_daily(daily(spark, d))


def unit_costs(spark, d):
    p = tables.product(spark, d)
    return p.groupBy(F.col("category").alias("item_id")).agg(F.round(F.avg("selling_price"), 2).alias("unit_cost"))


def raw_materialized(spark, d):
    """The enriched daily grid, written once to the checkpoint folder.

    It is read by several consumers of one job (quantiles, last rows, the
    as-of date, lots); materializing it is cheaper than re-deriving it from
    the sales lines each time, and it is small (items x days).
    """
    return raw(spark, d).checkpoint(eager=True)


def lots_on_hand(spark, d, daily_frame=None):
    """Batches on hand at the plan date (max sales date): received <= as_of <= expiry."""
    b = tables.inventory_batches(spark, d)
    p = tables.product(spark, d).select("product_id", F.col("category").alias("item_id"))
    # the plan date as a scalar subquery (evaluated once, no join)
    as_of = (daily_frame if daily_frame is not None else daily(spark, d)).agg(F.max("date")).scalar()
    j = (b.withColumn("as_of", as_of)
          .where((F.col("received_date") <= F.col("as_of")) & (F.col("expiration_date") >= F.col("as_of"))))
    return j.join(p, "product_id", "inner").select(
        "item_id", F.col("current_qty").alias("qty"),
        F.datediff("expiration_date", "as_of").alias("days_to_expire"))


# ----------------------------------------------------------------- SQL side
SQL_DAILY = """
daily AS (
  SELECT CAST(l_shipdate AS DATE) AS date, p_type AS item_id,
         CAST(SUM(l_quantity) AS DOUBLE) AS demand_qty,
         CAST(COALESCE(SUM(l_extendedprice * (1 - l_discount)), 0) AS DOUBLE) AS sales_amount,
         CAST(CASE WHEN MAX(l_discount) >= 0.08 THEN 1 ELSE 0 END AS INTEGER) AS promo
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_returnflag <> 'R'
  GROUP BY 1, 2)"""

SQL_RAW = SQL_DAILY + """,
raw AS (
  SELECT *, 0.0::DOUBLE AS temp_c, 0.0::DOUBLE AS rain_mm, 0.0::DOUBLE AS event_score_100,
         2 AS lead_time_days, 2 AS review_period_days, 5 AS moq, 1500.0 AS unit_margin,
         180.0 AS unit_holding_cost, 0.0 AS unit_cost,
         CAST(CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_holiday,
         CAST(round_even(greatest(COALESCE(
             CASE WHEN count(demand_qty) OVER (PARTITION BY item_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
                  THEN avg(demand_qty) OVER (PARTITION BY item_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END,
             demand_qty) * 0.8, 0.0), 0) AS INTEGER) AS current_inventory
  FROM daily)"""


def sql_roll(col: str, lo: int, hi: int, fn: str, need: int) -> str:
    frame = f"OVER (PARTITION BY item_id ORDER BY date ROWS BETWEEN {lo} PRECEDING AND {hi} PRECEDING)"
    return f"CASE WHEN count({col}) {frame} >= {need} THEN {fn}({col}) {frame} END"


def sql_lag(col: str, k: int) -> str:
    return f"lag({col}, {k}) OVER (PARTITION BY item_id ORDER BY date)"
