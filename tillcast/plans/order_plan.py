"""Order plan (I8 and the M9 short-history branch of M11).

daily demand (enriched) -> per-item last row (W14) + quantiles -> I3 -> I4/I5
-> FEFO expected waste over the 7-day path (I6) -> one row per item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.operators import fefo, forecast, inventory

META_COLS = ["current_inventory", "lead_time_days", "review_period_days", "moq", "unit_margin",
             "unit_holding_cost", "unit_cost"]


def with_global_as_of(df: DataFrame, name: str = "as_of") -> DataFrame:
    """Attach max(date) of the whole frame (a scalar subquery: evaluated once, no join)."""
    return df.withColumn(name, df.agg(F.max("date")).scalar())


def plan_from_quantiles(quant: DataFrame, raw: DataFrame, *, lots: DataFrame | None = None,
                        unit_costs: DataFrame | None = None, horizons=(7, 30),
                        paths: DataFrame | None = None) -> DataFrame:
    """Turn per-item daily quantiles into the order plan.

    ``quant``: item_id, q50_daily, q95_daily (and optionally a ``date``).
    ``paths``: optional item_id + forecast_q50_{h}d / forecast_q95_{h}d arrays;
    flat paths are used when absent.
    """
    meta = forecast.last_row_per_item(raw, [c for c in META_COLS if c in raw.columns])
    as_of = raw.agg(F.max("date")).scalar()
    df = quant.join(meta, "item_id", "inner").withColumn("as_of", as_of)
    if "date" not in quant.columns:
        df = df.withColumn("date", F.date_add("as_of", 1))
    df = inventory.optimal_order(df)
    df = df.withColumn("priority", inventory.order_priority("current_inventory", "target_stock"))
    uc = F.nullif(F.col("unit_cost").cast("double"), F.lit(0.0))
    if unit_costs is not None:
        df = df.join(unit_costs.select("item_id", F.col("unit_cost").alias("_map_cost")), "item_id", "left")
        uc = F.coalesce(uc, F.col("_map_cost"))
    df = df.withColumn("unit_cost", F.coalesce(uc, F.lit(0.0))).drop("_map_cost")
    df = df.withColumn("expected_total_cost", inventory.expected_cost("recommended_order_qty", "unit_cost"))
    if paths is not None:
        df = df.join(paths, "item_id", "left")
    for h in horizons:
        if f"forecast_q50_{h}d" not in df.columns:
            df = df.withColumn(f"forecast_q50_{h}d", forecast.flat_path("q50_daily", h))
            df = df.withColumn(f"forecast_q95_{h}d", forecast.flat_path("q95_daily", h))
    if lots is not None and 7 in horizons:
        df = fefo.fefo_expected_waste(df, lots, path_col="forecast_q50_7d", horizon=7)
        df = (df.withColumn("expected_waste_qty_7d", F.coalesce("expected_waste_qty", F.lit(0)).cast("int"))
                .withColumn("expected_lost_sales_qty_7d", F.coalesce("expected_lost_sales_qty", F.lit(0)).cast("int"))
                .drop("expected_waste_qty", "expected_lost_sales_qty", "expected_sales_fulfilled_qty"))
    else:
        df = df.withColumn("expected_waste_qty_7d", F.lit(0)).withColumn("expected_lost_sales_qty_7d", F.lit(0))
    cols = ["date", "item_id", F.col("current_inventory").cast("int").alias("current_inventory"),
            F.round("q50_daily", 2).alias("q50_daily"), F.round("q95_daily", 2).alias("q95_daily"),
            "protection_days", F.round("service_level", 4).alias("service_level"), "target_stock",
            "recommended_order_qty", "priority", "unit_cost", "expected_total_cost"]
    cols += [f"forecast_{q}_{h}d" for h in horizons for q in ("q50", "q95")]
    cols += ["expected_waste_qty_7d", "expected_lost_sales_qty_7d"]
    return df.select(*cols)


def naive_order_plan(raw: DataFrame, **kw) -> DataFrame:
    """M9 branch: naive quantiles from the last 7 rows per item, then the plan."""
    q = forecast.naive_quantiles(raw).select("item_id", "q50_daily", "q95_daily")
    return plan_from_quantiles(q, raw, **kw)
