"""Daily demand, shop totals, enrichment and data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast import fixed


def daily_demand(sales: DataFrame, *, date_col="date", item_col="item_id", qty_col="qty",
                 amount_col="amount", return_col: str | None = None,
                 extra_aggs: dict | None = None) -> DataFrame:
    """A1: sum quantity and amount per (date, item).

    Rows with a NULL date, item or quantity are dropped first.  The amount sum
    is 0 (not NULL) when every amount is missing.  Spark aggregates partially
    on the map side, so a hot item is combined before the shuffle.
    """
    df = sales
    if return_col:
        df = df.where(~F.coalesce(F.col(return_col), F.lit(False)))
    df = df.where(F.col(date_col).isNotNull() & F.col(item_col).isNotNull() & F.col(qty_col).isNotNull())
    aggs = [F.sum(qty_col).cast("double").alias("demand_qty"),
            F.coalesce(F.sum(amount_col), F.lit(0.0)).cast("double").alias("sales_amount")]
    for name, expr in (extra_aggs or {}).items():
        aggs.append(expr.alias(name))
    return (df.groupBy(F.col(date_col).alias("date"), F.col(item_col).alias("item_id"))
              .agg(*aggs))


def shop_daily_total(daily: DataFrame, *, shop_cols: tuple = ()) -> DataFrame:
    """A2: total demand of the shop per day (one row per (shop, date))."""
    return daily.groupBy(*shop_cols, "date").agg(F.sum("demand_qty").alias("shop_total"))


def simulated_stock(qty_col="demand_qty", item_col="item_id", date_col="date"):
    """3-row trailing mean (current row included) x 0.8, clipped at 0, half-even to int.

    Items with fewer than 3 rows so far use their own quantity.
    """
    w = Window.partitionBy(item_col).orderBy(date_col).rowsBetween(-2, 0)
    mean3 = F.when(F.count(qty_col).over(w) == 3, F.avg(qty_col).over(w))
    base = F.coalesce(mean3, F.col(qty_col)) * fixed.SIMULATED_STOCK_FACTOR
    return F.bround(F.greatest(base, F.lit(0.0)), 0).cast("int")


def enrich_daily(daily: DataFrame, *, holiday_weekends: bool = True, **defaults) -> DataFrame:
    """Give a bare daily-demand frame the model's exogenous and operating columns.

    Existing columns win (``coalesce``); absent ones get the defaults.  The
    stock level is the W9 simulation unless ``current_inventory`` exists.
    """
    d = {
        "temp_c": 0.0, "rain_mm": 0.0, "promo": 0, "event_score_100": 0.0,
        "lead_time_days": fixed.DEFAULT_LEAD_TIME_DAYS,
        "review_period_days": fixed.DEFAULT_REVIEW_PERIOD_DAYS,
        "moq": fixed.DEFAULT_MOQ,
        "unit_margin": fixed.DEFAULT_UNIT_MARGIN,
        "unit_holding_cost": fixed.DEFAULT_UNIT_HOLDING_COST,
        "unit_cost": fixed.DEFAULT_UNIT_COST,
    }
    d.update(defaults)
    cols = set(daily.columns)
    out = {}
    for name, val in d.items():
        lit = F.lit(val)
        out[name] = F.coalesce(F.col(name), lit) if name in cols else lit
    weekend = (F.weekday("date") >= 5).cast("int")
    out["is_holiday"] = (F.coalesce(F.col("is_holiday").cast("int"), weekend) if "is_holiday" in cols
                         else (weekend if holiday_weekends else F.lit(0)))
    out["current_inventory"] = (F.coalesce(F.col("current_inventory").cast("int"), simulated_stock())
                                if "current_inventory" in cols else simulated_stock())
    typed = {"temp_c": "double", "rain_mm": "double", "promo": "int", "event_score_100": "double",
             "lead_time_days": "int", "review_period_days": "int", "moq": "int",
             "unit_margin": "double", "unit_holding_cost": "double", "unit_cost": "double",
             "is_holiday": "int", "current_inventory": "int"}
    return daily.withColumns({k: v.cast(typed[k]) for k, v in out.items()})


def quality_report(feature_df: DataFrame, *, feature_cols=fixed.FEATURE_COLUMNS,
                   timesteps: int = 14) -> DataFrame:
    """Q1: one-row validation report (ok, rows, items, duplicates, min_item_days, issues).

    One job: a per-item aggregate (partial on the map side) rolled up to
    one row; nothing is collected.
    """
    missing = sorted(c for c in feature_cols if c not in feature_df.columns)
    # two-level aggregate: per item first (bounded by #items), then one row
    per_item = feature_df.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("date").alias("d"),
        F.count_if(F.col("demand_qty").isNull()).alias("null_target"),
    )
    overall = per_item.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
        F.count("item_id").alias("items"),
        F.coalesce(F.sum(F.col("n") - F.col("d")), F.lit(0)).cast("long").alias("duplicates"),
        F.coalesce(F.min(F.when(F.col("item_id").isNotNull(), F.col("d"))), F.lit(0)).cast("long")
         .alias("min_item_days"),
        F.coalesce(F.sum("null_target"), F.lit(0)).alias("null_target"),
    )
    need = max(timesteps + 1, 21)
    issues = F.array_compact(F.array(
        F.when(F.col("rows") == 0, F.lit("feature_df is empty")),
        F.lit(f"missing feature columns: {missing}") if missing else F.lit(None).cast("string"),
        F.when((F.col("rows") > 0) & (F.col("min_item_days") < need),
               F.concat(F.lit("insufficient history per item: min_item_days="),
                        F.col("min_item_days").cast("string"))),
        F.when(F.col("null_target") > 0, F.lit("NaN in demand_qty")),
    ))
    return overall.select((F.size(issues) == 0).alias("ok"), "rows", "items", "duplicates",
                          "min_item_days", issues.alias("issues"))


def observe_quality(df: DataFrame, name: str = "daily_quality"):
    """Q1 inline: attach row / null-target / date-range metrics that Spark collects while the
    frame is written or otherwise consumed (no extra pass).  Returns (frame, Observation)."""
    from pyspark.sql import Observation
    obs = Observation(name)
    out = df.observe(obs, F.count(F.lit(1)).alias("rows"),
                     F.count_if(F.col("demand_qty").isNull()).alias("null_target"),
                     F.min("date").alias("min_date"), F.max("date").alias("max_date"))
    return out, obs
