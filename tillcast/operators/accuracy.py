"""Forecast accuracy and dashboard series.

Accuracy is always computed against *recorded* actuals; nothing is invented
for missing actuals (they stay NULL or count as 0 where the rule says so).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast import fixed
from tillcast.functions.dates import as_of_date, month_day_label
from tillcast.functions.numeric import pct_change
from tillcast.operators import reports


def _avg_tenths(c: str):
    """Mean of 1-decimal values, half up to 1 decimal, computed on exact integer tenths
    (so the result does not depend on summation order)."""
    t = F.round(F.col(c) * 10)
    return F.floor(F.sum(t) / F.count(t) + 0.5) / 10


def forecast_accuracy(forecasts: DataFrame, sales: DataFrame, *, product_col="item_id") -> DataFrame:
    """Per (date, product): latest prediction vs summed actual (0 if none).

    accuracy = clip(100 - |p - a| / p * 100, 0, 100) to 1 decimal; p <= 0 -> 100 if a == 0 else 0.
    Actuals are aggregated before the join, so the join is key-to-key.
    """
    lf = reports.latest_forecasts(forecasts).select(F.col("target_date").alias("date"), "product", "predicted_qty")
    act = sales.groupBy("date", F.col(product_col).alias("product")).agg(F.sum("qty").alias("actual"))
    j = lf.join(act, ["date", "product"], "left").withColumn("actual", F.coalesce("actual", F.lit(0.0)))
    p, a = F.col("predicted_qty"), F.col("actual")
    raw = 100 - F.abs(p - a) / p * 100
    acc = F.when(p > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(raw * 10 + 0.5) / 10))) \
           .otherwise(F.when(a == 0, F.lit(100.0)).otherwise(F.lit(0.0)))
    return j.withColumn("accuracy", acc)


def daily_accuracy_trend(acc: DataFrame, as_of, *, days: int = 7) -> DataFrame:
    """Mean accuracy per day on a 7-day spine ending at as_of (NULL when no forecast)."""
    a = as_of_date(as_of)
    per = (acc.where((F.col("date") > F.date_sub(a, days)) & (F.col("date") <= a))
           .groupBy("date").agg(_avg_tenths("accuracy").alias("accuracy")))
    spine = reports.date_spine(acc.sparkSession, as_of, -(days - 1), 0)
    return (F.broadcast(spine).join(per, "date", "left")
            .select("date", month_day_label("date").alias("label"),
                    "accuracy",
                    (F.col("date") == a).alias("is_today")))


def volume_score(sales: DataFrame, as_of, *, days: int = 30, k: int = 5) -> DataFrame:
    """For the top menus of the last 30 days with qty > 50:
    volume score = min(95, 80 + log2(qty) * 1.4) (1 decimal) and row count capped at 50.
    (A volume score, not an accuracy.)"""
    a = as_of_date(as_of)
    agg = (sales.where((F.col("date") > F.date_sub(a, days)) & (F.col("date") <= a))
           .groupBy(F.col("menu").alias("name"))
           .agg(F.sum("qty").alias("qty"),
                (F.sum("n_lines") if "n_lines" in sales.columns else F.count(F.lit(1))).cast("long").alias("runs"))
           .where(F.col("qty") > fixed.VOLUME_MIN_QTY))
    top = agg.orderBy(F.col("qty").desc(), F.col("name")).limit(k)
    score = F.least(F.lit(float(fixed.VOLUME_SCORE_CAP)),
                    fixed.VOLUME_SCORE_BASE + F.log2(F.col("qty")) * fixed.VOLUME_SCORE_SLOPE)
    return top.select("name", "qty", (F.floor(score * 10 + 0.5) / 10).alias("volume_score"),
                      F.least(F.col("runs"), F.lit(50)).alias("predictions"))


def run_accuracy(predicted, actual):
    """max(0, 100 - round(|a - p| / a * 100)); NULL without an actual; status label."""
    p, a = F.col(predicted), F.col(actual)
    acc = F.when(a > 0, F.greatest(F.lit(0.0), 100 - F.floor(F.abs(a - p) / a * 100 + 0.5)))
    status = (F.when(acc >= fixed.ACCURATE_AT, F.lit("accurate")).when(acc >= fixed.WARNING_AT, F.lit("warning"))
              .when(acc.isNotNull(), F.lit("inaccurate")))
    return acc, status


def insight_rules(acc: DataFrame, trend: DataFrame, volume: DataFrame) -> DataFrame:
    """Three insight rows from measured accuracy (mean), the oldest trend point and the top menu."""
    m = acc.agg(_avg_tenths("accuracy").alias("mean_acc"))
    first = trend.agg(F.min_by("accuracy", "date").alias("first_acc"))
    top = volume.agg(F.max_by("name", F.struct("qty", F.col("name"))).alias("top_name"),
                     F.max_by("volume_score", F.struct("qty", F.col("name"))).alias("top_score"))
    sc = lambda df, c: df.select(c).scalar()  # noqa: E731  one-row frames as scalar subqueries
    j = acc.sparkSession.range(1).select(sc(m, "mean_acc").alias("mean_acc"), sc(first, "first_acc").alias("first_acc"),
                                         sc(top, "top_name").alias("top_name"), sc(top, "top_score").alias("top_score"))
    rows = F.array(
        F.when(F.col("mean_acc") >= fixed.STABLE_AT,
               F.struct(F.lit(1).alias("n"), F.lit("success").alias("type"), F.lit("demand accuracy stable").alias("title"),
                        F.col("mean_acc").alias("value")))
         .otherwise(F.struct(F.lit(1).alias("n"), F.lit("info").alias("type"), F.lit("demand accuracy baseline").alias("title"),
                             F.col("mean_acc").alias("value"))),
        F.when(F.col("first_acc") < fixed.WEEKLY_WARNING_BELOW,
               F.struct(F.lit(2).alias("n"), F.lit("warning").alias("type"), F.lit("short-term accuracy drop").alias("title"),
                        F.col("first_acc").alias("value")))
         .otherwise(F.struct(F.lit(2).alias("n"), F.lit("success").alias("type"), F.lit("recent accuracy good").alias("title"),
                             F.col("first_acc").alias("value"))),
        F.struct(F.lit(3).alias("n"), F.lit("info").alias("type"),
                 F.coalesce(F.col("top_name"), F.lit("no item yet")).alias("title"), F.col("top_score").alias("value")),
    )
    return j.select(F.inline(rows))


def actual_vs_predicted(sales: DataFrame, forecasts: DataFrame, as_of) -> DataFrame:
    """R2: ten days (as_of-7 .. as_of+2): actual (NULL in the future), predicted from the
    store (latest per key, summed per day; past days without one stay NULL, today and
    future default to 0), rounded half up."""
    a = as_of_date(as_of)
    spine = reports.date_spine(sales.sparkSession, as_of, -7, 2)
    act = (sales.where((F.col("date") >= F.date_sub(a, 7)) & (F.col("date") <= a))
           .groupBy("date").agg(F.sum("qty").alias("actual")))
    pred = reports.forecast_day_totals(forecasts.where((F.col("target_date") >= F.date_sub(a, 7))
                                                       & (F.col("target_date") <= F.date_add(a, 2))))
    j = F.broadcast(spine).join(act, "date", "left").join(pred, "date", "left")
    future = F.col("date") > a
    return j.select(
        "date", month_day_label("date").alias("label"),
        F.when(future, F.lit(None).cast("double")).otherwise(F.coalesce("actual", F.lit(0.0))).alias("actual"),
        F.when(F.col("date") >= a, F.floor(F.coalesce("predicted", F.lit(0.0)) + 0.5))
         .otherwise(F.when(F.col("predicted") > 0, F.floor(F.col("predicted") + 0.5))).alias("predicted"),
        (F.col("date") == a).alias("is_today"))


def dashboard_kpis(sales: DataFrame, forecasts: DataFrame, stock: DataFrame, as_of) -> DataFrame:
    """One row: predicted today, today / yesterday / last-7 quantity, day-over-day %,
    low-stock count and expiring count.  Each input is reduced to one row in one pass,
    and the rows are read as scalar subqueries."""
    a = as_of_date(as_of)
    d = F.col("date")
    s = (sales.where((d >= F.date_sub(a, 7)) & (d <= a))
         .agg(F.coalesce(F.sum(F.when(d == a, F.col("qty"))), F.lit(0.0)).alias("today_qty"),
              F.coalesce(F.sum(F.when(d == F.date_sub(a, 1), F.col("qty"))), F.lit(0.0)).alias("yesterday_qty"),
              F.coalesce(F.sum(F.when(d < a, F.col("qty"))), F.lit(0.0)).alias("last7_qty")))
    p = (reports.forecast_day_totals(forecasts.where(F.col("target_date") == a))
         .agg(F.floor(F.coalesce(F.sum("predicted"), F.lit(0.0)) + 0.5).alias("predicted_today")))
    left = F.datediff(F.col("expiration_date"), a)
    held = stock.agg(F.count_if(F.col("status") == "low").alias("low_stock"),
                     F.count_if(left.between(0, fixed.EXPIRING_DAYS)).alias("expiring_count"))
    one = [df.select(F.struct(*df.columns).alias("r")).scalar() for df in (s, p, held)]
    j = sales.sparkSession.range(1).select(*[r[c].alias(c) for r, df in zip(one, (s, p, held)) for c in df.columns])
    return j.withColumn("day_over_day_pct", pct_change("today_qty", "yesterday_qty"))
