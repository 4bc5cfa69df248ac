"""Baseline forecasts, last-row lookups, horizon slices and holdout metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast import fixed
from tillcast.functions.stats import pinball


def last_row_per_item(df: DataFrame, cols: list[str], *, item_col="item_id", date_col="date") -> DataFrame:
    """The latest row's ``cols`` per item (``max_by`` aggregate: no sort of facts)."""
    st = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(item_col).agg(F.max_by(st, F.col(date_col)).alias("_last"), F.max(date_col).alias("last_date"))
              .select(item_col, "last_date", "_last.*"))


def naive_quantiles(daily: DataFrame, *, tail=fixed.NAIVE_TAIL_DAYS, item_col="item_id") -> DataFrame:
    """q50 = mean of the last <=7 rows; q95 = q50 + 1.645*sample std (q50*1.15 if std is 0)."""
    o = Window.partitionBy(item_col).orderBy(F.col("date").desc())
    t = daily.select(item_col, "date", "demand_qty").withColumn("_rn", F.row_number().over(o)).where(F.col("_rn") <= tail)
    g = t.groupBy(item_col).agg(F.avg("demand_qty").alias("q50_daily"),
                                F.coalesce(F.stddev_samp("demand_qty"), F.lit(0.0)).alias("sigma"))
    q95 = F.when(F.col("sigma") == 0.0, F.col("q50_daily") * fixed.NAIVE_FLAT_SIGMA_FACTOR).otherwise(
        F.greatest(F.col("q50_daily"), F.col("q50_daily") + fixed.Z_95 * F.col("sigma")))
    return g.withColumn("q95_daily", q95)


def flat_path(value_col: str, horizon: int):
    """M9: a flat forecast path of ``horizon`` days."""
    return F.array_repeat(F.col(value_col).cast("double"), horizon)


def horizon_slice(path_col: str, horizon: int):
    """The first ``horizon`` days of a longer path."""
    return F.slice(F.col(path_col), 1, horizon)


def forecast_metrics(pred: DataFrame, *, actual="demand_qty", q50="q50", q95="q95") -> DataFrame:
    """MAE and RMSE of q50, pinball loss of q95, as three (metric, value) rows.

    An empty prediction frame yields NULL values (not an error).
    """
    m = pred.agg(
        F.avg(F.abs(F.col(actual) - F.col(q50))).alias("mae"),
        F.sqrt(F.avg(F.pow(F.col(actual) - F.col(q50), 2))).alias("rmse"),
        F.avg(pinball(actual, q95, 0.95)).alias("pinball"),
    )
    return m.select(F.expr("stack(3, 'MAE (q50)', mae, 'RMSE (q50)', rmse, 'Pinball Loss (q95)', pinball) "
                           "as (metric, value)"))
