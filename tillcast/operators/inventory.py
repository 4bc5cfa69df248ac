"""Replenishment maths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast import fixed
from tillcast.functions.numeric import days_of_stock
from tillcast.functions.stats import inv_norm_cdf


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def service_level(underage, overage) -> Column:
    """Newsvendor critical ratio.  Invalid costs raise inside the job."""
    u, o = _c(underage).cast("double"), _c(overage).cast("double")
    return (F.when(u <= 0, F.raise_error(F.lit("underage_cost must be positive")).cast("double"))
             .when(o < 0, F.raise_error(F.lit("overage_cost cannot be negative")).cast("double"))
             .otherwise(u / (u + o)))


def order_up_to(mu, sigma, sl) -> Column:
    """max(0, mu + z(sl) * max(0, sigma)) with sl clipped to [1e-4, 0.9999]."""
    p = F.least(F.greatest(_c(sl), F.lit(fixed.SERVICE_LEVEL_MIN)), F.lit(fixed.SERVICE_LEVEL_MAX))
    return F.greatest(F.lit(0.0), _c(mu) + inv_norm_cdf(p) * F.greatest(F.lit(0.0), _c(sigma)))


def optimal_order(df: DataFrame, *, inventory="current_inventory", q50="q50_daily", q95="q95_daily",
                  lead="lead_time_days", review="review_period_days", moq="moq",
                  margin="unit_margin", holding="unit_holding_cost") -> DataFrame:
    """Protection days, service level, target stock and the MOQ-rounded order."""
    prot = F.greatest(F.lit(1), _c(lead).cast("int") + _c(review).cast("int"))
    df = df.withColumn("protection_days", prot)
    mu = _c(q50) * F.col("protection_days")
    sigma = (F.greatest(F.lit(0.0), (_c(q95) - _c(q50)) / fixed.Z_95)
             * F.sqrt(F.col("protection_days").cast("double")))
    df = df.withColumn("service_level", service_level(margin, holding))
    df = df.withColumn("_target", order_up_to(mu, sigma, F.col("service_level")))
    raw = F.greatest(F.lit(0.0), F.col("_target") - _c(inventory))
    qty = F.when(raw <= 0, F.lit(0)).otherwise((F.ceil(raw / _c(moq)) * _c(moq)).cast("int"))
    return (df.withColumn("recommended_order_qty", qty.cast("int"))
              .withColumn("target_stock", F.round("_target", 2))
              .drop("_target"))


def order_priority(inventory, target, *, must=fixed.MUST_THRESHOLD,
                   recommend=fixed.RECOMMEND_THRESHOLD) -> Column:
    """I4: stock / target below 0.30 -> must, below 0.70 -> recommended, else spare."""
    inv, tgt = _c(inventory).cast("double"), _c(target).cast("double")
    ratio = inv / tgt
    return (F.when(tgt <= 0, F.lit(fixed.PRIORITY_SPARE))
             .when(ratio < must, F.lit(fixed.PRIORITY_MUST))
             .when(ratio < recommend, F.lit(fixed.PRIORITY_RECOMMEND))
             .otherwise(F.lit(fixed.PRIORITY_SPARE)))


def expected_cost(qty, unit_cost) -> Column:
    """I5."""
    return _c(qty).cast("double") * _c(unit_cost).cast("double")


def stock_status(stock, min_stock, max_stock) -> tuple[Column, Column]:
    """(stock percent of max, low / high / normal); low wins over high."""
    pct = F.floor(_c(stock) / _c(max_stock) * 100 + 0.5)
    status = (F.when(_c(stock) < _c(min_stock), F.lit("low"))
               .when(pct > 100, F.lit("high")).otherwise(F.lit("normal")))
    return pct, status


def reorder_list(stock: DataFrame, *, cover_days=fixed.REORDER_COVER_DAYS) -> DataFrame:
    """Items not overstocked with urgency by days of stock left and a suggested quantity.

    Input columns: id, product, current_stock, min_stock, max_stock, daily_usage.
    """
    pct, status = stock_status("current_stock", "min_stock", "max_stock")
    left = days_of_stock("current_stock", "daily_usage", fixed.NO_USAGE_DAYS_LEFT)
    return (stock.withColumn("status", status).where(F.col("status") != "high")
            .withColumn("days_left", left)
            .withColumn("urgency", F.when(F.col("days_left") <= fixed.URGENCY_HIGH_DAYS, F.lit("high"))
                        .when(F.col("days_left") <= fixed.URGENCY_MEDIUM_DAYS, F.lit("medium"))
                        .otherwise(F.lit("low")))
            .withColumn("suggested_qty", F.greatest(
                F.col("min_stock").cast("long"),
                F.ceil(F.col("daily_usage") * cover_days - F.col("current_stock")).cast("long"))))


def urgency_rank(col="urgency") -> Column:
    """High < medium < low."""
    return F.when(_c(col) == "high", 0).when(_c(col) == "medium", 1).otherwise(2)
