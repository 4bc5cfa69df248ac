"""Forecast-request tags, weights and the rule-based forecast grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast import fixed
from tillcast.functions.dates import as_of_date
from tillcast.functions.text import impact_label, keyword_tags


def tag_weight_pct(tags_col, kind: str) -> F.Column:
    """summed integer percent weight of the known tags in an array column.

    Each known tag counts once (set membership), unknown tags count 0.
    """
    w = F.lit(0)
    for k, tag, pct in fixed.TAG_WEIGHTS_PCT:
        if k == kind:
            w = w + F.when(F.array_contains(F.col(tags_col), tag), F.lit(pct)).otherwise(F.lit(0))
    return w


def request_weights(requests: DataFrame, *, weather_col="weather_tags", event_col="event_tags",
                    text_col: str | None = "custom_input") -> DataFrame:
    """F11-F13 + L1: total weight (integer %), impact sentence and the run-log fields per request."""
    df = requests
    kw = keyword_tags(F.col(text_col)) if text_col and text_col in df.columns else F.array().cast(
        "array<struct<label:string,weight_pct:int>>")
    df = df.withColumn("_kw", kw)
    weight = (tag_weight_pct(weather_col, "weather") + tag_weight_pct(event_col, "event")
              + F.aggregate("_kw", F.lit(0), lambda a, x: a + x["weight_pct"]))
    labels = F.transform("_kw", lambda x: x["label"])
    ev = F.array_join(F.col(event_col), ", ")
    ev_full = F.when(F.size(labels) > 0,
                     F.concat(ev, F.when(ev != "", F.lit(" | ")).otherwise(F.lit("")),
                              F.lit(fixed.AUTO_DETECTED_PREFIX), F.array_join(labels, ", "))).otherwise(ev)
    return (df.withColumn("weight_pct", weight.cast("int"))
              .withColumn("weather_factors", F.array_join(F.col(weather_col), ", "))
              .withColumn("event_factors", ev_full)
              .withColumn("impact_summary", impact_label("weight_pct"))
              .drop("_kw"))


def forecast_grid(products: DataFrame, avg_qty: DataFrame, request_date, weight_pct, *,
                  noise: float | str = 1.0) -> DataFrame:
    """M12 (J5, J6): for each product and each day in request_date-7 .. +2:
    base = average sold quantity (10 if none) x weekday factor x max(0.1, ...) of (1 + weight).

    The date range is an array exploded per product row (no join of dates
    with products).  ``avg_qty`` comes from one grouped aggregate (J5), not
    one query per cell.  ``noise`` is a constant factor, or ``"hash"`` for a
    deterministic uniform [0.9, 1.1] per (date, product) from ``xxhash64``
    (the same cell always gets the same factor).
    """
    a = as_of_date(request_date)
    lo, hi = fixed.GRID_DAYS
    p = products.join(avg_qty, "name", "left")
    p = p.withColumn("date", F.explode(F.sequence(F.date_add(a, lo), F.date_add(a, hi))))
    wd = F.weekday("date")
    factor = F.lit(1.0)
    for day, f in fixed.WEEKDAY_FACTOR:
        factor = F.when(wd == day, F.lit(f)).otherwise(factor)
    mult = F.greatest(factor * (F.lit(1.0) + _w(weight_pct) / 100.0), F.lit(fixed.MIN_DAY_FACTOR))
    base = F.coalesce(F.col("avg_qty"), F.lit(fixed.GRID_DEFAULT_BASE))
    if noise == "hash":
        u = (F.pmod(F.xxhash64(F.col("date").cast("string"), F.col("name")), F.lit(1_000_000)) / 1_000_000.0)
        nz = F.lit(0.9) + u * 0.2
    else:
        nz = F.lit(float(noise))
    q50 = F.bround(base * mult * nz, 0).cast("int")
    q95 = F.bround(base * fixed.GRID_Q95_FACTOR * mult * nz, 0).cast("int")
    out = p.select("date", F.col("name").alias("item_id"), q50.alias("q50_daily"), q95.alias("q95_daily"))
    return (out.withColumn("protection_days", F.lit(fixed.GRID_PROTECTION_DAYS))
               .withColumn("target_stock", F.col("q50_daily") * fixed.GRID_PROTECTION_DAYS)
               .withColumn("recommended_order_qty",
                           F.when(F.col("date") == a, F.greatest(F.lit(0), F.col("q50_daily") * fixed.GRID_PROTECTION_DAYS
                                                                - fixed.GRID_ORDER_OFFSET)).otherwise(F.lit(0))))


def _w(weight_pct):
    if isinstance(weight_pct, str):
        return F.col(weight_pct)
    if isinstance(weight_pct, F.Column):
        return weight_pct.cast("double")
    return F.lit(float(weight_pct))
