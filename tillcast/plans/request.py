"""Entry B: a forecast request turned into stored forecasts and a run-log row.

request (date, weather tags, event tags, free text) -> tag / keyword weights
(F11-F13) -> per-product average sales (J5) -> 10-day grid (J6, M12) ->
upsert of day-0-and-later rows into the stored forecasts (U1) and one run
log row (L1).  Returns DataFrames; the caller decides where to write them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators import tags, upsert


@dataclass
class RequestResult:
    grid: DataFrame
    forecasts: DataFrame
    run_log: DataFrame


def run_request(spark: SparkSession, *, avg_qty: DataFrame, products: DataFrame, stored: DataFrame,
                request_date: str, weather_tags=(), event_tags=(), custom_input: str = "",
                noise: float | str = 1.0, run_at: str | None = None) -> RequestResult:
    """``avg_qty``: name, avg_qty; ``products``: name; ``stored``: target_date, product, predicted_qty,
    created_at, forecast_period.  ``run_at`` is the run's time in the log, the start of the request's
    day by default: no clock is read.  A product and day has one fresh row, which replaces a stored one."""
    req = spark.createDataFrame([(request_date, list(weather_tags), list(event_tags), custom_input)],
                                "request_date string, weather_tags array<string>, event_tags array<string>, "
                                "custom_input string")
    log = tags.request_weights(req)
    weight = log.select("weight_pct").scalar()                 # one request: a scalar subquery
    grid = tags.forecast_grid(products.select("name").distinct(), avg_qty, request_date, weight, noise=noise)
    fresh = (grid.where(F.col("date") >= F.lit(request_date).cast("date"))      # only offsets >= 0 are stored
                 .select(F.col("date").alias("target_date"), F.col("item_id").alias("product"),
                         F.col("q50_daily").cast("double").alias("predicted_qty"),
                         F.lit(request_date).cast("date").alias("created_at"), F.lit(1).alias("forecast_period")))
    merged = upsert.upsert(stored.select("target_date", "product", "predicted_qty", "created_at", "forecast_period"),
                           fresh, ["target_date", "product"], [F.col("created_at").desc()])
    run_log = log.select(F.lit(run_at or request_date).cast("timestamp").alias("run_datetime"), "weather_factors", "event_factors",
                         "impact_summary", "weight_pct")
    return RequestResult(grid, merged, run_log)
