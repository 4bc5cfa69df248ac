"""Registered queries: upserts, overlays and the Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast import tables
from tillcast.operators import upsert, weather
from tillcast.plans.q_external import SQL_PIVOT
from tillcast.plans.q_reports import SQL_FORECASTS
from tillcast.plans.q_stock import SQL_BATCHES
from tillcast.plans.registry import query
from tillcast.session import scratch_path
from tillcast.streaming import incremental

A = tables.AS_OF_SALES
AD = f"DATE '{A}'"


@query("forecast_upsert", f"""WITH {SQL_FORECASTS},
tgt AS (SELECT target_date, product, predicted_qty, forecast_period FROM forecasts WHERE forecast_period = 7),
upd AS (SELECT target_date, product, predicted_qty, forecast_period FROM forecasts
        WHERE forecast_period = 1 AND target_date >= {AD})
SELECT * FROM tgt WHERE NOT EXISTS (SELECT 1 FROM upd WHERE upd.target_date = tgt.target_date AND upd.product = tgt.product)
UNION ALL SELECT * FROM upd""", ops="U1 S14")
def q_forecast_upsert(spark, d):
    fc = tables.forecast_results(spark, d).select("target_date", "product", "predicted_qty", "forecast_period", "created_at")
    target = fc.where(F.col("forecast_period") == 7)
    updates = fc.where((F.col("forecast_period") == 1) & (F.col("target_date") >= F.lit(A).cast("date")))
    return upsert.upsert(target, updates, ["target_date", "product"], [F.col("created_at").desc()]).drop("created_at")


_SQL_WEATHER_UPSERT = SQL_PIVOT.replace("FROM events)", "FROM events WHERE ts < TIMESTAMP '2024-01-16')") \
    .replace("piv AS (", "p1 AS (") + ",\n" + SQL_PIVOT.replace("wlong AS (", "wlong2 AS (").replace(
    "FROM events)", "FROM events WHERE ts >= TIMESTAMP '2024-01-12')").replace("FROM wlong GROUP", "FROM wlong2 GROUP").replace(
    "piv AS (", "p2 AS (")


@query("weather_upsert", f"""WITH {_SQL_WEATHER_UPSERT}
SELECT * FROM p1 WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p2.region = p1.region AND p2.base_date = p1.base_date
                                   AND p2.base_time = p1.base_time)
UNION ALL SELECT * FROM p2""", ops="U2")
def q_weather_upsert(spark, d):
    long = tables.weather_long(spark, d)
    ts = F.to_timestamp(F.concat("fcst_date", F.lit(" "), "fcst_time"), "yyyyMMdd HHmm")
    first = weather.weather_pivot(long.where(ts < F.lit("2024-01-16").cast("timestamp")))
    second = weather.weather_pivot(long.where(ts >= F.lit("2024-01-12").cast("timestamp")))
    # the pivot has one row a key: there is nothing to choose between
    return upsert.upsert(first, second, ["region", "base_date", "base_time"], [F.lit(1)])


@query("forecast_overlay", f"""WITH {SQL_FORECASTS},
old AS (SELECT target_date AS date, SUM(predicted_qty) AS value FROM forecasts WHERE forecast_period = 7 GROUP BY 1),
new AS (SELECT target_date AS date, SUM(predicted_qty) AS value FROM forecasts WHERE forecast_period = 1 GROUP BY 1),
j AS (SELECT COALESCE(o.date, n.date) AS date,
             CASE WHEN COALESCE(o.date, n.date) >= {AD} THEN COALESCE(n.value, o.value) ELSE o.value END AS value
      FROM old o FULL OUTER JOIN new n ON o.date = n.date)
SELECT * FROM j WHERE value IS NOT NULL""", ops="U8")
def q_forecast_overlay(spark, d):
    fc = tables.forecast_results(spark, d)
    old = fc.where("forecast_period = 7").groupBy(F.col("target_date").alias("date")).agg(F.sum("predicted_qty").alias("value"))
    new = fc.where("forecast_period = 1").groupBy(F.col("target_date").alias("date")).agg(F.sum("predicted_qty").alias("value"))
    return upsert.overlay(old, new, A)


# -------------------------------------------------------------- streaming
def _stream_lines(spark, d):
    src = spark.readStream.schema(tables.read(spark, d, "lineitem").schema).option("maxFilesPerTrigger", 1) \
        .parquet(f"{d}/lineitem*.parquet")
    return src.select(F.col("l_shipdate").alias("ts"), F.col("l_partkey").alias("product_id"),
                      F.col("l_quantity").alias("qty"),
                      (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
                      (F.col("l_returnflag") == "R").alias("is_return"),
                      (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"))


@query("stream_daily_demand", """
SELECT CAST(l_shipdate AS DATE) AS date, p_type AS item_id, round(CAST(SUM(l_quantity) AS DOUBLE), 4) AS demand_qty,
       round(CAST(SUM(l_extendedprice * (1 - l_discount)) AS DOUBLE), 4) AS sales_amount
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY 1, 2""", ops="X1")
def q_stream_daily(spark, d):
    out, ck = scratch_path(spark, "x1-out"), scratch_path(spark, "x1-ckpt")
    prods = tables.product(spark, d).select("product_id", F.col("category").alias("item_id"))
    incremental.daily_demand_stream(_stream_lines(spark, d), prods, out, ck)
    r = incremental.read_daily_demand(spark, out)
    return r.select("date", "item_id", F.round("demand_qty", 4).alias("demand_qty"),
                    F.round("sales_amount", 4).alias("sales_amount"))


@query("stream_waste_decrement", f"""WITH {SQL_BATCHES},
w AS (SELECT l_partkey AS product_id, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w FROM lineitem
      WHERE l_returnflag = 'R' GROUP BY 1),
p AS (SELECT b.*, COALESCE(SUM(current_qty) OVER (PARTITION BY product_id ORDER BY expiration_date, batch_id, supplier_id, received_qty, line_price, received_date
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
      FROM batches b WHERE current_qty > 0)
SELECT p.batch_id, p.product_id, p.current_qty - CAST(greatest(0, least(p.current_qty, COALESCE(w.w, 0) - p.prev)) AS BIGINT) AS new_qty
FROM p LEFT JOIN w USING (product_id)""", ops="X2 W13")
def q_stream_waste(spark, d):
    out, ck = scratch_path(spark, "x2-out"), scratch_path(spark, "x2-ckpt")
    wastes = _stream_lines(spark, d).where(F.col("is_return")).select(
        "product_id", F.col("qty").cast("long").alias("quantity"))
    incremental.waste_stream(wastes, out, ck)
    incremental.compact(spark, out, incremental.FOLD_WASTE, 0)
    res = incremental.read_batches_after_waste(spark, tables.inventory_batches(spark, d), out,
                                               tiebreak=tables.BATCH_TIEBREAK)
    return res.where(F.col("current_qty") > 0).select("batch_id", "product_id", "new_qty")


@query("stream_weather_upsert", f"WITH {SQL_PIVOT} SELECT * FROM piv", ops="X3 A9")
def q_stream_weather(spark, d):
    out, ck = scratch_path(spark, "x3-out"), scratch_path(spark, "x3-ckpt")
    src = spark.readStream.schema(tables.read(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    long = tables.weather_long_from(src)
    incremental.weather_stream(long, out, ck)
    return incremental.read_weather(spark, out)
