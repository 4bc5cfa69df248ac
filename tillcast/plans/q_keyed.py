"""Registered queries: keyed tables with commits, the request run log, compacted streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast import tables
from tillcast.operators import keyed_table, tags
from tillcast.operators.keyed_table import KeyedTable
from tillcast.plans.q_reports import SQL_FORECASTS
from tillcast.plans.q_stock import SQL_BATCHES
from tillcast.plans.registry import query
from tillcast.session import scratch_path

A = tables.AS_OF_SALES
AD = f"DATE '{A}'"
KEY = ["target_date", "product"]
FORECAST = [*KEY, "predicted_qty", "created_at", "forecast_period"]


def _forecast_table(spark, d) -> tuple[KeyedTable, "F.DataFrame"]:
    fc = tables.forecast_results(spark, d).select(*FORECAST)
    return KeyedTable.create(spark, scratch_path(spark, "keyed-forecasts"), fc, KEY), fc


@query("keyed_forecasts", f"""WITH {SQL_FORECASTS},
w AS (SELECT * FROM forecasts WHERE forecast_period = 7),
n AS (SELECT * FROM forecasts WHERE forecast_period = 1),
k AS (SELECT COALESCE(n.target_date, w.target_date) AS target_date, COALESCE(n.product, w.product) AS product,
             CASE WHEN n.product IS NULL THEN w.predicted_qty WHEN n.target_date >= {AD} THEN n.predicted_qty * 0.5 ELSE n.predicted_qty END AS predicted_qty,
             COALESCE(n.created_at, w.created_at) AS created_at, COALESCE(n.forecast_period, w.forecast_period) AS forecast_period
      FROM w FULL OUTER JOIN n ON n.target_date = w.target_date AND n.product = w.product)
SELECT target_date, product, CASE WHEN day(target_date) <> 1 THEN predicted_qty END AS predicted_qty, created_at, forecast_period
FROM k WHERE NOT (day(target_date) = 2 AND month(target_date) = 3)""", ops="U1 S14 U6")
def q_keyed_forecasts(spark, d):
    """A week-ahead run, then one commit with the day-ahead run, a later and smaller correction of it and an older,
    larger one that comes last in the input; then the first of a month set to NULL, and the 2nd of March deleted."""
    t, fc = _forecast_table(spark, d)
    t.commit(keyed_table.upserts(fc.where("forecast_period = 7"), 1))
    day = fc.where("forecast_period = 1")
    late = day.where(F.col("target_date") >= F.lit(A).cast("date")).withColumn("predicted_qty", F.col("predicted_qty") * 0.5)
    old = day.withColumn("predicted_qty", F.col("predicted_qty") + 1000)
    t.commit(keyed_table.upserts(late, 4), keyed_table.upserts(day, 3), keyed_table.upserts(old, 2))
    keys = fc.select(*KEY).distinct()
    none = keys.where(F.dayofmonth("target_date") == 1).withColumn("predicted_qty", F.lit(None).cast("double"))
    gone = keys.where((F.dayofmonth("target_date") == 2) & (F.month("target_date") == 3))
    t.commit(keyed_table.patches(none, 5, ["predicted_qty"]), keyed_table.deletes(gone, 5))
    return t.read()


@query("keyed_batches", f"""WITH {SQL_BATCHES},
b AS (SELECT product_id, min(expiration_date) AS expiration_date, CAST(sum(current_qty) AS BIGINT) AS current_qty, CAST(count(*) AS BIGINT) AS lots
      FROM batches GROUP BY product_id),
w AS (SELECT l_partkey AS product_id, CAST(sum(l_quantity) AS BIGINT) AS wasted FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT b.product_id, CASE WHEN w.wasted IS NULL THEN b.expiration_date END AS expiration_date,
       CASE WHEN w.wasted IS NULL THEN b.current_qty ELSE greatest(b.current_qty - w.wasted, 0) END AS current_qty, b.lots
FROM b LEFT JOIN w USING (product_id) WHERE w.wasted IS NULL OR b.current_qty > w.wasted
UNION ALL SELECT -p_partkey, NULL, 0, 0 FROM part""", ops="U6 U7")
def q_keyed_batches(spark, d):
    """Stock by product: appended, reset, appended again; waste patches quantity and clears the date; emptied products
    are deleted; then every part's empty slot is appended."""
    b = tables.inventory_batches(spark, d).groupBy("product_id").agg(
        F.min("expiration_date").alias("expiration_date"), F.sum("current_qty").alias("current_qty"), F.count(F.lit(1)).alias("lots"))
    t = KeyedTable.create(spark, scratch_path(spark, "keyed-batches"), b, ["product_id"])
    t.append(b)
    t.reset()
    t.append(b)
    w = tables.waste_history(spark, d).groupBy("product_id").agg(F.sum("quantity").alias("wasted"))
    left = t.read().join(w, "product_id").select("product_id", F.greatest(F.col("current_qty") - F.col("wasted"), F.lit(0)).alias("current_qty"),
                                                 F.lit(None).cast("date").alias("expiration_date"))
    t.commit(keyed_table.patches(left, 1, ["current_qty", "expiration_date"]), keyed_table.deletes(left.where("current_qty = 0").select("product_id"), 2))
    slots = tables.read(spark, d, "part").select((-F.col("p_partkey")).alias("product_id"), F.lit(None).cast("date").alias("expiration_date"),
                                                 F.lit(0).cast("long").alias("current_qty"), F.lit(0).cast("long").alias("lots"))
    t.append(slots)
    t.compact()
    return t.read()


@query("keyed_versions", f"""WITH {SQL_FORECASTS},
w AS (SELECT * FROM forecasts WHERE forecast_period = 7), n AS (SELECT * FROM forecasts WHERE forecast_period = 1),
u AS (SELECT target_date, product FROM w UNION SELECT target_date, product FROM n)
SELECT 0 AS version, 0::BIGINT AS row_count, NULL::DOUBLE AS total UNION ALL
SELECT 1, count(*), CAST(sum(predicted_qty) AS DOUBLE) FROM w UNION ALL
SELECT 2, (SELECT count(*) FROM u), CAST((SELECT sum(predicted_qty) FROM n) + COALESCE((SELECT sum(predicted_qty) FROM w
  WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.target_date = w.target_date AND n.product = w.product)), 0) AS DOUBLE) UNION ALL
SELECT 3, 0, NULL""", ops="U7")
def q_keyed_versions(spark, d):
    """Rows and total of every version: empty, week-ahead, day-ahead over it, reset."""
    t, fc = _forecast_table(spark, d)
    t.commit(keyed_table.upserts(fc.where("forecast_period = 7"), 1))
    t.commit(keyed_table.upserts(fc.where("forecast_period = 1"), 1))
    t.reset()
    out = None
    for v in range(t.version() + 1):
        r = t.read(v).agg(F.count(F.lit(1)).alias("row_count"), F.sum("predicted_qty").cast("double").alias("total")).select(F.lit(v).alias("version"), "row_count", "total")
        out = r if out is None else out.unionByName(r)
    return out


_SAID = "CASE event_type WHEN 'click' THEN '오후 소나기' WHEN 'purchase' THEN '가을 축제' ELSE '' END"


@query("request_run_log", f"""WITH r AS (
  SELECT event_id, ts, {_SAID} AS said, event_type = 'view' AS rainy FROM events),
w AS (SELECT *, CAST((CASE WHEN said = '오후 소나기' THEN -10 WHEN said = '가을 축제' THEN 30 ELSE 0 END) + (CASE WHEN rainy THEN -10 ELSE 0 END) AS INTEGER) AS weight_pct FROM r)
SELECT event_id AS run_id, CAST(ts AS TIMESTAMP) AS run_datetime, CASE WHEN rainy THEN '비' ELSE '' END AS weather_factors,
       CASE said WHEN '오후 소나기' THEN '자동인식: 소나기/비(-10%)' WHEN '가을 축제' THEN '자동인식: 축제(+30%)' ELSE '' END AS event_factors,
       CASE WHEN weight_pct > 0 THEN '수요 약 ' || weight_pct || '% 증가 예측'
            WHEN weight_pct < 0 THEN '수요 약 ' || abs(weight_pct) || '% 감소 예측'
            ELSE '외생 변수 영향 없음 (평년 수준)' END AS impact_summary, weight_pct
FROM w""", ops="L1 S14 F11 F12 F13")
def q_run_log(spark, d):
    """Every event as a request, appended to the run log in two commits, the log read back."""
    ev = tables.read(spark, d, "events")
    said = F.when(F.col("event_type") == "click", "오후 소나기").when(F.col("event_type") == "purchase", "가을 축제").otherwise("")
    none = F.array().cast("array<string>")
    req = ev.select("event_id", "ts", said.alias("custom_input"), none.alias("event_tags"),
                    F.when(F.col("event_type") == "view", F.array(F.lit("비"))).otherwise(none).alias("weather_tags"))
    log = tags.request_weights(req).select(F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("run_datetime"),
                                           "weather_factors", "event_factors", "impact_summary", "weight_pct")
    t = KeyedTable.create(spark, scratch_path(spark, "run-log"), log, ["run_id"])
    half = F.lit("2024-01-10").cast("timestamp")
    t.append(log.where(F.col("run_datetime") < half))
    t.append(log.where(F.col("run_datetime") >= half))
    return t.read()
