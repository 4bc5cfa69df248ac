"""Registered queries: batch maintenance, file round trips, exports, labels and text tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast import tables
from tillcast.functions.text import currency_to_number, format_krw, keyword_tags
from tillcast.operators import demand, fefo, upsert
from tillcast.plans import common
from tillcast.plans.common import SQL_DAILY
from tillcast.plans.q_reports import SQL_FORECASTS, SQL_STOCK, _stock
from tillcast.plans.registry import ORACLE, query
from tillcast.session import scratch_path
from tillcast.sources import pos, sinks
from tillcast import fixed

_DED = ORACLE["fefo_deduction"]


@query("batch_maintenance", f"""WITH d AS ({_DED})
SELECT batch_id, product_id, expiration_date, new_qty AS current_qty FROM d WHERE new_qty <> 0""", ops="U6 W13")
def q_batch_maintenance(spark, d):
    """Patch each batch's quantity after waste (U6 patch) and delete emptied batches (U6 delete)."""
    key = tables.BATCH_KEY
    b = tables.inventory_batches(spark, d)
    ded = fefo.fefo_deduction(b, tables.waste_history(spark, d), tiebreak=tables.BATCH_TIEBREAK)
    patched = upsert.patch(b, ded.select(*key, F.col("new_qty").alias("current_qty")), key)
    emptied = ded.where(F.col("new_qty") == 0).select(*key)
    return upsert.delete_keys(patched, emptied, key).select("batch_id", "product_id", "expiration_date", "current_qty")


@query("csv_roundtrip_daily", f"""WITH {SQL_DAILY}
SELECT date, item_id, round(demand_qty, 4) AS demand_qty, round(sales_amount, 4) AS sales_amount FROM daily""",
       ops="S3 S7 S8 S12 U5")
def q_csv_roundtrip(spark, d):
    """Write daily demand as a normalized CSV export, a newer export without a demand layout and an empty
    sample-named one, rank the candidates (non-sample first, newest first) and read back the first that
    passes (S2/S3, S8): the newer export is ranked first and skipped."""
    base = scratch_path(spark, "csv-sources")
    dd = common.daily(spark, d).select("date", "item_id", "demand_qty", "sales_amount")
    sinks.write_csv(dd, f"{base}/export")
    sinks.write_csv(spark.createDataFrame([], dd.schema), f"{base}/sample_export")   # an empty sample-named source
    sinks.write_csv(spark.createDataFrame([("closed",)], "note string"), f"{base}/broken_export")
    chosen, _, skipped = pos.first_valid_source(spark, f"{base}/*/*.csv")      # a written folder is one source
    if chosen is None:
        raise ValueError(f"no valid source: {skipped}")
    report = demand.quality_report(chosen, feature_cols=["date", "item_id", "demand_qty"], timesteps=0).first()
    if report["rows"] == 0:
        raise ValueError(f"no valid source: {report['issues']}")
    return chosen.select("date", "item_id", F.round("demand_qty", 4).alias("demand_qty"),
                         F.round("sales_amount", 4).alias("sales_amount"))


@query("stock_value_labels", f"""WITH {SQL_STOCK},
v AS (SELECT category, CAST(floor(round(SUM(unit_price * current_stock), 2) + 0.5) AS BIGINT) AS value FROM stock GROUP BY 1)
SELECT category, value, '₩' || format('{{:,}}', value) AS label, value AS parsed FROM v""", ops="F6 F9")
def q_stock_labels(spark, d):
    st = _stock(spark, d)
    # the exact total has cents: round to cents first so summation order cannot move a .50 tie
    v = st.groupBy("category").agg(
        F.floor(F.round(F.sum(F.col("unit_price") * F.col("current_stock")), 2) + 0.5).cast("long").alias("value"))
    lab = v.withColumn("label", format_krw("value"))
    return lab.withColumn("parsed", currency_to_number("label"))


# the rules as the specification words them, apart from the table that the code reads
_SPOKEN = (
    ('비|소나기|장마|강우', '소나기/비(-10%)', -10),
    ('눈|폭설|함박눈', '폭설/눈(-15%)', -15),
    ('폭염|더위|무더위', '폭염(+20%)', 20),
    ('축제|페스티벌|행사', '축제(+30%)', 30),
    ('콘서트|공연', '공연(+20%)', 20),
    ('우박|태풍', '태풍/악천후(-30%)', -30),
    ('소풍|운동회|체육대회|나들이|마라톤', '야외행사(+15%)', 15),
)
_RULES_SQL = " + ".join(f"(CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0 END)" for p, _, w in _SPOKEN)
_LABELS_SQL = "concat_ws(', ', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{lab}' END" for p, lab, _ in _SPOKEN) + ")"


@query("conversation_keyword_tags", f"""
SELECT conv_id, turn, CAST({_RULES_SQL} AS INTEGER) AS weight_pct, {_LABELS_SQL} AS labels FROM conversations""",
       ops="F11 F12")
def q_conv_tags(spark, d):
    c = tables.read(spark, d, "conversations").select("conv_id", "turn", "text")
    t = c.withColumn("_kw", keyword_tags("text"))
    return t.select("conv_id", "turn",
                    F.aggregate("_kw", F.lit(0), lambda a, x: a + x["weight_pct"]).cast("int").alias("weight_pct"),
                    F.array_join(F.transform("_kw", lambda x: x["label"]), ", ").alias("labels"))


@query("forecast_request", f"""WITH {SQL_FORECASTS},
s AS (SELECT p_name AS name, avg(l_quantity) AS avg_qty FROM lineitem JOIN part ON l_partkey = p_partkey
      WHERE l_returnflag <> 'R' GROUP BY 1),
names AS (SELECT DISTINCT p_name AS name FROM part),
g AS (SELECT n.name, s.avg_qty, CAST(unnest(generate_series(DATE '2001-06-30', DATE '2001-06-30' + 2, INTERVAL 1 DAY)) AS DATE) AS date
      FROM names n LEFT JOIN s USING (name)),
m AS (SELECT *, greatest(CASE isodow(date) - 1 WHEN 5 THEN 1.3 WHEN 6 THEN 1.4 WHEN 0 THEN 0.9 WHEN 4 THEN 1.1 ELSE 1.0 END
                         * (1.0 + 20.0 / 100.0), 0.1) AS mult, COALESCE(avg_qty, 10.0) AS base FROM g),
fresh AS (SELECT date AS target_date, name AS product, CAST(CAST(round_even(base * mult, 0) AS INTEGER) AS DOUBLE) AS predicted_qty,
                 DATE '2001-06-30' AS created_at, 1 AS forecast_period FROM m),
tgt AS (SELECT target_date, product, predicted_qty, created_at, forecast_period FROM forecasts)
SELECT * FROM tgt WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.target_date = tgt.target_date AND f.product = tgt.product)
UNION ALL SELECT * FROM fresh""", ops="M12 U1 L1 F12 F13 S14")
def q_forecast_request(spark, d):
    """Entry B on the provided tables: a request for 2001-06-30 with tags rain + local festival."""
    from tillcast.plans.request import run_request
    res = run_request(spark, avg_qty=tables.average_quantity(spark, d), products=tables.product(spark, d), stored=tables.forecast_results(spark, d),
                      request_date=tables.AS_OF_SALES, weather_tags=["비"], event_tags=["지역 축제"])
    return res.forecasts


@query("daily_demand_by_month", f"""WITH {SQL_DAILY}
SELECT date, item_id, round(demand_qty, 4) AS demand_qty, strftime(date, '%Y-%m') AS month FROM daily""", ops="S12 P9 A1")
def q_daily_by_month(spark, d):
    """Daily demand stored month-partitioned, read back over the full date range (month filters prune)."""
    path = scratch_path(spark, "daily-by-month")
    sinks.write_by_month(common.daily(spark, d).select("date", "item_id", "demand_qty"), path)
    back = sinks.read_months(spark, path, "1900-01-01", "2999-12-31")
    return back.select("date", "item_id", F.round("demand_qty", 4).alias("demand_qty"), "month")


@query("source_gate", f"""WITH {SQL_DAILY}
SELECT date, item_id, round(demand_qty, 4) AS demand_qty, round(sales_amount, 4) AS sales_amount FROM daily""", ops="S2 S3 S7 S8 Q1")
def q_source_gate(spark, d):
    """Five candidates, loaded and judged by one plan; the older whole export is the first that passes."""
    chosen, _ = pos.gated_source(spark, _candidates(spark, d))
    return chosen.select("date", "item_id", F.round("demand_qty", 4).alias("demand_qty"), F.round("sales_amount", 4).alias("sales_amount"))


@query("source_gate_verdicts", f"""WITH {SQL_DAILY},
n AS (SELECT item_id, count(*) AS n FROM daily GROUP BY item_id)
SELECT 'export' AS source, (SELECT count(*) FROM daily) AS rows, (SELECT count(*) FROM n) AS items, true AS ok, NULL AS reason
UNION ALL SELECT 'broken_export', 0, 0, false, 'no valid rows' UNION ALL SELECT 'empty_export', 0, 0, false, 'no valid rows'
UNION ALL SELECT 'short_export', (SELECT count(*) FROM daily WHERE date < (SELECT min(date) FROM daily) + 5),
  (SELECT count(DISTINCT item_id) FROM daily WHERE date < (SELECT min(date) FROM daily) + 5), false, 'insufficient history per item'
UNION ALL SELECT 'sample_export', (SELECT count(*) FROM daily), (SELECT count(*) FROM n), true, NULL""", ops="S7 S8 Q1")
def q_source_verdicts(spark, d):
    _, verdicts = pos.gated_source(spark, _candidates(spark, d))
    return verdicts.select(F.regexp_extract("source", "([^/]+)$", 1).alias("source"), "rows", "items", "ok",
                           F.regexp_replace("reason", ": min_item_days=.*", "").alias("reason"))


def _candidates(spark, d) -> str:
    """A whole export, then newer ones: too short a history, no demand layout, no rows; and a whole sample-named one."""
    base = scratch_path(spark, "gate-sources")
    dd = common.daily(spark, d).select("date", "item_id", "demand_qty", "sales_amount").checkpoint()
    sinks.write_csv(dd, f"{base}/export")
    sinks.write_csv(dd.where(F.col("date") < F.date_add(dd.agg(F.min("date")).scalar(), 5)), f"{base}/short_export")
    sinks.write_csv(dd.select(F.lit("closed").alias("note"), "item_id"), f"{base}/broken_export")
    sinks.write_csv(spark.createDataFrame([], dd.schema), f"{base}/empty_export")
    sinks.write_csv(dd, f"{base}/sample_export")
    return f"{base}/*/*.csv"
