"""Registered queries on inputs that reach every rule: rejects, keywords, named batches, written files read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillcast import tables
from tillcast.functions.text import keyword_tags
from tillcast.operators import accuracy, features, fefo, inventory, reports, views, weather
from tillcast.plans import common, q_external
from tillcast.plans.q_external import AE, AED, SQL_PIVOT
from tillcast.plans.q_reports import SQL_ACC, SQL_FORECASTS, SQL_STOCK, SQL_WASTE, _stock
from tillcast.plans.q_stock import SQL_BATCHES
from tillcast.plans.registry import ORACLE, query
from tillcast.session import scratch_path
from tillcast.sources import sinks


@query("named_batch_waste", f"""WITH {SQL_BATCHES},
w AS (SELECT l_orderkey * 8 + l_linenumber - 1 AS batch_id, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT b.batch_id, b.product_id, b.current_qty, CAST(greatest(b.current_qty - COALESCE(w, 0), 0) AS BIGINT) AS new_qty,
       CAST(greatest(COALESCE(w, 0) - b.current_qty, 0) AS BIGINT) AS excess_waste
FROM batches b LEFT JOIN w USING (batch_id)""", ops="I9")
def q_named_batch(spark, d):
    """Each returned line wastes the batch of the line before it."""
    w = tables.waste_history(spark, d).select((F.col("waste_id") - 1).alias("batch_id"), "quantity")
    return fefo.named_batch_waste(tables.inventory_batches(spark, d), w).select(
        "batch_id", "product_id", "current_qty", "new_qty", "excess_waste")


@query("waste_validation_rejects", """WITH r AS (
  SELECT l_orderkey * 8 + l_linenumber AS waste_id, CASE WHEN l_linenumber % 5 <> 0 THEN l_partkey END AS product_id,
         CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS quantity,
         CASE WHEN l_linenumber % 3 = 0 THEN '  ' ELSE l_linestatus END AS reason FROM lineitem),
v AS (SELECT *, CASE WHEN product_id IS NULL THEN 'missing product'
                     WHEN quantity IS NULL OR quantity = 0 THEN 'missing quantity'
                     WHEN reason IS NULL OR trim(reason) = '' THEN 'missing reason' END AS reject_reason FROM r)
SELECT *, reject_reason IS NULL AS accepted FROM v""", ops="P25")
def q_waste_rejects(spark, d):
    n = F.col("l_linenumber")
    rows = tables.read(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + n).alias("waste_id"), F.when(n % 5 != 0, F.col("l_partkey")).alias("product_id"),
        F.when(n % 4 == 0, 0).otherwise(F.col("l_quantity").cast("long")).alias("quantity"),
        F.when(n % 3 == 0, "  ").otherwise(F.col("l_linestatus")).alias("reason"))
    return views.validate_waste(rows)


@query("inventory_validation_rejects", """WITH r AS (
  SELECT l_orderkey * 8 + l_linenumber AS batch_id, CASE WHEN l_linenumber % 5 <> 0 THEN l_partkey END AS product_id,
         CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_shipdate AS DATE) END AS received_date,
         CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linestatus END AS status FROM lineitem),
v AS (SELECT *, CASE WHEN product_id IS NULL THEN 'missing product_id' WHEN received_date IS NULL THEN 'missing received_date'
                     WHEN status IS NULL OR trim(status) = '' THEN 'missing status' END AS reject_reason FROM r)
SELECT *, reject_reason IS NULL AS accepted FROM v""", ops="P25")
def q_inventory_rejects(spark, d):
    n = F.col("l_linenumber")
    rows = tables.read(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + n).alias("batch_id"), F.when(n % 5 != 0, F.col("l_partkey")).alias("product_id"),
        F.when(n % 4 != 0, F.col("l_shipdate").cast("date")).alias("received_date"),
        F.when(n % 3 == 0, "").otherwise(F.col("l_linestatus")).alias("status"))
    return views.validate_inventory(rows, ["product_id", "received_date", "status"])


@query("request_keyword_hits", """WITH r AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN '오후 소나기' WHEN 'view' THEN '폭염과 콘서트' WHEN 'error' THEN '태풍, 폭설'
                                   WHEN 'purchase' THEN '가을 축제와 마라톤' ELSE '' END AS text FROM events)
SELECT event_id, CAST(CASE text WHEN '오후 소나기' THEN -10 WHEN '폭염과 콘서트' THEN 40 WHEN '태풍, 폭설' THEN -45
                                WHEN '가을 축제와 마라톤' THEN 45 ELSE 0 END AS INTEGER) AS weight_pct,
       CASE text WHEN '오후 소나기' THEN '소나기/비(-10%)' WHEN '폭염과 콘서트' THEN '폭염(+20%), 공연(+20%)'
                 WHEN '태풍, 폭설' THEN '폭설/눈(-15%), 태풍/악천후(-30%)'
                 WHEN '가을 축제와 마라톤' THEN '축제(+30%), 야외행사(+15%)' ELSE '' END AS labels
FROM r""", ops="F11 F12")
def q_keyword_hits(spark, d):
    """Requests worded by event type, so that every keyword rule is met."""
    said = {"click": "오후 소나기", "view": "폭염과 콘서트", "error": "태풍, 폭설", "purchase": "가을 축제와 마라톤"}
    text = F.lit("")
    for kind, words in said.items():
        text = F.when(F.col("event_type") == kind, words).otherwise(text)
    t = tables.read(spark, d, "events").select("event_id", keyword_tags(text).alias("_kw"))
    return t.select("event_id", F.aggregate("_kw", F.lit(0), lambda a, x: a + x["weight_pct"]).cast("int").alias("weight_pct"),
                    F.array_join(F.transform("_kw", lambda x: x["label"]), ", ").alias("labels"))


@query("weather_feed_json", f"WITH {SQL_PIVOT} SELECT * FROM piv", ops="S10 A9 F3 F4")
def q_weather_feed_json(spark, d):
    """Each region's hour written as one response, the last value of each category in order of arrival; read back and pivoted."""
    rows = tables.weather_long(spark, d).where("category is not null")
    last = (rows.groupBy("region", "fcst_date", "fcst_time", "category")
            .agg(F.max_by(F.struct("seq", "fcst_value"), "seq").alias("v")))
    item = F.struct(F.col("v.seq").alias("seq"), F.col("fcst_date").alias("fcstDate"), F.col("fcst_time").alias("fcstTime"),
                    "category", F.col("v.fcst_value").alias("fcstValue"))
    # a response has one item per category at most
    sent = last.groupBy("region", "fcst_date", "fcst_time").agg(F.sort_array(F.collect_list(item)).alias("items"))
    sent = sent.select("region", F.struct(
        F.struct(F.lit("00").alias("resultCode")).alias("header"),
        F.struct(F.struct(F.col("items").alias("item")).alias("items")).alias("body")).alias("response"))
    path = scratch_path(spark, "weather-feed")
    sent.write.partitionBy("region").json(path)
    raw = spark.read.schema(sent.schema).json(path)
    return weather.weather_pivot(weather.parse_feed_json(raw, "region"))


@query("weather_cache_from_today", f"""WITH {SQL_PIVOT}
SELECT * FROM piv WHERE base_date >= strftime({AED}, '%Y%m%d') ORDER BY region, base_date, base_time""", ops="G1 P23")
def q_weather_from_today(spark, d):
    """Every cached row from today on, by region and time."""
    today = F.date_format(F.lit(AE).cast("date"), "yyyyMMdd")
    return q_external._pivot(spark, d).where(F.col("base_date") >= today).orderBy("region", "base_date", "base_time")


@query("request_weather_tags", f"""WITH {SQL_PIVOT},
t AS (SELECT region, base_date, bool_or(pty_code IN (1, 2, 4)) AS rain, bool_or(pty_code IN (2, 3)) AS snow FROM piv GROUP BY 1, 2)
SELECT region, base_date, CASE WHEN region = 'R1' THEN '눈' || CASE WHEN rain THEN ', 비' ELSE '' END
                               WHEN rain AND snow THEN '비, 눈' WHEN rain THEN '비' WHEN snow THEN '눈' ELSE '' END AS weather_factors
FROM t""", ops="U4")
def q_request_tags(spark, d):
    """Requests of region R1 chose snow; what the feed shows is added."""
    auto = weather.auto_weather_tags(q_external._pivot(spark, d))
    chosen = auto.select("region", "base_date", F.when(F.col("region") == "R1", F.array(F.lit("눈"))).alias("weather_tags"))
    return weather.with_detected_tags(chosen, auto).select("region", "base_date", F.array_join("weather_tags", ", ").alias("weather_factors"))


@query("request_totals", f"""WITH g AS ({ORACLE['forecast_grid']})
SELECT CAST(floor(SUM(CASE WHEN date >= DATE '2001-06-30' THEN q50_daily ELSE 0 END) + 0.5) AS BIGINT) AS predicted_total,
       CAST(SUM(recommended_order_qty) AS BIGINT) AS recommended_total FROM g""", ops="A21")
def q_request_totals(spark, d):
    """Predicted quantity from the request's day on, and all recommended orders."""
    today = F.lit(tables.AS_OF_SALES).cast("date")
    return q_external.q_forecast_grid(spark, d).agg(
        F.floor(F.sum(F.when(F.col("date") >= today, F.col("q50_daily")).otherwise(0)) + 0.5).cast("long").alias("predicted_total"),
        F.sum("recommended_order_qty").cast("long").alias("recommended_total"))


_WEEK = "date BETWEEN DATE '2001-06-30' AND DATE '2001-07-07'"


@query("report_sections", f"""WITH {SQL_ACC}, {SQL_STOCK}, {SQL_WASTE}
SELECT 'daily_sales' AS section, CAST(date AS VARCHAR) AS name, round(SUM(qty), 4) AS a, round(SUM(amount), 4) AS b
FROM sales WHERE {_WEEK} GROUP BY date
UNION ALL SELECT 'stock', product || '/' || status, current_stock, CAST(stock_pct AS DOUBLE) FROM stock
UNION ALL SELECT 'waste', id || '/' || reason, CAST(quantity AS DOUBLE), round(loss, 4) FROM waste WHERE {_WEEK}
UNION ALL SELECT 'forecast_accuracy', CAST(date AS VARCHAR) || '/' || product, predicted_qty, accuracy FROM accv WHERE {_WEEK}""",
       ops="S13 S12")
def q_report_sections(spark, d):
    """All four sections of the report's export for a week, read back from their files."""
    sales = tables.product_day_sales(spark, d)
    waste = reports.waste_view(tables.waste_history(spark, d), tables.product(spark, d))
    acc = accuracy.forecast_accuracy(tables.forecast_results(spark, d), sales)
    paths = sinks.export_report(scratch_path(spark, "report-sections"), sales=sales, stock=_stock(spark, d), waste=waste,
                                accuracy=acc, date_from=tables.AS_OF_SALES)
    said = {"daily_sales": ("date", "quantity", "revenue"), "stock": ("concat(product, '/', status)", "current_stock", "ratio_pct"),
            "waste": ("concat(id, '/', reason)", "quantity", "loss"),
            "forecast_accuracy": ("concat(date, '/', product)", "predicted_qty", "accuracy")}
    out = None
    for name, (key, a, b) in said.items():
        back = spark.read.option("header", True).csv(paths[name]).select(
            F.lit(name).alias("section"), F.expr(key).alias("name"),
            F.round(F.col(a).cast("double"), 4).alias("a"), F.round(F.col(b).cast("double"), 4).alias("b"))
        out = back if out is None else out.unionByName(back)
    return out


_SCORE = "(day(date) * 7 + month(date) * 5) % 101"


@query("event_feature_frame", f"""WITH daily AS (SELECT CAST(l_shipdate AS DATE) AS date, p_type AS item_id,
    CAST(CASE WHEN MAX(l_discount) >= 0.08 THEN 1 ELSE 0 END AS INTEGER) AS promo
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN day(date) % 5 = 0 THEN 0.0 ELSE CAST({_SCORE} AS DOUBLE) END AS score, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS weekend FROM daily)
SELECT date, item_id, score AS event_score_100, CAST(CASE WHEN score > 0 THEN 1 ELSE 0 END AS INTEGER) AS is_event,
       CAST(CASE WHEN score >= 70 THEN 1 ELSE 0 END AS INTEGER) AS major_event_flag, score * weekend AS event_score_x_weekend, score * promo AS event_score_x_promo
FROM s""", ops="P4")
def q_event_frame(spark, d):
    """Daily rows with a score of their date as text, every fifth day without a number: all flags and products occur."""
    score = F.when(F.dayofmonth("date") % 10 == 0, "n/a").when(F.dayofmonth("date") % 5 == 0, None).otherwise(
        ((F.dayofmonth("date") * 7 + F.month("date") * 5) % 101).cast("string"))
    days = common.daily(spark, d).withColumn("event_score_100", score)
    return features.event_features(features.calendar_features(days)).select(
        "date", "item_id", "event_score_100", "is_event", "major_event_flag", "event_score_x_weekend", "event_score_x_promo")


@query("admin_lists", f"""WITH {SQL_BATCHES}, {SQL_FORECASTS}
SELECT 'batch' AS list, CAST(batch_id AS VARCHAR) AS key, received_date AS date, CAST(current_qty AS DOUBLE) AS quantity FROM batches
WHERE product_id = 7 AND received_date >= DATE '1996-01-01'
UNION ALL SELECT 'waste', CAST(l_orderkey * 8 + l_linenumber AS VARCHAR), CAST(l_shipdate AS DATE), l_quantity FROM lineitem
WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND CAST(l_shipdate AS DATE) BETWEEN DATE '1998-02-01' AND DATE '1998-02-28'
UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), CAST(o_orderdate AS DATE), o_totalprice FROM orders
WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AND CAST(o_orderdate AS DATE) <= DATE '1996-12-31'
UNION ALL SELECT 'forecast', product, target_date, predicted_qty FROM forecasts
WHERE forecast_period = 7 AND product = 'PROMO' AND target_date BETWEEN DATE '2000-05-01' AND DATE '2000-06-30'""", ops="P21")
def q_admin_lists(spark, d):
    """The admin filters of batches, waste, orders and forecasts, each by its own columns and dates."""
    key = lambda c: F.col(c).cast("string").alias("key")
    one = lambda kind, df, k, date, qty: df.select(F.lit(kind).alias("list"), key(k), F.col(date).alias("date"), F.col(qty).cast("double").alias("quantity"))
    orders = tables.read(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    batches = views.admin_filter(tables.inventory_batches(spark, d), product_id=7, received_date_from="1996-01-01", supplier_id=None)
    waste = views.admin_filter(tables.waste_history(spark, d), reason="F", waste_date_from="1998-02-01", waste_date_to="1998-02-28")
    orders = views.admin_filter(orders, o_orderstatus="P", o_orderpriority="5-LOW", day_to="1996-12-31")
    runs = views.admin_filter(tables.forecast_results(spark, d), forecast_period=7, product="PROMO", target_date_from="2000-05-01", target_date_to="2000-06-30")
    return (one("batch", batches, "batch_id", "received_date", "current_qty").unionByName(one("waste", waste, "waste_id", "waste_date", "quantity"))
            .unionByName(one("order", orders, "o_orderkey", "day", "o_totalprice")).unionByName(one("forecast", runs, "product", "target_date", "predicted_qty")))


@query("reorder_by_urgency", f"""WITH {SQL_STOCK},
r AS (SELECT product, current_stock, CASE WHEN current_stock / 5.0 <= 2 THEN 'high' WHEN current_stock / 5.0 <= 5 THEN 'medium' ELSE 'low' END AS urgency
      FROM stock WHERE status <> 'high'),
g AS (SELECT product, urgency, CAST(count(*) AS BIGINT) AS lots, min(current_stock) AS least FROM r GROUP BY product, urgency)
SELECT urgency, product, lots, least, row_number() OVER (ORDER BY CASE urgency WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, least, product) AS place
FROM g QUALIFY place <= 100""", ops="T6 I7")
def q_by_urgency(spark, d):
    """Products to reorder in the order of urgency (high, medium, low), not of the words: the first hundred."""
    r = inventory.reorder_list(_stock(spark, d).select("product", "current_stock", "min_stock", "max_stock", "daily_usage"))
    g = r.groupBy("product", "urgency").agg(F.count(F.lit(1)).alias("lots"), F.min("current_stock").alias("least"))
    first = g.orderBy(inventory.urgency_rank("urgency"), "least", "product").limit(100)   # a bounded page
    place = F.row_number().over(Window.orderBy(inventory.urgency_rank("urgency"), "least", "product"))
    return first.select("urgency", "product", "lots", "least", place.cast("long").alias("place"))
