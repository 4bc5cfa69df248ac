"""Registered queries: sales / stock / waste / forecast reports and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast import fixed, tables
from tillcast.operators import accuracy, fefo, inventory, reports
from tillcast.plans.registry import query

A = tables.AS_OF_SALES
AD = f"DATE '{A}'"


def _sales(spark, d):
    """Sales pre-aggregated per (date, product) before the product join (sums and line counts only)."""
    return tables.product_day_sales(spark, d)


def _sales_rows(spark, d):
    return tables.sales_lines(spark, d).where(~F.col("is_return"))


def _stock(spark, d):
    return reports.stock_view(tables.inventory_batches(spark, d), tables.product(spark, d))


SQL_SALES = """sales AS (
  SELECT l_orderkey * 8 + l_linenumber AS line_id, CAST(l_shipdate AS DATE) AS date, l_partkey AS product_id,
         p_type AS item_id, p_brand AS menu, p_type AS category, p_name AS product_name, l_quantity AS qty,
         l_extendedprice * (1 - l_discount) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R')"""

SQL_FORECASTS = """fdaily AS (
  SELECT CAST(l_shipdate AS DATE) AS date, p_type AS product, SUM(l_quantity) AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY 1, 2),
fc AS (
  SELECT date AS target_date, product, lag(q, 7) OVER (PARTITION BY product ORDER BY date) AS predicted_qty,
         date - 7 AS created_at, 7 AS forecast_period FROM fdaily
  UNION ALL
  SELECT date AS target_date, product, lag(q, 1) OVER (PARTITION BY product ORDER BY date) AS predicted_qty,
         date - 1 AS created_at, 1 AS forecast_period FROM fdaily),
forecasts AS (SELECT * FROM fc WHERE predicted_qty IS NOT NULL),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_date, product ORDER BY created_at DESC) AS rn
                          FROM forecasts) WHERE rn = 1)"""

SQL_STOCK = """stock AS (
  SELECT l_orderkey * 8 + l_linenumber AS batch_id, p_name AS product, p_type AS category,
         CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS current_stock, 10.0::DOUBLE AS min_stock, 50.0::DOUBLE AS max_stock,
         5.0::DOUBLE AS daily_usage, p_retailprice AS unit_price,
         CAST(floor(CAST(l_quantity AS BIGINT) / 50.0 * 100 + 0.5) AS BIGINT) AS stock_pct,
         CASE WHEN CAST(l_quantity AS BIGINT) < 10 THEN 'low'
              WHEN floor(CAST(l_quantity AS BIGINT) / 50.0 * 100 + 0.5) > 100 THEN 'high' ELSE 'normal' END AS status,
         CAST(l_shipdate AS DATE) + p_size AS expiration_date
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R')"""

SQL_WASTE = """waste AS (
  SELECT 'WST-' || CASE WHEN length(CAST(l_orderkey * 8 + l_linenumber AS VARCHAR)) < 3
                        THEN lpad(CAST(l_orderkey * 8 + l_linenumber AS VARCHAR), 3, '0')
                        ELSE CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) END AS id, CAST(l_shipdate AS DATE) AS date,
         COALESCE(p_name, '상품') AS product, COALESCE(p_type, '기타') AS category, CAST(l_quantity AS BIGINT) AS quantity,
         COALESCE(l_linestatus, '기타') AS reason, COALESCE(p_retailprice, 0.0) * CAST(l_quantity AS BIGINT) AS loss
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')"""


def _half_up_pct(cur: str, base: str) -> str:
    return f"CASE WHEN {base} > 0 THEN floor(({cur} - {base}) / {base} * 1000 + 0.5) / 10 ELSE 0.0 END"


# ------------------------------------------------------------------ sales
@query("sales_view", f"""WITH {SQL_SALES}
SELECT 'TX-' || CAST(line_id AS VARCHAR) AS id, date, menu, category, qty AS quantity,
       CASE WHEN amount <> 0 THEN floor(amount / COALESCE(NULLIF(qty, 0.0), 1.0) + 0.5) ELSE 0.0 END AS unit_price,
       round(amount, 4) AS amount FROM sales""", ops="P11 F9")
def q_sales_view(spark, d):
    v = reports.sales_view(_sales_rows(spark, d))
    return v.withColumn("amount", F.round("amount", 4))


@query("category_month_summary", f"""WITH {SQL_SALES}
SELECT strftime(date, '%Y%m') AS month, category, SUM(qty) AS total_qty, round(SUM(amount), 4) AS total_sales
FROM sales GROUP BY 1, 2""", ops="A3 R12 P9")
def q_category_month(spark, d):
    s = reports.month_category_summary(_sales(spark, d))
    return s.withColumn("total_sales", F.round("total_sales", 4))


@query("month_over_month", f"""WITH {SQL_SALES},
m AS (SELECT round(COALESCE(SUM(CASE WHEN date >= date_trunc('month', {AD}) THEN amount END), 0.0), 4) AS this_month,
             round(COALESCE(SUM(CASE WHEN date < date_trunc('month', {AD}) THEN amount END), 0.0), 4) AS last_month
      FROM sales WHERE date >= date_trunc('month', {AD}) - INTERVAL 1 MONTH AND date <= {AD})
SELECT round(this_month, 4) AS this_month, round(last_month, 4) AS last_month,
       {_half_up_pct('this_month', 'last_month')} AS change_pct FROM m""", ops="A11 F8")
def q_mom(spark, d):
    m = reports.month_over_month(_sales(spark, d), A)
    return m.select(F.round("this_month", 4).alias("this_month"), F.round("last_month", 4).alias("last_month"), "change_pct")


def _sql_series(days: int) -> str:
    return f"""WITH {SQL_SALES},
spine AS (SELECT CAST(unnest(generate_series({AD} - {days - 1}, {AD}, INTERVAL 1 DAY)) AS DATE) AS date),
per AS (SELECT date, SUM(qty) AS sales FROM sales WHERE date BETWEEN {AD} - {days - 1} AND {AD} GROUP BY date)
SELECT s.date, strftime(s.date, '%-m/%-d') AS label, COALESCE(per.sales, 0.0) AS sales, s.date = {AD} AS is_today
FROM spine s LEFT JOIN per USING (date)"""


@query("daily_series_7d", _sql_series(7), ops="A12 J7 F16")
def q_series7(spark, d):
    return reports.daily_series(_sales(spark, d), A, 7)


@query("daily_series_30d", _sql_series(30), ops="A12 J7 F16")
def q_series30(spark, d):
    return reports.daily_series(_sales(spark, d), A, 30)


@query("sales_report_top_products", f"""WITH {SQL_SALES},
agg AS (SELECT menu, SUM(CASE WHEN date > {AD} - 30 THEN qty END) AS sales,
               SUM(CASE WHEN date > {AD} - 30 THEN amount END) AS revenue,
               COALESCE(SUM(CASE WHEN date <= {AD} - 30 THEN qty END), 0.0) AS prev_sales
        FROM sales WHERE date > {AD} - 60 AND date <= {AD} GROUP BY menu),
top AS (SELECT * FROM agg WHERE sales IS NOT NULL ORDER BY sales DESC, menu LIMIT 5)
SELECT CAST(row_number() OVER (ORDER BY sales DESC, menu) AS INTEGER) AS rank, menu AS name, sales, round(revenue, 4) AS revenue,
       prev_sales, CASE WHEN sales > prev_sales * 1.05 THEN 'up' WHEN sales < prev_sales * 0.95 THEN 'down' ELSE 'stable' END AS trend
FROM top""", ops="T2 W11 A13 R5 J10")
def q_top_products(spark, d):
    t = reports.top_products(_sales(spark, d), A)
    return t.withColumn("revenue", F.round("revenue", 4))


@query("category_share", f"""WITH {SQL_SALES},
per AS (SELECT category AS name, round(SUM(amount), 4) AS amount FROM sales
        WHERE date >= date_trunc('month', {AD}) AND date <= {AD} GROUP BY 1)
SELECT name, round(amount, 4) AS amount,
       CASE WHEN SUM(amount) OVER () > 0 THEN floor(amount / SUM(amount) OVER () * 1000 + 0.5) / 10 ELSE 0.0 END AS value
FROM per""", ops="A14 R5")
def q_category_share(spark, d):
    c = reports.category_share(_sales(spark, d), A)
    return c.select("name", F.round("amount", 4).alias("amount"), "value")


# -------------------------------------------------------------- forecasts
@query("latest_forecast", f"""WITH {SQL_FORECASTS}
SELECT target_date AS date, round(SUM(COALESCE(predicted_qty, 0.0)), 4) AS predicted FROM latest GROUP BY 1""",
       ops="W12 A18")
def q_latest_forecast(spark, d):
    t = reports.forecast_day_totals(tables.forecast_results(spark, d))
    return t.withColumn("predicted", F.round("predicted", 4))


@query("forecast_view", f"""WITH {SQL_FORECASTS}
SELECT target_date AS date, product, predicted_qty,
       product || ' ' || regexp_replace(CAST(predicted_qty AS VARCHAR), '\\.0$', '') || '개' AS predicted
FROM forecasts""", ops="P14 J3")
def q_forecast_view(spark, d):
    return reports.forecast_view(tables.forecast_results(spark, d)).drop("forecast_id")


@query("upcoming_forecast_total", f"""WITH {SQL_FORECASTS}
SELECT target_date AS date, SUM(predicted_qty) AS predicted_total FROM latest WHERE target_date >= {AD} GROUP BY 1""",
       ops="P24 A21")
def q_upcoming(spark, d):
    return reports.upcoming_forecast_total(tables.forecast_results(spark, d), A)


# ------------------------------------------------------------------ stock
@query("stock_status", f"""WITH {SQL_STOCK}
SELECT batch_id, product, category, current_stock, stock_pct, status FROM stock""", ops="P10 P17 J3")
def q_stock_status(spark, d):
    return _stock(spark, d).select("batch_id", "product", "category", "current_stock", "stock_pct", "status")


@query("inventory_counts", f"""WITH {SQL_STOCK}
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'low') AS low, count(*) FILTER (WHERE status = 'high') AS high
FROM stock""", ops="A17")
def q_inventory_counts(spark, d):
    return reports.inventory_counts(_stock(spark, d))


@query("low_stock_alert", f"""WITH {SQL_STOCK}
SELECT batch_id, product, current_stock,
       '- ' || product || ' (현재: ' || regexp_replace(CAST(current_stock AS VARCHAR), '\\.0$', '') || '개)' AS line
FROM stock WHERE current_stock < min_stock""", ops="R3 P18 A22")
def q_low_stock(spark, d):
    st = _stock(spark, d)
    return reports.low_stock_alerts(st).select("batch_id", "product", "current_stock", "line")


@query("inventory_search", f"""WITH {SQL_STOCK}
SELECT batch_id, product, category, current_stock FROM stock
WHERE contains(lower(product), 'ring') OR contains(lower(category), 'ring')""", ops="P19")
def q_inventory_search(spark, d):
    return reports.inventory_search(_stock(spark, d), "Ring", fixed.ALL_CATEGORIES).select(
        "batch_id", "product", "category", "current_stock")


@query("reorder_list", f"""WITH {SQL_STOCK},
r AS (SELECT batch_id, product, current_stock, daily_usage,
             CASE WHEN daily_usage > 0 THEN current_stock / daily_usage ELSE 999.0 END AS days_left
      FROM stock WHERE status <> 'high' ORDER BY days_left, batch_id LIMIT 6)
SELECT batch_id, product, current_stock, daily_usage, days_left,
       CASE WHEN days_left <= 2 THEN 'high' WHEN days_left <= 5 THEN 'medium' ELSE 'low' END AS urgency,
       greatest(CAST(10 AS BIGINT), CAST(ceil(daily_usage * 14 - current_stock) AS BIGINT)) AS suggested_qty
FROM r""", ops="I7 T3 T6 F14")
def q_reorder(spark, d):
    st = _stock(spark, d).select("batch_id", "product", "current_stock", "min_stock", "max_stock", "daily_usage")
    r = inventory.reorder_list(st)
    return (r.orderBy("days_left", "batch_id").limit(6)
             .select("batch_id", "product", "current_stock", "daily_usage", "days_left", "urgency", "suggested_qty"))


@query("expiring_batches", f"""WITH {SQL_STOCK}
SELECT batch_id, product, current_stock AS quantity, expiration_date,
       CAST(date_diff('day', {AD}, expiration_date) AS INTEGER) AS days_left, unit_price * current_stock AS value_at_risk
FROM stock WHERE date_diff('day', {AD}, expiration_date) BETWEEN 0 AND 3""", ops="P16 F7 J3")
def q_expiring(spark, d):
    e = fefo.expiring_batches(tables.inventory_batches(spark, d), tables.product(spark, d), A)
    return e.select("batch_id", "product", F.col("current_qty").cast("double").alias("quantity"), "expiration_date",
                    "days_left", "value_at_risk")


@query("expiring_counts", f"""WITH {SQL_STOCK},
e AS (SELECT date_diff('day', {AD}, expiration_date) AS days_left FROM stock
      WHERE date_diff('day', {AD}, expiration_date) BETWEEN 0 AND 3)
SELECT count(*) AS expiring_count, count(*) FILTER (WHERE days_left <= 1) AS today_expiring_count FROM e""",
       ops="A16 R6")
def q_expiring_counts(spark, d):
    e = fefo.expiring_batches(tables.inventory_batches(spark, d), tables.product(spark, d), A)
    return e.agg(F.count(F.lit(1)).alias("expiring_count"), F.count_if(F.col("days_left") <= 1).alias("today_expiring_count"))


# ------------------------------------------------------------------ waste
@query("waste_report", f"""WITH {SQL_WASTE} SELECT * FROM waste""", ops="P13 R6 J3")
def q_waste_report(spark, d):
    return reports.waste_view(tables.waste_history(spark, d), tables.product(spark, d))


@query("waste_weekly", f"""WITH {SQL_WASTE},
w AS (SELECT round(COALESCE(SUM(CASE WHEN date >= {AD} - 7 THEN loss END), 0.0), 2) AS weekly_cost,
             round(COALESCE(SUM(CASE WHEN date < {AD} - 7 THEN loss END), 0.0), 2) AS prev_weekly_cost
      FROM waste WHERE date >= {AD} - 14 AND date <= {AD})
SELECT round(weekly_cost, 4) AS weekly_cost, round(prev_weekly_cost, 4) AS prev_weekly_cost,
       {_half_up_pct('weekly_cost', 'prev_weekly_cost')} AS change_pct FROM w""", ops="A15 R6 F8")
def q_waste_weekly(spark, d):
    w = reports.waste_weekly(reports.waste_view(tables.waste_history(spark, d), tables.product(spark, d)), A)
    return w.select(F.round("weekly_cost", 4).alias("weekly_cost"), F.round("prev_weekly_cost", 4).alias("prev_weekly_cost"),
                    "change_pct")


# -------------------------------------------------------------- dashboard
@query("dashboard_kpis", f"""WITH {SQL_SALES}, {SQL_FORECASTS}, {SQL_STOCK},
s AS (SELECT COALESCE(SUM(CASE WHEN date = {AD} THEN qty END), 0.0) AS today_qty,
             COALESCE(SUM(CASE WHEN date = {AD} - 1 THEN qty END), 0.0) AS yesterday_qty,
             COALESCE(SUM(CASE WHEN date < {AD} THEN qty END), 0.0) AS last7_qty
      FROM sales WHERE date >= {AD} - 7 AND date <= {AD}),
p AS (SELECT CAST(floor(COALESCE(SUM(predicted_qty), 0.0) + 0.5) AS BIGINT) AS predicted_today FROM latest WHERE target_date = {AD}),
l AS (SELECT count(*) FILTER (WHERE status = 'low') AS low_stock FROM stock),
e AS (SELECT count(*) AS expiring_count FROM stock WHERE date_diff('day', {AD}, expiration_date) BETWEEN 0 AND 3)
SELECT today_qty, yesterday_qty, last7_qty, predicted_today, low_stock, expiring_count,
       {_half_up_pct('today_qty', 'yesterday_qty')} AS day_over_day_pct
FROM s, p, l, e""", ops="R1 A7 A8 A18 P16 P18")
def q_dashboard(spark, d):
    # two passes over the lines: one for sales and forecasts, one for both counts of the stock
    sales = tables.day_product_grid(spark, d)
    stock = reports.stock_view(tables.inventory_batches(spark, d), tables.product(spark, d), extra=("expiration_date",))
    return accuracy.dashboard_kpis(sales, tables.forecast_results(spark, d, sales), stock, A)


@query("actual_vs_predicted", f"""WITH {SQL_SALES}, {SQL_FORECASTS},
spine AS (SELECT CAST(unnest(generate_series({AD} - 7, {AD} + 2, INTERVAL 1 DAY)) AS DATE) AS date),
act AS (SELECT date, SUM(qty) AS actual FROM sales WHERE date BETWEEN {AD} - 7 AND {AD} GROUP BY 1),
pred AS (SELECT target_date AS date, SUM(COALESCE(predicted_qty, 0.0)) AS predicted FROM latest
         WHERE target_date BETWEEN {AD} - 7 AND {AD} + 2 GROUP BY 1)
SELECT s.date, strftime(s.date, '%-m/%-d') AS label,
       CASE WHEN s.date > {AD} THEN NULL ELSE COALESCE(act.actual, 0.0) END AS actual,
       CAST(CASE WHEN s.date >= {AD} THEN floor(COALESCE(pred.predicted, 0.0) + 0.5)
            WHEN pred.predicted > 0 THEN floor(pred.predicted + 0.5) END AS BIGINT) AS predicted,
       s.date = {AD} AS is_today
FROM spine s LEFT JOIN act USING (date) LEFT JOIN pred USING (date)""", ops="R2 J7 U8")
def q_actual_vs_predicted(spark, d):
    sales = tables.day_product_grid(spark, d)
    return accuracy.actual_vs_predicted(sales, tables.forecast_results(spark, d, sales), A)


# --------------------------------------------------------------- accuracy
SQL_ACC = f"""{SQL_SALES}, {SQL_FORECASTS},
act AS (SELECT date, item_id AS product, SUM(qty) AS actual FROM sales GROUP BY 1, 2),
acc AS (SELECT l.target_date AS date, l.product, l.predicted_qty, COALESCE(a.actual, 0.0) AS actual
        FROM latest l LEFT JOIN act a ON a.date = l.target_date AND a.product = l.product),
accv AS (SELECT *, CASE WHEN predicted_qty > 0
                   THEN greatest(0.0, least(100.0, floor((100 - abs(predicted_qty - actual) / predicted_qty * 100) * 10 + 0.5) / 10))
                   WHEN actual = 0 THEN 100.0 ELSE 0.0 END AS accuracy FROM acc)"""


@query("forecast_accuracy", f"""WITH {SQL_ACC}
SELECT date, product, predicted_qty, actual, accuracy FROM accv""", ops="R7 J4")
def q_forecast_accuracy(spark, d):
    return accuracy.forecast_accuracy(tables.forecast_results(spark, d), _sales(spark, d)).select(
        "date", "product", "predicted_qty", "actual", "accuracy")


SQL_TREND = f"""spine AS (SELECT CAST(unnest(generate_series({AD} - 6, {AD}, INTERVAL 1 DAY)) AS DATE) AS date),
tr AS (SELECT s.date, strftime(s.date, '%-m/%-d') AS label,
              floor(sum(round(a.accuracy * 10)) / count(a.accuracy) + 0.5) / 10 AS accuracy,
              s.date = {AD} AS is_today
       FROM spine s LEFT JOIN accv a ON a.date = s.date GROUP BY s.date)"""


@query("daily_accuracy_trend", f"""WITH {SQL_ACC}, {SQL_TREND}
SELECT * FROM tr""", ops="R9 J7")
def q_accuracy_trend(spark, d):
    acc = accuracy.forecast_accuracy(tables.forecast_results(spark, d), _sales(spark, d))
    return accuracy.daily_accuracy_trend(acc, A)


SQL_VOLUME = f"""vol AS (
  SELECT menu AS name, SUM(qty) AS qty, count(*) AS runs FROM sales WHERE date > {AD} - 30 AND date <= {AD}
  GROUP BY 1 HAVING SUM(qty) > 50 ORDER BY qty DESC, name LIMIT 5),
vs AS (SELECT name, qty, floor(least(95.0, 80 + log2(qty) * 1.4) * 10 + 0.5) / 10 AS volume_score,
              least(runs, 50) AS predictions FROM vol)"""


@query("volume_score", f"""WITH {SQL_SALES}, {SQL_VOLUME}
SELECT * FROM vs""", ops="R10 A19 T4 T7")
def q_volume(spark, d):
    return accuracy.volume_score(_sales(spark, d), A)


@query("insight_rules", f"""WITH {SQL_ACC}, {SQL_TREND}, {SQL_VOLUME},
m AS (SELECT floor(sum(round(accuracy * 10)) / count(accuracy) + 0.5) / 10 AS mean_acc FROM accv),
f AS (SELECT arg_min(accuracy, date) AS first_acc FROM tr WHERE accuracy IS NOT NULL),
t AS (SELECT arg_max(name, qty) AS top_name, arg_max(volume_score, qty) AS top_score FROM vs)
SELECT 1 AS n, CASE WHEN mean_acc >= 85 THEN 'success' ELSE 'info' END AS type,
       CASE WHEN mean_acc >= 85 THEN 'demand accuracy stable' ELSE 'demand accuracy baseline' END AS title, mean_acc AS value FROM m
UNION ALL
SELECT 2, CASE WHEN first_acc < 88 THEN 'warning' ELSE 'success' END,
       CASE WHEN first_acc < 88 THEN 'short-term accuracy drop' ELSE 'recent accuracy good' END, first_acc FROM f
UNION ALL
SELECT 3, 'info', COALESCE(top_name, 'no item yet'), top_score FROM t""", ops="R11")
def q_insights(spark, d):
    sales = tables.day_product_grid(spark, d)  # one pass over the lines for all three inputs
    acc = accuracy.forecast_accuracy(tables.forecast_results(spark, d, sales), sales)
    trend = accuracy.daily_accuracy_trend(acc, A)
    vol = accuracy.volume_score(sales, A)
    return accuracy.insight_rules(acc, trend, vol)


@query("run_accuracy", f"""WITH {SQL_ACC},
r AS (SELECT product, predicted_qty, actual,
             CASE WHEN actual > 0 THEN greatest(0.0, 100 - floor(abs(actual - predicted_qty) / actual * 100 + 0.5)) END AS run_accuracy
      FROM acc WHERE date = {AD})
SELECT *, CASE WHEN run_accuracy >= 90 THEN 'accurate' WHEN run_accuracy >= 70 THEN 'warning'
               WHEN run_accuracy IS NOT NULL THEN 'inaccurate' END AS status FROM r""", ops="R8")
def q_run_accuracy(spark, d):
    acc = accuracy.forecast_accuracy(tables.forecast_results(spark, d), _sales(spark, d)).where(
        F.col("date") == F.lit(A).cast("date"))
    ra, st = accuracy.run_accuracy("predicted_qty", "actual")
    return acc.select("product", "predicted_qty", "actual", ra.alias("run_accuracy"), st.alias("status"))
