"""Registered queries: list views, run log, search, admin filters, validation, sorted page, M13."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast import tables
from tillcast.operators import features, views
from tillcast.operators.running import global_row_number
from tillcast.plans import common, q_external
from tillcast.plans.common import SQL_DAILY
from tillcast.plans.q_reports import SQL_STOCK, _stock
from tillcast.plans.q_stock import q_order_priority
from tillcast.plans.registry import ORACLE, query

_PRI_SQL = ORACLE["order_priority"]


@query("order_view", f"""WITH pri AS ({_PRI_SQL}),
o AS (SELECT row_number() OVER (ORDER BY date, item_id) AS order_id, date, item_id, recommended_order_qty, expected_total_cost
      FROM pri WHERE recommended_order_qty > 0)
SELECT 'ORD-' || CASE WHEN length(CAST(order_id AS VARCHAR)) < 3 THEN lpad(CAST(order_id AS VARCHAR), 3, '0')
                      ELSE CAST(order_id AS VARCHAR) END AS id,
       date, item_id || ' ' || CAST(recommended_order_qty AS VARCHAR) || '개' AS items, expected_total_cost AS total_amount
FROM o""", ops="P12")
def q_order_view(spark, d):
    pri = q_order_priority(spark, d).where(F.col("recommended_order_qty") > 0)
    # ids follow (date, item) order without a single-partition window
    o = global_row_number(pri, ["date", "item_id"], "order_id")
    return views.order_view(o.select("order_id", F.col("date").alias("created"), F.col("item_id").alias("product"),
                                     F.col("recommended_order_qty").alias("qty"), F.col("expected_total_cost").alias("cost")))


_TAGS_SQL = ORACLE["tag_weights"]


@query("run_log_view", f"""WITH t AS ({_TAGS_SQL})
SELECT region, base_date AS run_ts, COALESCE(NULLIF(trim(weather_factors), ''), '선택 안함') AS weather,
       COALESCE(NULLIF(trim(event_factors), ''), '선택 안함') AS events, impact_summary, weight_pct AS value,
       lag(weight_pct) OVER (PARTITION BY region ORDER BY base_date) AS prev_value,
       weight_pct - lag(weight_pct) OVER (PARTITION BY region ORDER BY base_date) AS change
FROM t""", ops="P15 L1 W15")
def q_run_log(spark, d):
    runs = q_external.q_tag_weights(spark, d).withColumnRenamed("base_date", "run_ts")
    return views.run_log_view(runs)


@query("region_search", """
SELECT n_nationkey, n_name FROM nation WHERE contains(regexp_replace(n_name, '\\s+', '', 'g'), 'NATION_1')
ORDER BY n_name LIMIT 50""", ops="P20")
def q_region_search(spark, d):
    n = tables.read(spark, d, "nation").select("n_nationkey", "n_name")
    return views.search_names(n, "n_name", "NATION _1")


@query("admin_sales_filter", """
SELECT l_orderkey * 8 + l_linenumber AS line_id, CAST(l_shipdate AS DATE) AS date, p_type AS category, n_name AS region,
       l_quantity AS qty
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE l_returnflag <> 'R' AND p_type = 'PROMO' AND n_name = 'NATION_3'
  AND CAST(l_shipdate AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'""", ops="P21 P9")
def q_admin_filter(spark, d):
    s = tables.sales_lines(spark, d).where(~F.col("is_return"))
    sup = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier_id"), "s_nationkey")
    nat = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("region"))
    j = s.join(sup, "supplier_id").join(nat, "s_nationkey")
    f = views.admin_filter(j, category="PROMO", region="NATION_3", date_from="2000-01-01", date_to="2000-12-31")
    return f.select("line_id", "date", "category", "region", "qty")


@query("waste_validation", """
SELECT l_orderkey * 8 + l_linenumber AS waste_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
       l_linestatus AS reason,
       CASE WHEN l_partkey IS NULL THEN 'missing product'
            WHEN l_quantity IS NULL OR l_quantity = 0 THEN 'missing quantity'
            WHEN l_linestatus IS NULL OR trim(l_linestatus) = '' THEN 'missing reason' END AS reject_reason,
       NOT (l_partkey IS NULL OR l_quantity IS NULL OR l_quantity = 0 OR l_linestatus IS NULL OR trim(l_linestatus) = '') AS accepted
FROM lineitem WHERE l_returnflag = 'R'""", ops="P25")
def q_waste_validation(spark, d):
    w = tables.waste_history(spark, d).select("waste_id", "product_id", "quantity", "reason")
    return views.validate_waste(w)


@query("inventory_page", f"""WITH {SQL_STOCK}
SELECT batch_id, product, stock_pct, status FROM stock ORDER BY stock_pct, product, batch_id""", ops="T5 T7")
def q_inventory_page(spark, d):
    st = _stock(spark, d).select("batch_id", "product", "stock_pct", "status")
    return views.sort_page(st, ["stock_pct", "product", "batch_id"], collation="ko", text_cols=("product",))


@query("sequence_standardized", f"""WITH {SQL_DAILY},
l AS (SELECT item_id, date, list(demand_qty) OVER (PARTITION BY item_id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS l FROM daily),
w AS (SELECT item_id, date, CAST(unnest(range(14)) AS INTEGER) AS step, unnest(l) AS v FROM l WHERE len(l) = 14),
s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM w)
SELECT item_id, date, step, round((v - m) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END, 4) AS z FROM w, s""", ops="M13 W10")
def q_seq_std(spark, d):
    seq = features.sequence_windows(common.daily(spark, d), ["demand_qty"], timesteps=14)
    z = features.standardize_sequences(seq, 1)
    return z.select("item_id", "date", F.posexplode("window").alias("step", "v")).select(
        "item_id", "date", "step", F.round(F.col("v")[0], 4).alias("z"))


@query("inventory_validation", """
SELECT l_orderkey * 8 + l_linenumber AS batch_id, l_partkey AS product_id, CAST(l_shipdate AS DATE) AS received_date,
       CAST(l_quantity AS BIGINT) AS current_qty,
       CASE WHEN l_partkey IS NULL THEN 'missing product_id'
            WHEN l_shipdate IS NULL THEN 'missing received_date'
            WHEN l_quantity IS NULL THEN 'missing current_qty'
            WHEN l_linestatus IS NULL OR trim(l_linestatus) = '' THEN 'missing status' END AS reject_reason,
       NOT (l_partkey IS NULL OR l_shipdate IS NULL OR l_quantity IS NULL OR l_linestatus IS NULL OR trim(l_linestatus) = '')
         AS accepted
FROM lineitem WHERE l_returnflag <> 'R'""", ops="P25")
def q_inventory_validation(spark, d):
    """P25: incoming stock rows need every required field present and non-blank."""
    li = tables.read(spark, d, "lineitem").where(F.col("l_returnflag") != "R").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("batch_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").cast("date").alias("received_date"), F.col("l_quantity").cast("long").alias("current_qty"),
        F.col("l_linestatus").alias("status"))
    v = views.validate_inventory(li, ["product_id", "received_date", "current_qty", "status"])
    return v.drop("status")
