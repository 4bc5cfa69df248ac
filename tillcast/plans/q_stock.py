"""Registered queries: FEFO stock operators and the replenishment policy over history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast import tables
from tillcast.functions.stats import inv_norm_cdf_sql
from tillcast.operators import fefo, features, forecast, inventory
from tillcast.plans import common
from tillcast.plans.common import SQL_RAW, sql_roll
from tillcast.plans.registry import query
from tillcast.plans.sqlgen import fefo_fold_sql

SQL_BATCHES = """batches AS (
  SELECT l_orderkey * 8 + l_linenumber AS batch_id, l_partkey AS product_id, CAST(l_shipdate AS DATE) AS received_date,
         CAST(l_shipdate AS DATE) + p_size AS expiration_date, CAST(l_quantity AS BIGINT) AS current_qty,
         l_suppkey AS supplier_id, CAST(l_quantity AS BIGINT) AS received_qty, l_extendedprice AS line_price
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R')"""


@query("fefo_deduction", f"""WITH {SQL_BATCHES},
w AS (SELECT l_partkey AS product_id, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w FROM lineitem
      WHERE l_returnflag = 'R' GROUP BY 1),
p AS (SELECT b.*, COALESCE(SUM(current_qty) OVER (PARTITION BY product_id ORDER BY expiration_date, batch_id, supplier_id, received_qty, line_price, received_date
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
      FROM batches b WHERE current_qty > 0),
d AS (SELECT p.batch_id, p.product_id, p.supplier_id, p.received_qty, p.line_price, p.received_date,
             p.expiration_date, p.current_qty,
             CAST(greatest(0, least(p.current_qty, COALESCE(w.w, 0) - p.prev)) AS BIGINT) AS deducted
      FROM p LEFT JOIN w USING (product_id)
      UNION ALL
      SELECT batch_id, product_id, supplier_id, received_qty, line_price, received_date, expiration_date, current_qty,
             CAST(0 AS BIGINT) FROM batches WHERE NOT (current_qty > 0))
SELECT batch_id, product_id, expiration_date, current_qty, deducted, current_qty - deducted AS new_qty FROM d""", ops="W13 I9")
def q_fefo_deduction(spark, d):
    b = tables.inventory_batches(spark, d)
    w = tables.waste_history(spark, d)
    return fefo.fefo_deduction(b, w, tiebreak=tables.BATCH_TIEBREAK).select(
        "batch_id", "product_id", "expiration_date", "current_qty", "deducted", "new_qty")


def _sql_fefo_per_product(h: int) -> str:
    fold, last = fefo_fold_sql("fin", h)
    return f"""WITH {SQL_BATCHES},
pd AS (SELECT CAST(l_shipdate AS DATE) AS date, l_partkey AS product_id, SUM(l_quantity) AS q
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY 1, 2),
asofd AS (SELECT max(date) AS as_of FROM pd),
tail AS (SELECT product_id, q, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS rn FROM pd),
nq AS (SELECT product_id, avg(q) AS q50 FROM tail WHERE rn <= 7 GROUP BY 1),
lots AS (SELECT product_id, least(greatest(date_diff('day', a.as_of, expiration_date), 0), {h}) AS b, current_qty AS q
         FROM batches, asofd a WHERE received_date <= a.as_of AND expiration_date >= a.as_of AND current_qty > 0),
lb AS (SELECT product_id, {', '.join(f'CAST(COALESCE(SUM(CASE WHEN b = {k} THEN q END), 0) AS BIGINT) AS b{k}' for k in range(h + 1))}
       FROM lots GROUP BY 1),
fin AS (SELECT n.product_id AS item_id, {', '.join(f'COALESCE(lb.b{k}, 0) AS b{k}' for k in range(h + 1))},
        {', '.join(f'CAST(greatest(round_even(n.q50, 0), 0) AS BIGINT) AS d{j}' for j in range(h))}
        FROM nq n LEFT JOIN lb USING (product_id)),
{fold}
SELECT item_id AS product_id, w AS expected_waste_qty, f AS expected_sales_fulfilled_qty, l AS expected_lost_sales_qty
FROM {last}"""


@query("fefo_expected_waste", _sql_fefo_per_product(7), ops="I6")
def q_fefo_expected_waste(spark, d):
    s = tables.product_day_sales(spark, d).select("date", F.col("product_id").alias("item_id"), F.col("qty").alias("demand_qty"))
    q = forecast.naive_quantiles(s)
    paths = q.select("item_id", forecast.flat_path("q50_daily", 7).alias("path"))
    b = tables.inventory_batches(spark, d)
    as_of = s.agg(F.max("date")).scalar()
    lots = (b.withColumn("as_of", as_of)
             .where((F.col("received_date") <= F.col("as_of")) & (F.col("expiration_date") >= F.col("as_of")))
             .select(F.col("product_id").alias("item_id"), F.col("current_qty").alias("qty"),
                     F.datediff("expiration_date", "as_of").alias("days_to_expire")))
    res = fefo.fefo_expected_waste(paths, lots, path_col="path", horizon=7)
    return res.select(F.col("item_id").alias("product_id"), "expected_waste_qty", "expected_sales_fulfilled_qty",
                      "expected_lost_sales_qty")


@query("order_priority", f"""WITH {SQL_RAW},
f AS (SELECT date, item_id, current_inventory,
             {sql_roll('demand_qty', 7, 1, 'avg', 7)} AS q50,
             {sql_roll('demand_qty', 7, 1, 'stddev_samp', 7)} AS sd FROM raw),
g AS (SELECT *, q50 + 1.645 * sd AS q95, 1500.0 / (1500.0 + 180.0) AS sl FROM f WHERE q50 IS NOT NULL),
t AS (SELECT *, greatest(0.0, q50 * 4 + {inv_norm_cdf_sql('least(greatest(sl, 0.0001), 0.9999)')}
                 * greatest(0.0, greatest(0.0, (q95 - q50) / 1.645) * sqrt(4.0))) AS target FROM g),
o AS (SELECT date, item_id, current_inventory, round(target, 2) AS target_stock,
             CASE WHEN greatest(0.0, target - current_inventory) <= 0 THEN 0
                  ELSE CAST(ceil(greatest(0.0, target - current_inventory) / 5) * 5 AS INTEGER) END AS recommended_order_qty
      FROM t)
SELECT *, CASE WHEN target_stock <= 0 THEN '여유' WHEN current_inventory / target_stock < 0.3 THEN '필수'
               WHEN current_inventory / target_stock < 0.7 THEN '권장' ELSE '여유' END AS priority,
       round(recommended_order_qty * 951.0::DOUBLE, 4) AS expected_total_cost
FROM o""", ops="I1 I2 I3 I4 I5 F15")
def q_order_priority(spark, d):
    raw = common.raw(spark, d)
    f = features.rolling_features(raw, windows=(7,), trend=28).where(F.col("roll_mean_7").isNotNull())
    f = f.withColumns({"q50_daily": F.col("roll_mean_7"), "q95_daily": F.col("roll_mean_7") + 1.645 * F.col("roll_std_7")})
    o = inventory.optimal_order(f)
    o = o.withColumn("priority", inventory.order_priority("current_inventory", "target_stock"))
    return o.select("date", "item_id", "current_inventory", "target_stock", "recommended_order_qty", "priority",
                    F.round(inventory.expected_cost("recommended_order_qty", F.lit(951.0)), 4).alias("expected_total_cost"))
