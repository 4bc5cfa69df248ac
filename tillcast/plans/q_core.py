"""Registered queries: ingest, daily demand, features, splits, baseline plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast import fixed, tables
from tillcast.functions.stats import inv_norm_cdf_sql
from tillcast.operators import demand, features, forecast
from tillcast.plans import common, order_plan
from tillcast.operators import splits
from tillcast.plans.common import SQL_DAILY, SQL_RAW, sql_lag, sql_roll
from tillcast.plans.registry import query
from tillcast.plans.sqlgen import fefo_fold_sql
from tillcast.sources import pos


def _r(cols, n=4):
    return [F.round(c, n).alias(c) for c in cols]


# --------------------------------------------------------------- ingest
@query("daily_demand", f"""WITH {SQL_DAILY}
SELECT date, item_id, round(demand_qty, 4) AS demand_qty, round(sales_amount, 4) AS sales_amount, promo FROM daily""",
       ops="A1 S9")
def q_daily_demand(spark, d):
    dd = common.daily(spark, d)
    return dd.select("date", "item_id", F.round("demand_qty", 4).alias("demand_qty"),
                     F.round("sales_amount", 4).alias("sales_amount"), F.col("promo").cast("int").alias("promo"))


_SQL_POS_PROMO = """
SELECT CAST(l_shipdate AS DATE) AS date, p_type || '-' || p_brand AS item_id,
       round(CAST(SUM(l_quantity) AS DOUBLE), 4) AS demand_qty,
       round(CAST(SUM(l_extendedprice * (1 - l_discount)) AS DOUBLE), 4) AS sales_amount
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_returnflag <> 'R' AND p_type = 'PROMO'
GROUP BY 1, 2"""


@query("daily_demand_strict", _SQL_POS_PROMO, ops="S1 A1")
def q_daily_demand_strict(spark, d):
    rows = tables.pos_rows(spark, d, text_order_cn=False)
    out = pos.load_pos_strict(rows, category="Promo")
    return out.select("date", "item_id", *_r(["demand_qty"]), F.round("sales_amount", 4).alias("sales_amount"))


@query("pos_daily_demand", _SQL_POS_PROMO, ops="S2 S4 S5 S6 F1 F2 A1")
def q_pos_daily_demand(spark, d):
    rows = tables.pos_rows(spark, d, text_order_cn=True)
    out = pos.load_pos(rows, category="PROMO", source_col="SOURCE_TAG")
    return out.select("date", "item_id", *_r(["demand_qty"]), F.round("sales_amount", 4).alias("sales_amount"))


@query("qty_column_inference", """
SELECT l_linestatus AS SOURCE_TAG, count(*) AS rows,
       count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS numeric_order_cn,
       CASE WHEN count(CASE WHEN l_linestatus = 'O' THEN 1 END) = 0 THEN 'SLE_CO' ELSE 'ORDER_CN' END AS qty_source
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""", ops="S5")
def q_qty_column_inference(spark, d):
    rows = tables.pos_rows(spark, d, text_order_cn=True)
    return pos.quantity_source(rows, source_col="SOURCE_TAG")


# ------------------------------------------------------------- features
@query("enriched_daily", f"""WITH {SQL_RAW}
SELECT date, item_id, is_holiday, current_inventory, lead_time_days, review_period_days, moq FROM raw""",
       ops="P1 W9 F10")
def q_enriched(spark, d):
    r = common.raw(spark, d)
    return r.select("date", "item_id", "is_holiday", "current_inventory", "lead_time_days", "review_period_days", "moq")


@query("calendar_features", f"""WITH {SQL_DAILY}
SELECT date, item_id, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
       CAST(CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
       CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day_of_month FROM daily""",
       ops="P3")
def q_calendar(spark, d):
    return features.calendar_features(common.daily(spark, d)).select(
        "date", "item_id", "day_of_week", "is_weekend", "month", "day_of_month")


_SQL_HOLIDAY = """,
cal AS (SELECT date, MAX(is_holiday) = 1 AS hol FROM raw GROUP BY date),
hd AS (SELECT date,
  CAST(COALESCE(date_diff('day', date, MIN(CASE WHEN hol THEN date END) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 999) AS INTEGER) AS days_to_holiday,
  CAST(COALESCE(date_diff('day', MAX(CASE WHEN hol THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), date), 999) AS INTEGER) AS days_since_holiday
  FROM cal)"""


@query("holiday_distance", f"""WITH {SQL_RAW}{_SQL_HOLIDAY}
SELECT r.date, r.item_id, days_to_holiday, days_since_holiday FROM raw r LEFT JOIN hd USING (date)""",
       ops="J8")
def q_holiday(spark, d):
    return features.holiday_distance(common.raw(spark, d)).select(
        "date", "item_id", "days_to_holiday", "days_since_holiday")


@query("lag_features", f"""WITH {SQL_DAILY}
SELECT date, item_id, demand_qty, {sql_lag('demand_qty', 1)} AS lag_1, {sql_lag('demand_qty', 7)} AS lag_7,
       {sql_lag('demand_qty', 14)} AS lag_14, {sql_lag('demand_qty', 28)} AS lag_28 FROM daily""", ops="W3")
def q_lags(spark, d):
    return features.lag_features(common.daily(spark, d)).select(
        "date", "item_id", "demand_qty", "lag_1", "lag_7", "lag_14", "lag_28")


def _sql_rolling(strict: bool) -> str:
    cols = []
    for w in (7, 14):
        cols.append(f"round({sql_roll('demand_qty', w, 1, 'avg', w if strict else 1)}, 4) AS roll_mean_{w}")
        cols.append(f"round({sql_roll('demand_qty', w, 1, 'stddev_samp', w if strict else 2)}, 4) AS roll_std_{w}")
    cols.append(f"round({sql_roll('demand_qty', 28, 1, 'avg', 28 if strict else 1)}, 4) AS trend_28d")
    return ", ".join(cols)


@query("rolling_features", f"""WITH {SQL_DAILY}
SELECT date, item_id, {_sql_rolling(True)} FROM daily""", ops="W4 W5 W6")
def q_rolling(spark, d):
    r = features.rolling_features(common.daily(spark, d))
    return r.select("date", "item_id", *_r(["roll_mean_7", "roll_std_7", "roll_mean_14", "roll_std_14", "trend_28d"]))


@query("shop_total_lag", f"""WITH {SQL_DAILY}
SELECT date, round(tot, 4) AS shop_total, round(lag(tot, 7) OVER (ORDER BY date), 4) AS shop_total_lag_7
FROM (SELECT date, SUM(demand_qty) AS tot FROM daily GROUP BY date)""", ops="A2 W7 J1")
def q_shop_total(spark, d):
    dd = common.daily(spark, d)
    tot = demand.shop_daily_total(dd)
    lagged = features.shop_total_lag(dd.select("date", "item_id", "demand_qty")).select("date", "shop_total_lag_7").distinct()
    return tot.join(lagged, "date").select("date", F.round("shop_total", 4).alias("shop_total"),
                                           F.round("shop_total_lag_7", 4).alias("shop_total_lag_7"))


def _sql_features(strict: bool) -> str:
    exp = "avg(demand_qty) OVER (PARTITION BY item_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    if strict:
        lag = {k: sql_lag("demand_qty", k) for k in fixed.LAGS}
        shop = "lag(tot, 7) OVER (ORDER BY date)"
        std = {w: sql_roll("demand_qty", w, 1, "stddev_samp", w) for w in (7, 14)}
        mean = {w: sql_roll("demand_qty", w, 1, "avg", w) for w in (7, 14)}
        trend = sql_roll("demand_qty", 28, 1, "avg", 28)
    else:
        lag = {k: f"COALESCE({sql_lag('demand_qty', k)}, {exp}, 0.0)" for k in fixed.LAGS}
        shop = "COALESCE(lag(tot, 7) OVER (ORDER BY date), lag(tot, 1) OVER (ORDER BY date), 0.0)"
        std = {w: f"COALESCE({sql_roll('demand_qty', w, 1, 'stddev_samp', 2)}, 0.0)" for w in (7, 14)}
        mean = {w: f"COALESCE({sql_roll('demand_qty', w, 1, 'avg', 1)}, {exp}, 0.0)" for w in (7, 14)}
        trend = f"COALESCE({sql_roll('demand_qty', 28, 1, 'avg', 1)}, {exp}, 0.0)"
    shop_cte = f"st AS (SELECT date, {shop} AS shop_total_lag_7 FROM (SELECT date, SUM(demand_qty) AS tot FROM raw GROUP BY date))"
    body = f"""WITH {SQL_RAW}{_SQL_HOLIDAY},
{shop_cte},
f AS (
SELECT r.date, r.item_id, r.demand_qty, r.temp_c, r.rain_mm, r.is_holiday, r.promo, r.event_score_100,
  CAST(r.event_score_100 > 0 AS INTEGER) AS is_event, CAST(r.event_score_100 >= 70 AS INTEGER) AS major_event_flag,
  r.event_score_100 * CAST(isodow(r.date) >= 6 AS INTEGER) AS event_score_x_weekend,
  r.event_score_100 * r.promo AS event_score_x_promo,
  CAST(isodow(r.date) - 1 AS INTEGER) AS day_of_week, CAST(isodow(r.date) >= 6 AS INTEGER) AS is_weekend,
  CAST(month(r.date) AS INTEGER) AS month, CAST(day(r.date) AS INTEGER) AS day_of_month,
  hd.days_to_holiday, hd.days_since_holiday, st.shop_total_lag_7,
  {trend} AS trend_28d,
  {lag[1]} AS lag_1, {lag[7]} AS lag_7, {lag[14]} AS lag_14, {lag[28]} AS lag_28,
  {mean[7]} AS roll_mean_7, {std[7]} AS roll_std_7, {mean[14]} AS roll_mean_14, {std[14]} AS roll_std_14
FROM raw r LEFT JOIN hd USING (date) LEFT JOIN st USING (date))"""
    return body


_FEATURE_OUT = ["date", "item_id", "demand_qty", "is_holiday", "promo", "is_event", "major_event_flag",
                "day_of_week", "is_weekend", "month", "day_of_month", "days_to_holiday", "days_since_holiday"]
_FEATURE_ROUND = ["event_score_x_weekend", "event_score_x_promo", "shop_total_lag_7", "trend_28d", "lag_1",
                  "lag_7", "lag_14", "lag_28", "roll_mean_7", "roll_std_7", "roll_mean_14", "roll_std_14"]


def _sql_feature_select(where: str) -> str:
    cols = ", ".join(_FEATURE_OUT + [f"round({c}, 4) AS {c}" for c in _FEATURE_ROUND])
    return f"SELECT {cols} FROM f {where}"


_STRICT_NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in ("shop_total_lag_7", "trend_28d", "lag_28", "roll_std_14",
                                                              "roll_std_7", "lag_14", "lag_7", "lag_1"))


@query("model_features", _sql_features(True) + "\n" + _sql_feature_select(f"WHERE {_STRICT_NOT_NULL}"), ops="W1 P4 P5 P6")
def q_model_features(spark, d):
    f = features.create_features(common.raw(spark, d))
    return f.select(*_FEATURE_OUT, *_r(_FEATURE_ROUND))


@query("model_features_blocks", _sql_features(True) + "\n" + _sql_feature_select(f"WHERE {_STRICT_NOT_NULL}"), ops="W1 W3 W4 W5 W6")
def q_model_features_blocks(spark, d):
    """The same frame from 24 blocks of rows with halo rows, where the items alone would give six tasks."""
    f = features.create_features(common.raw_materialized(spark, d), blocks=24)
    return f.select(*_FEATURE_OUT, *_r(_FEATURE_ROUND))


@query("short_history_features", _sql_features(False) + "\n" + _sql_feature_select(""), ops="W2 W8")
def q_short_features(spark, d):
    f = features.create_features(common.raw(spark, d), strict=False)
    return f.select(*_FEATURE_OUT, *_r(_FEATURE_ROUND))


@query("small_feature_set", f"""WITH {SQL_DAILY},
f AS (SELECT date, item_id, demand_qty, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
  {sql_lag('demand_qty', 1)} AS lag_1, {sql_lag('demand_qty', 7)} AS lag_7, {sql_lag('demand_qty', 14)} AS lag_14,
  {sql_roll('demand_qty', 7, 1, 'avg', 7)} AS roll_mean_7, {sql_roll('demand_qty', 7, 1, 'stddev_samp', 7)} AS roll_std_7,
  {sql_roll('demand_qty', 14, 1, 'avg', 14)} AS roll_mean_14, {sql_roll('demand_qty', 14, 1, 'stddev_samp', 14)} AS roll_std_14
  FROM daily)
SELECT date, item_id, demand_qty, day_of_week, lag_1, lag_7, lag_14, round(roll_mean_7, 4) AS roll_mean_7, round(roll_std_7, 4) AS roll_std_7,
       round(roll_mean_14, 4) AS roll_mean_14, round(roll_std_14, 4) AS roll_std_14
FROM f WHERE lag_14 IS NOT NULL AND roll_std_14 IS NOT NULL""", ops="P2")
def q_small_features(spark, d):
    f = features.small_feature_set(common.daily(spark, d))
    return f.select("date", "item_id", "demand_qty", "day_of_week", "lag_1", "lag_7", "lag_14",
                    *_r(["roll_mean_7", "roll_std_7", "roll_mean_14", "roll_std_14"]))


@query("quality_report", _sql_features(True) + f""",
ff AS ({_sql_feature_select(f"WHERE {_STRICT_NOT_NULL}")}),
per AS (SELECT item_id, count(*) AS n, count(DISTINCT date) AS d FROM ff GROUP BY item_id),
o AS (SELECT CAST(COALESCE(SUM(n), 0) AS BIGINT) AS rows, count(item_id) AS items,
             CAST(COALESCE(SUM(n - d), 0) AS BIGINT) AS duplicates, CAST(COALESCE(MIN(d), 0) AS BIGINT) AS min_item_days FROM per)
SELECT (rows > 0 AND min_item_days >= 21) AS ok, rows, items, duplicates, min_item_days,
       CASE WHEN rows = 0 THEN 'feature_df is empty'
            WHEN min_item_days < 21 THEN 'insufficient history per item: min_item_days=' || min_item_days
            ELSE '' END AS issues
FROM o""", ops="Q1 A5 A6")
def q_quality(spark, d):
    f = features.create_features(common.raw(spark, d))
    return demand.quality_report(f).withColumn("issues", F.array_join("issues", "; "))


@query("sequence_windows", f"""WITH {SQL_DAILY},
l AS (SELECT item_id, date, list(demand_qty) OVER w AS q, list(CAST(promo AS DOUBLE)) OVER w AS p FROM daily
      WINDOW w AS (PARTITION BY item_id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
SELECT item_id, date, CAST(unnest(range(14)) AS INTEGER) AS step, unnest(q) AS demand_qty_t, unnest(p) AS promo_t FROM l WHERE len(q) = 14""", ops="W10")
def q_sequences(spark, d):
    seq = features.sequence_windows(common.daily(spark, d), ["demand_qty", "promo"], timesteps=14)
    return seq.select("item_id", "date", F.posexplode("window").alias("step", "v")).select(
        "item_id", "date", "step", F.col("v")[0].alias("demand_qty_t"), F.col("v")[1].alias("promo_t"))


# --------------------------------------------------------------- splits
@query("date_split", f"""WITH {SQL_DAILY}
SELECT date, item_id, CASE WHEN date > (SELECT max(date) FROM daily) - INTERVAL 28 DAY THEN 'test' ELSE 'train' END AS split
FROM daily""", ops="P7 P8")
def q_date_split(spark, d):
    return splits.split_by_date(common.daily(spark, d), test_days=28).select("date", "item_id", "split")


@query("time_folds", f"""WITH {SQL_DAILY}
SELECT date, CAST(ntile(4) OVER (ORDER BY date) AS INTEGER) AS tile FROM (SELECT DISTINCT date FROM daily)""",
       ops="M4")
def q_time_folds(spark, d):
    return splits.date_tiles(common.daily(spark, d), n_tiles=4)


# ----------------------------------------------------- baseline forecast
_SQL_NAIVE = """,
tail AS (SELECT item_id, demand_qty, row_number() OVER (PARTITION BY item_id ORDER BY date DESC) AS rn FROM daily),
nq AS (SELECT item_id, avg(demand_qty) AS q50, COALESCE(stddev_samp(demand_qty), 0.0) AS sigma FROM tail WHERE rn <= 7 GROUP BY item_id),
naive AS (SELECT item_id, q50 AS q50_daily, sigma,
   CASE WHEN sigma = 0 THEN q50 * 1.15 ELSE greatest(q50, q50 + 1.645 * sigma) END AS q95_daily FROM nq)"""


@query("naive_forecast", f"""WITH {SQL_DAILY}{_SQL_NAIVE}
SELECT item_id, round(q50_daily, 4) AS q50_daily, round(q95_daily, 4) AS q95_daily, round(sigma, 4) AS sigma FROM naive""",
       ops="M9 A23")
def q_naive(spark, d):
    n = forecast.naive_quantiles(common.daily(spark, d))
    return n.select("item_id", *_r(["q50_daily", "q95_daily", "sigma"]))


def _sql_plan() -> str:
    z = inv_norm_cdf_sql("least(greatest(sl, 0.0001), 0.9999)")
    fold_ctes, last = fefo_fold_sql("fin", 7)
    return f"""WITH {SQL_RAW}{_SQL_NAIVE.replace('FROM daily', 'FROM raw')},
asofd AS (SELECT max(date) AS as_of FROM raw),
meta AS (SELECT item_id, arg_max(current_inventory, date) AS current_inventory FROM raw GROUP BY item_id),
uc AS (SELECT p_type AS item_id, round(avg(p_retailprice), 2) AS unit_cost FROM part GROUP BY 1),
base AS (
  SELECT n.item_id, m.current_inventory, n.q50_daily, n.q95_daily, 4 AS protection_days,
         1500.0 / (1500.0 + 180.0) AS sl, COALESCE(uc.unit_cost, 0.0) AS unit_cost,
         n.q50_daily * 4 AS mu, greatest(0.0, (n.q95_daily - n.q50_daily) / 1.645) * sqrt(4.0) AS sigma_p
  FROM naive n JOIN meta m USING (item_id) LEFT JOIN uc USING (item_id)),
tgt AS (SELECT *, greatest(0.0, mu + {z} * greatest(0.0, sigma_p)) AS target FROM base),
ord AS (SELECT *, CASE WHEN greatest(0.0, target - current_inventory) <= 0 THEN 0
             ELSE CAST(ceil(greatest(0.0, target - current_inventory) / 5) * 5 AS INTEGER) END AS recommended_order_qty,
             round(target, 2) AS target_stock FROM tgt),
lots AS (
  SELECT p_type AS item_id, least(greatest(date_diff('day', a.as_of, CAST(l_shipdate AS DATE) + p_size), 0), 7) AS b,
         CAST(l_quantity AS BIGINT) AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey, asofd a
  WHERE l_returnflag <> 'R' AND CAST(l_shipdate AS DATE) <= a.as_of AND CAST(l_shipdate AS DATE) + p_size >= a.as_of
    AND l_quantity > 0),
lb AS (SELECT item_id, {', '.join(f'CAST(COALESCE(SUM(CASE WHEN b = {k} THEN q END), 0) AS BIGINT) AS b{k}' for k in range(8))}
       FROM lots GROUP BY item_id),
fin AS (SELECT o.item_id, {', '.join(f'COALESCE(lb.b{k}, 0) AS b{k}' for k in range(8))},
        {', '.join(f'CAST(greatest(round_even(o.q50_daily, 0), 0) AS BIGINT) AS d{j}' for j in range(7))}
        FROM ord o LEFT JOIN lb USING (item_id)),
{fold_ctes}
SELECT CAST(a.as_of + INTERVAL 1 DAY AS DATE) AS date, o.item_id, o.current_inventory,
       round(o.q50_daily, 2) AS q50_daily, round(o.q95_daily, 2) AS q95_daily, o.protection_days,
       round(o.sl, 4) AS service_level, o.target_stock, o.recommended_order_qty,
       CASE WHEN o.target_stock <= 0 THEN '여유' WHEN o.current_inventory / o.target_stock < 0.3 THEN '필수'
            WHEN o.current_inventory / o.target_stock < 0.7 THEN '권장' ELSE '여유' END AS priority,
       o.unit_cost, o.recommended_order_qty * o.unit_cost AS expected_total_cost,
       CAST(s.w AS INTEGER) AS expected_waste_qty_7d, CAST(s.l AS INTEGER) AS expected_lost_sales_qty_7d
FROM ord o, asofd a, {last} s WHERE s.item_id = o.item_id"""


@query("order_plan", _sql_plan(), ops="I1 I2 I3 I4 I5 I6 I8 J2 J13 W14 M9 M10 F15")
def q_order_plan(spark, d):
    raw = common.raw_materialized(spark, d)
    plan = order_plan.naive_order_plan(raw, lots=common.lots_on_hand(spark, d, raw), unit_costs=common.unit_costs(spark, d))
    return plan.drop(*[c for c in plan.columns if c.startswith("forecast_")])


@query("order_plan_paths", f"""WITH {SQL_DAILY}{_SQL_NAIVE},
h AS (SELECT unnest([7, 30]) AS horizon)
SELECT item_id, CAST(h.horizon AS INTEGER) AS horizon, CAST(unnest(generate_series(1, h.horizon)) AS INTEGER) AS day,
       round(q50_daily, 4) AS q50, round(q95_daily, 4) AS q95 FROM naive, h""", ops="M10 M9")
def q_order_plan_paths(spark, d):
    """The plan's 7- and 30-day forecast paths, one row per day."""
    plan = order_plan.naive_order_plan(common.raw_materialized(spark, d))
    out = None
    for h in (7, 30):
        days = plan.select("item_id", F.lit(h).alias("horizon"),
                           F.posexplode(F.arrays_zip(F.col(f"forecast_q50_{h}d").alias("a"), F.col(f"forecast_q95_{h}d").alias("b"))).alias("i", "p"))
        days = days.select("item_id", "horizon", (F.col("i") + 1).alias("day"), F.round("p.a", 4).alias("q50"), F.round("p.b", 4).alias("q95"))
        out = days if out is None else out.unionByName(days)
    return out
