"""Registered queries: weather feed, grid cells, event score, request tags, forecast grid."""

from __future__ import annotations


from pyspark.sql import functions as F

from tillcast import fixed, tables
from tillcast.functions import grid
from tillcast.operators import events, tags, weather
from tillcast.plans.registry import query
from tillcast.sources.regions import nearest_of

AE = tables.AS_OF_EVENTS
AED = f"DATE '{AE}'"

SQL_WLONG = """wlong AS (
  SELECT event_id AS seq, 'R' || CAST(user_id % 17 AS VARCHAR) AS region, strftime(ts, '%Y%m%d') AS fcst_date,
         strftime(ts, '%H') || '00' AS fcst_time,
         CASE event_type WHEN 'view' THEN 'TMP' WHEN 'click' THEN 'PCP' WHEN 'purchase' THEN 'RN1'
                         WHEN 'error' THEN 'PTY' WHEN 'signup' THEN 'POP' END AS category,
         CASE WHEN event_type = 'click' AND value < 5 THEN 0.0
              WHEN event_type IN ('click', 'purchase') THEN value / 10 END AS rain_val,
         CASE WHEN event_type = 'error' THEN CAST(floor(value) % 5 AS INTEGER) END AS pty_val,
         CASE WHEN event_type IN ('view', 'signup') THEN value / 10 END AS num_val
  FROM events)"""

SQL_PIVOT = SQL_WLONG + """,
piv AS (
  SELECT region, fcst_date AS base_date, fcst_time AS base_time,
         arg_max(num_val, seq) FILTER (WHERE category = 'TMP') AS temperature,
         COALESCE(arg_max(rain_val, seq) FILTER (WHERE category IN ('PCP', 'RN1')), 0.0) AS precipitation,
         COALESCE(arg_max(pty_val, seq) FILTER (WHERE category = 'PTY'), 0) AS pty_code
  FROM wlong GROUP BY 1, 2, 3 HAVING arg_max(num_val, seq) FILTER (WHERE category = 'TMP') IS NOT NULL)"""


def _pivot(spark, d):
    return weather.weather_pivot(tables.weather_long(spark, d))


@query("weather_pivot", f"WITH {SQL_PIVOT} SELECT * FROM piv", ops="A9 F3 F4 P22 S10")
def q_weather_pivot(spark, d):
    return _pivot(spark, d)


@query("weather_snapshot_1400", f"""WITH {SQL_WLONG}
SELECT region, fcst_date AS base_date,
       COALESCE(arg_max(num_val, seq) FILTER (WHERE category = 'TMP' AND fcst_time = '1400'), 0.0) AS temperature,
       COALESCE(arg_max(num_val, seq) FILTER (WHERE category = 'POP' AND fcst_time = '1400'), 0.0) AS precipitation
FROM wlong GROUP BY 1, 2""", ops="A10")
def q_weather_snapshot(spark, d):
    return weather.snapshot_at(tables.weather_long(spark, d))


@query("weather_cache_status", f"""WITH {SQL_PIVOT}
SELECT region, count(*) AS rows, count(*) >= 24 AS complete FROM piv WHERE base_date >= strftime({AED}, '%Y%m%d') GROUP BY 1""",
       ops="P23 U3")
def q_weather_cache(spark, d):
    return weather.cache_completeness(_pivot(spark, d), AE)


@query("weather_change_alert", f"""WITH {SQL_PIVOT},
f AS (SELECT region, base_date, arg_min(temperature, base_time) AS temperature, arg_min(precipitation, base_time) AS precipitation,
             arg_min(pty_code, base_time) AS pty_code FROM piv
      WHERE base_date IN (strftime({AED}, '%Y%m%d'), strftime({AED} + 1, '%Y%m%d')) GROUP BY 1, 2),
t AS (SELECT region, temperature AS today_temp FROM f WHERE base_date = strftime({AED}, '%Y%m%d')),
m AS (SELECT region, temperature AS tomorrow_temp, precipitation, pty_code FROM f WHERE base_date = strftime({AED} + 1, '%Y%m%d')),
j AS (SELECT m.*, t.today_temp, CASE WHEN t.today_temp IS NOT NULL THEN tomorrow_temp - today_temp ELSE 0.0 END AS temp_diff
      FROM m LEFT JOIN t USING (region))
SELECT region, tomorrow_temp, today_temp, temp_diff, precipitation, pty_code,
       CASE WHEN pty_code > 0 OR precipitation > 0 THEN 'precipitation'
            WHEN today_temp IS NOT NULL AND temp_diff > 0 THEN 'warmer'
            WHEN today_temp IS NOT NULL AND temp_diff < 0 THEN 'colder' ELSE 'steady' END AS alert,
       CASE WHEN pty_code > 0 OR precipitation > 0 THEN
            CASE WHEN pty_code = 1 THEN '비' WHEN pty_code = 2 THEN '진눈깨비(비/눈)' WHEN pty_code = 3 THEN '눈'
                 WHEN pty_code = 4 THEN '소나기' WHEN pty_code > 0 THEN '강수' ELSE '비' END END AS precip_kind
FROM j""", ops="R4 J11 F4")
def q_weather_alert(spark, d):
    return weather.weather_change_alert(_pivot(spark, d), AE)


# ------------------------------------------------------------------ grid
def _grid_sql(lat: str, lon: str) -> tuple[str, str]:
    # the projection's numbers, spelled out apart from the code under test
    ra = f"(2284.6763975402346 / pow(tan(0.7853981633974483 + ({lat}) * 0.008726646259971648), 0.715566847180628))"
    th0 = f"(({lon}) * 0.017453292519943295 - 2.199114857512855)"
    th1 = f"(CASE WHEN {th0} > pi() THEN {th0} - 2.0 * pi() ELSE {th0} END)"
    th = f"((CASE WHEN {th1} < -pi() THEN {th1} + 2.0 * pi() ELSE {th1} END) * 0.715566847180628)"
    nx = f"CAST(floor({ra} * sin({th}) + 43 + 0.5) AS INTEGER)"
    ny = f"CAST(floor(1366.777782832094 - {ra} * cos({th}) + 136 + 0.5) AS INTEGER)"
    return nx, ny


SQL_CUST = """cust AS (SELECT c_custkey AS id, 33.0::DOUBLE + (c_custkey % 1000) * 0.0055::DOUBLE AS lat,
                      125.0::DOUBLE + ((c_custkey * 7919) % 1000) * 0.0045::DOUBLE AS lon FROM customer)"""
_NX, _NY = _grid_sql("lat", "lon")


@query("grid_cells", f"""WITH {SQL_CUST}
SELECT id, lat, lon, {_NX} AS nx, {_NY} AS ny FROM cust""", ops="F5 G1")
def q_grid_cells(spark, d):
    c = tables.customer_locations(spark, d)
    nx, ny = grid.grid_cell("lat", "lon")
    return c.select("id", "lat", "lon", nx.alias("nx"), ny.alias("ny"))


_PROV_VALUES = ("(0, '서울', 61, 125), (1, '부산', 98, 76), (2, '인천', 55, 124), (3, '대구', 89, 90), (4, '광주', 58, 74), (5, '대전', 67, 100), (6, '울산', 102, 84), (7, '세종', 66, 103), (8, '경기', 60, 120), "
                "(9, '강원', 73, 134), (10, '충북', 69, 107), (11, '충남', 68, 100), (12, '전북', 63, 89), (13, '전남', 51, 67), (14, '경북', 87, 106), (15, '경남', 91, 77), (16, '제주', 52, 38)")


@query("nearest_region", f"""WITH {SQL_CUST},
cells AS (SELECT id, {_NX} AS nx, {_NY} AS ny FROM cust),
prov(i, name, px, py) AS (VALUES {_PROV_VALUES})
SELECT id, nx, ny, arg_min(name, ((px - nx) * (px - nx) + (py - ny) * (py - ny)) * 100 + i) AS region
FROM cells, prov GROUP BY id, nx, ny""", ops="J9 G1")
def q_nearest_region(spark, d):
    c = tables.customer_locations(spark, d)
    nx, ny = grid.grid_cell("lat", "lon")
    cells = c.select("id", nx.alias("nx"), ny.alias("ny"))
    return cells.select("id", "nx", "ny", nearest_of(list(fixed.PROVINCE_CELLS), F.col("nx"), F.col("ny")).alias("region"))


# ---------------------------------------------------------------- events
SQL_EVATTR = """ev AS (
  SELECT event_id, CAST(ts AS DATE) AS date, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id, value, event_type
  FROM events),
ea AS (SELECT event_id, date, k * 50 AS v, value * 10 AS dist, user_id % 2 = 0 AS main, (k % 10) / 10.0 AS ov,
              value / 400.0 AS fit, k / 20.0 AS dwell, event_type <> 'error' AS pub FROM ev),
sc AS (SELECT event_id, date,
  CASE WHEN NOT pub THEN 0 ELSE CAST(least(100,
    (CASE WHEN v >= 3000 THEN 25 WHEN v >= 1500 THEN 20 WHEN v >= 700 THEN 15 WHEN v >= 300 THEN 10 WHEN v >= 100 THEN 5 ELSE 0 END)
    + (CASE WHEN main THEN least(25, d0 + 5) ELSE d0 END)
    + (CASE WHEN least(greatest(ov, 0.0), 1.0) >= 0.7 THEN 20 WHEN least(greatest(ov, 0.0), 1.0) >= 0.4 THEN 15
            WHEN least(greatest(ov, 0.0), 1.0) >= 0.2 THEN 10 WHEN least(greatest(ov, 0.0), 1.0) > 0 THEN 5 ELSE 0 END)
    + CAST(round_even(least(greatest(fit, 0.0), 1.0) * 20, 0) AS INTEGER)
    + (CASE WHEN dwell >= 4 THEN 10 WHEN dwell >= 2 THEN 7 WHEN dwell >= 1 THEN 4 ELSE 1 END)) AS INTEGER) END AS event_score_100
  FROM (SELECT *, CASE WHEN dist <= 100 THEN 25 WHEN dist <= 300 THEN 20 WHEN dist <= 500 THEN 15 WHEN dist <= 1000 THEN 10
                       WHEN dist <= 2000 THEN 5 ELSE 0 END AS d0 FROM ea))"""


def _scored(spark, d):
    a = tables.event_attributes(spark, d)
    s = events.event_score("expected_visitors", "distance_m", "on_main_flow", "overlap_ratio", "customer_fit",
                           "dwell_hours", "public_event")
    return a.select("event_id", "date", "region_no", s.alias("event_score_100"))


@query("event_impact_score", f"WITH {SQL_EVATTR} SELECT event_id, date, event_score_100 FROM sc", ops="E1")
def q_event_score(spark, d):
    return _scored(spark, d).select("event_id", "date", "event_score_100")


@query("daily_event_score", f"""WITH {SQL_EVATTR}
SELECT date, CAST(max(event_score_100) AS DOUBLE) AS event_score_100 FROM sc GROUP BY 1""", ops="E1 P4")
def q_daily_event_score(spark, d):
    return events.daily_event_score(_scored(spark, d))


# ------------------------------------------------------------- requests
@query("tag_weights", f"""WITH {SQL_PIVOT}, {SQL_EVATTR},
wt AS (SELECT region, base_date, bool_or(pty_code IN (1, 2, 4)) AS rain, bool_or(pty_code IN (2, 3)) AS snow
       FROM piv GROUP BY 1, 2),
es AS (SELECT 'R' || CAST(e.user_id % 17 AS VARCHAR) AS region, strftime(sc.date, '%Y%m%d') AS base_date,
              max(sc.event_score_100) AS top FROM sc JOIN ev e USING (event_id) GROUP BY 1, 2),
r AS (SELECT wt.region, wt.base_date, rain, snow, COALESCE(es.top, 0) >= 70 AS fest FROM wt LEFT JOIN es USING (region, base_date)),
w AS (SELECT *, CAST((CASE WHEN rain THEN -10 ELSE 0 END) + (CASE WHEN snow THEN -15 ELSE 0 END)
                     + (CASE WHEN fest THEN 30 ELSE 0 END) AS INTEGER) AS weight_pct FROM r)
SELECT region, base_date, weight_pct,
       CASE WHEN rain AND snow THEN '비, 눈' WHEN rain THEN '비' WHEN snow THEN '눈' ELSE '' END AS weather_factors,
       CASE WHEN fest THEN '지역 축제' ELSE '' END AS event_factors,
       CASE WHEN weight_pct > 0 THEN '수요 약 ' || weight_pct || '% 증가 예측'
            WHEN weight_pct < 0 THEN '수요 약 ' || abs(weight_pct) || '% 감소 예측'
            ELSE '외생 변수 영향 없음 (평년 수준)' END AS impact_summary
FROM w""", ops="F12 F13 L1 U4")
def q_tag_weights(spark, d):
    auto = weather.auto_weather_tags(_pivot(spark, d))
    sc = _scored(spark, d).groupBy(F.concat(F.lit("R"), F.col("region_no").cast("string")).alias("region"),
                                   F.date_format("date", "yyyyMMdd").alias("base_date")) \
        .agg(F.max("event_score_100").alias("top"))
    req = auto.join(sc, ["region", "base_date"], "left").withColumn(
        "event_tags", F.when(F.coalesce("top", F.lit(0)) >= fixed.MAJOR_EVENT_SCORE, F.array(F.lit("지역 축제")))
        .otherwise(F.array().cast("array<string>")))
    out = tags.request_weights(req, text_col=None)
    return out.select("region", "base_date", "weight_pct", "weather_factors", "event_factors", "impact_summary")


@query("forecast_grid", f"""WITH s AS (
  SELECT p_name AS name, avg(l_quantity) AS avg_qty FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_returnflag <> 'R' GROUP BY 1),
names AS (SELECT DISTINCT p_name AS name FROM part),
g AS (SELECT n.name, s.avg_qty, CAST(unnest(generate_series(DATE '2001-06-30' - 7, DATE '2001-06-30' + 2, INTERVAL 1 DAY)) AS DATE) AS date
      FROM names n LEFT JOIN s USING (name)),
m AS (SELECT *, greatest(CASE isodow(date) - 1 WHEN 5 THEN 1.3 WHEN 6 THEN 1.4 WHEN 0 THEN 0.9 WHEN 4 THEN 1.1 ELSE 1.0 END
                         * (1.0 + 30.0 / 100.0), 0.1) AS mult, COALESCE(avg_qty, 10.0) AS base FROM g)
SELECT date, name AS item_id, CAST(round_even(base * mult * 1.0, 0) AS INTEGER) AS q50_daily,
       CAST(round_even(base * 1.5 * mult * 1.0, 0) AS INTEGER) AS q95_daily, 4 AS protection_days,
       CAST(round_even(base * mult * 1.0, 0) AS INTEGER) * 4 AS target_stock,
       CASE WHEN date = DATE '2001-06-30' THEN greatest(0, CAST(round_even(base * mult * 1.0, 0) AS INTEGER) * 4 - 20) ELSE 0 END
         AS recommended_order_qty
FROM m""", ops="M12 J5 J6 A4")
def q_forecast_grid(spark, d):
    avg_qty = tables.average_quantity(spark, d)
    names = tables.product(spark, d).select("name").distinct()
    return tags.forecast_grid(names, avg_qty, tables.AS_OF_SALES, 30)


@query("weather_by_location", f"""WITH {SQL_CUST}, {SQL_PIVOT},
cells AS (SELECT id, {_NX} AS nx, {_NY} AS ny FROM cust),
prov(i, name, px, py) AS (VALUES {_PROV_VALUES}),
near AS (SELECT id, arg_min(px, ((px - nx) * (px - nx) + (py - ny) * (py - ny)) * 100 + i) AS cx,
                arg_min(py, ((px - nx) * (px - nx) + (py - ny) * (py - ny)) * 100 + i) AS cy FROM cells, prov GROUP BY id),
wcell AS (SELECT p.px AS cx, p.py AS cy, piv.* FROM piv JOIN prov p ON piv.region = 'R' || CAST(p.i AS VARCHAR)),
today AS (SELECT cx, cy, arg_min(temperature, base_time) AS temperature, arg_min(precipitation, base_time) AS precipitation,
                 arg_min(pty_code, base_time) AS pty_code FROM wcell WHERE base_date = strftime({AED}, '%Y%m%d') GROUP BY 1, 2)
SELECT n.id, n.cx, n.cy, t.temperature, t.precipitation, t.pty_code FROM near n LEFT JOIN today t USING (cx, cy)""",
       ops="G1 J9 J11 F5")
def q_weather_by_location(spark, d):
    """G1: each location's grid cell -> the nearest served cell -> that cell's first forecast of the day."""
    c = tables.customer_locations(spark, d)
    nx, ny = grid.grid_cell("lat", "lon")
    cells = list(fixed.PROVINCE_CELLS)
    served = [(f"{x}_{y}", x, y) for _, x, y in cells]
    near = c.select("id", nx.alias("nx"), ny.alias("ny")).select(
        "id", nearest_of(served, F.col("nx"), F.col("ny")).alias("cell"))
    near = near.select("id", F.split("cell", "_")[0].cast("int").alias("cx"), F.split("cell", "_")[1].cast("int").alias("cy"))
    # the served cells of the feed: 17 rows, a fixed bound
    region_cell = spark.createDataFrame([(f"R{i}", x, y) for i, (_, x, y) in enumerate(cells)], "region string, cx int, cy int")
    piv = _pivot(spark, d).join(F.broadcast(region_cell), "region")
    today = weather.first_of_day(piv.where(F.col("base_date") == F.date_format(F.lit(AE).cast("date"), "yyyyMMdd"))
                                 .withColumn("region", F.concat_ws("_", "cx", "cy")))
    today = today.select(F.split("region", "_")[0].cast("int").alias("cx"), F.split("region", "_")[1].cast("int").alias("cy"),
                         "temperature", "precipitation", "pty_code")
    return near.join(today, ["cx", "cy"], "left").select("id", "cx", "cy", "temperature", "precipitation", "pty_code")


@query("weather_cache_refresh", f"""WITH {SQL_PIVOT},
bad AS (SELECT region FROM piv WHERE base_date >= strftime({AED}, '%Y%m%d') GROUP BY 1 HAVING count(*) < 24)
SELECT * FROM piv WHERE base_date < strftime({AED}, '%Y%m%d')
UNION ALL
SELECT * FROM piv WHERE base_date >= strftime({AED}, '%Y%m%d') AND region NOT IN (SELECT region FROM bad)""",
       ops="U3 P23")
def q_weather_cache_refresh(spark, d):
    """Drop the cached rows (on/after today) of regions whose cache is incomplete."""
    return weather.drop_incomplete(_pivot(spark, d), AE)
