"""Edge fixtures: empty input, returns only, duplicate / null keys, zero bases, oversize waste, missing actuals."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from tillcast.functions.numeric import days_of_stock, pct_change
from tillcast.operators import accuracy, demand, fefo, features, reports
from tillcast.plans import order_plan
from tillcast.sources import pos

D = dt.date


def test_empty_and_all_returns(spark):
    sales = spark.createDataFrame([(D(2024, 1, 1), "a", 2.0, 10.0, True)],
                                  "date date, item_id string, qty double, amount double, is_return boolean")
    daily = demand.daily_demand(sales, return_col="is_return")
    assert daily.count() == 0
    rep = demand.quality_report(features.create_features(demand.enrich_daily(daily))).first()
    assert rep["ok"] is False and rep["rows"] == 0 and "feature_df is empty" in rep["issues"]
    assert order_plan.naive_order_plan(demand.enrich_daily(daily)).count() == 0


def test_duplicate_and_null_keys(spark):
    rows = [(D(2024, 1, 1), "a", 1.0), (D(2024, 1, 1), "a", 2.0), (None, "a", 5.0), (D(2024, 1, 2), None, 4.0),
            (D(2024, 1, 2), "b", None)]
    df = spark.createDataFrame(rows, "date date, item_id string, demand_qty double")
    rep = demand.quality_report(df, feature_cols=["date", "item_id", "demand_qty"], timesteps=0).first()
    assert rep["duplicates"] >= 1 and "NaN in demand_qty" in rep["issues"]
    s = df.withColumnRenamed("demand_qty", "qty").withColumn("amount", F.lit(None).cast("double"))
    out = {(r["date"], r["item_id"]): (r["demand_qty"], r["sales_amount"]) for r in demand.daily_demand(s).collect()}
    assert out == {(D(2024, 1, 1), "a"): (3.0, 0.0)}                 # null keys / qty dropped; all-null amount -> 0


def test_zero_bases(spark):
    df = spark.createDataFrame([(10.0, 0.0, 5.0, 0.0)], "cur double, base double, stock double, usage double")
    r = df.select(pct_change("cur", "base").alias("p"), days_of_stock("stock", "usage").alias("d")).first()
    assert r["p"] == 0.0 and r["d"] == 999.0


def test_waste_larger_than_stock(spark):
    b = spark.createDataFrame([(1, 7, D(2024, 1, 1), 3), (2, 7, D(2024, 1, 1), 4)],
                              "batch_id long, product_id int, expiration_date date, current_qty long")
    w = spark.createDataFrame([(7, 100)], "product_id int, quantity long")
    got = {r["batch_id"]: (r["deducted"], r["new_qty"]) for r in fefo.fefo_deduction(b, w).collect()}
    assert got == {1: (3, 0), 2: (4, 0)}                              # equal expiry: id breaks the tie; floor at 0
    named = spark.createDataFrame([(2, 9)], "batch_id long, quantity long")
    n = {r["batch_id"]: (r["new_qty"], r["excess_waste"]) for r in fefo.named_batch_waste(b, named).collect()}
    assert n == {1: (3, 0), 2: (0, 5)}


def test_accuracy_without_actuals_and_two_forecasts(spark):
    fc = spark.createDataFrame([(D(2024, 1, 5), "a", 10.0, D(2024, 1, 1), 1), (D(2024, 1, 5), "a", 20.0, D(2024, 1, 3), 2),
                                (D(2024, 1, 5), "b", 0.0, D(2024, 1, 3), 3), (D(2024, 1, 6), "c", 5.0, D(2024, 1, 3), 4)],
                               "target_date date, product string, predicted_qty double, created_at date, forecast_id long")
    sales = spark.createDataFrame([(D(2024, 1, 5), "a", 15.0)], "date date, item_id string, qty double")
    acc = {(r["date"].day, r["product"]): (r["predicted_qty"], r["actual"], r["accuracy"])
           for r in accuracy.forecast_accuracy(fc, sales).collect()}
    assert acc[(5, "a")] == (20.0, 15.0, 75.0)                        # latest forecast wins
    assert acc[(5, "b")] == (0.0, 0.0, 100.0)                         # p = 0 and no sale -> 100
    assert acc[(6, "c")] == (5.0, 0.0, 0.0)                           # no actual -> 0 sold
    tot = {r["date"].day: r["predicted"] for r in reports.forecast_day_totals(fc).collect()}
    assert tot == {5: 20.0, 6: 5.0}


def test_first_valid_source_skips_bad_files(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    with open(os.path.join(d, "a_bad.csv"), "w") as f:
        f.write("foo,bar\n1,2\n")
    with open(os.path.join(d, "b_good.csv"), "w") as f:
        f.write("date,item_id,demand_qty\n2024-01-01,x,3\n")
    os.utime(os.path.join(d, "b_good.csv"), (1, 1))                    # older: ranked second
    df, path, skipped = pos.first_valid_source(spark, d + "/*.csv")
    assert path.endswith("b_good.csv") and df.count() == 1
    assert skipped and skipped[0][0].endswith("a_bad.csv") and "Missing columns" in skipped[0][1]


def test_request_flow(spark):
    from tillcast.plans.request import run_request
    sales = spark.createDataFrame([("latte", 10.0), ("latte", 20.0)], "product_name string, qty double")
    products = spark.createDataFrame([("latte",), ("mocha",)], "name string")
    stored = spark.createDataFrame([(D(2024, 1, 8), "latte", 1.0, D(2024, 1, 1), 7), (D(2024, 1, 3), "latte", 2.0, D(2024, 1, 1), 7)],
                                   "target_date date, product string, predicted_qty double, created_at date, forecast_period int")
    res = run_request(spark, avg_qty=sales.groupBy(F.col("product_name").alias("name")).agg(F.avg("qty").alias("avg_qty")), products=products, stored=stored, request_date="2024-01-08",
                      weather_tags=["비"], event_tags=["지역 축제"], custom_input="마라톤 대회")
    log = res.run_log.first()
    assert log["weight_pct"] == 35 and log["event_factors"] == "지역 축제 | 자동인식: 야외행사(+15%)"
    assert log["impact_summary"] == "수요 약 35% 증가 예측"
    g = {(r["date"], r["item_id"]): r for r in res.grid.collect()}
    assert len(g) == 20
    # 2024-01-08 is a Monday: 15 x 0.9 x 1.35 = 18.225 -> 18; order only on the request day
    assert g[(D(2024, 1, 8), "latte")]["q50_daily"] == 18 and g[(D(2024, 1, 8), "latte")]["recommended_order_qty"] == 52
    assert g[(D(2024, 1, 8), "mocha")]["q50_daily"] == 12                    # no sales: base 10
    assert g[(D(2024, 1, 7), "latte")]["recommended_order_qty"] == 0
    f = {(r["target_date"], r["product"]): r["predicted_qty"] for r in res.forecasts.collect()}
    assert f[(D(2024, 1, 8), "latte")] == 18.0 and f[(D(2024, 1, 3), "latte")] == 2.0   # past rows kept
    assert (D(2024, 1, 7), "latte") not in f                                  # negative offsets not stored


def test_observed_quality_and_collated_page(spark):
    from tillcast.operators import views
    df = spark.createDataFrame([(D(2024, 1, 1), "a", 1.0), (D(2024, 1, 3), "b", None)],
                               "date date, item_id string, demand_qty double")
    out, obs = demand.observe_quality(df)
    out.write.format("noop").mode("overwrite").save()
    m = obs.get
    assert m["rows"] == 2 and m["null_target"] == 1 and m["min_date"] == D(2024, 1, 1) and m["max_date"] == D(2024, 1, 3)
    names = spark.createDataFrame([("b",), ("B",), ("a",)], "name string")
    binary = [r["name"] for r in views.sort_page(names, ["name"], k=3).collect()]
    coll = [r["name"] for r in views.sort_page(names, ["name"], k=3, collation="UNICODE", text_cols=["name"]).collect()]
    assert binary == ["B", "a", "b"] and coll == ["a", "b", "B"]
