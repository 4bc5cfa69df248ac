"""Features and the recursive forecast against plain-Python re-computations."""

import datetime as dt
import json
import math
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tillcast.operators import demand, features, quantile, recursive, weather


def _raw(spark, n_days=60, items=("a", "b"), seed=1):
    rnd = random.Random(seed)
    rows = []
    start = dt.date(2024, 1, 1)
    for it in items:
        for k in range(n_days):
            if rnd.random() < 0.1:
                continue                                    # missing days stay missing
            rows.append((start + dt.timedelta(days=k), it, float(rnd.randint(0, 30))))
    df = spark.createDataFrame(rows, "date date, item_id string, demand_qty double")
    return demand.enrich_daily(df), rows


def test_no_leakage_features_ignore_the_future(spark):
    raw, rows = _raw(spark)
    cut = dt.date(2024, 2, 9)
    f_all = features.create_features(raw, strict=False).where(F.col("date") <= cut)
    changed = raw.withColumn("demand_qty", F.when(F.col("date") > cut, F.col("demand_qty") + 1000).otherwise(F.col("demand_qty")))
    f_chg = features.create_features(changed, strict=False).where(F.col("date") <= cut)
    cols = ["date", "item_id", "lag_1", "lag_7", "roll_mean_7", "roll_std_14", "trend_28d", "days_since_holiday"]
    assert sorted(f_all.select(cols).collect()) == sorted(f_chg.select(cols).collect())


def test_short_history_single_item_three_days(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "x", 3.0), (dt.date(2024, 1, 2), "x", 5.0), (dt.date(2024, 1, 3), "x", 10.0)],
                               "date date, item_id string, demand_qty double")
    f = features.create_features(demand.enrich_daily(df), strict=False).orderBy("date").collect()
    assert [r["lag_1"] for r in f] == [0.0, 3.0, 5.0]
    assert [r["lag_7"] for r in f] == [0.0, 3.0, 4.0]                 # expanding mean of past rows
    assert [r["roll_std_7"] for r in f][:2] == [0.0, 0.0]
    assert abs(f[2]["roll_std_7"] - math.sqrt(2.0)) < 1e-12
    assert [r["shop_total_lag_7"] for r in f] == [0.0, 3.0, 5.0]      # falls back to the 1-day lag
    assert features.create_features(demand.enrich_daily(df)).count() == 0   # strict: not enough history


def _py_model(model, row, columns):
    """A packed model walked row by row."""
    cats, nums = columns
    total = model.init
    for t in model.trees:
        i = 0
        while i < len(t["f"]):
            f, label = t["f"][i], t["l"][i]
            if f < 0:
                right = False
            elif label is not None:
                right = str(row[cats[f]]) == label
            else:
                right = not float(row[nums[f]]) <= t["t"][i]
            i = 2 * i + 1 + right
        total += model.learning_rate * t["v"][i - len(t["f"])]
    return total


@pytest.mark.parametrize("overrides", [False, True])
def test_recursive_forecast_matches_python_loop(spark, overrides):
    raw, _ = _raw(spark, n_days=90, seed=3)
    if overrides:  # events and weather that the trees can split on
        raw = raw.withColumns({"temp_c": (F.dayofmonth("date") % 9).cast("double"), "promo": (F.dayofmonth("date") % 4 == 0).cast("int"),
                               "event_score_100": F.when(F.dayofmonth("date") % 5 == 0, 80.0).otherwise(0.0)})
        raw = raw.withColumn("demand_qty", F.col("demand_qty") + F.col("temp_c") * 2 + F.col("promo") * 15 + F.col("event_score_100") / 4).checkpoint()
    feat = features.create_features(raw)
    qm = quantile.train_quantile_models(feat, n_stages=4, learning_rate=0.3, max_depth=3)
    last = raw.agg(F.max("date")).first()[0]
    # known for some days only, and there not all of them
    future = {last + dt.timedelta(days=k): {"temp_c": 7.5 if k != 3 else None, "promo": 1.0, "event_score_100": 90.0} for k in (1, 3, 4, 8)} if overrides else {}
    fx = spark.createDataFrame([(d, v["temp_c"], v["promo"], v["event_score_100"]) for d, v in future.items()],
                               "date date, temp_c double, promo double, event_score_100 double") if overrides else None
    paths = {r["item_id"]: r for r in recursive.recursive_forecast(qm, raw, feat, horizon=10, future_exogenous=fx).collect()}
    rows = sorted(raw.collect(), key=lambda r: (r["item_id"], r["date"]))
    hol = sorted({r["date"] for r in rows if r["is_holiday"] == 1})
    as_of = max(r["date"] for r in rows)
    last_feat = {}
    for r in sorted(feat.collect(), key=lambda r: r["date"]):
        last_feat[r["item_id"]] = r
    for item in ("a", "b"):
        h = [r["demand_qty"] for r in rows if r["item_id"] == item][-28:]
        lk = last_feat[item]
        q50s = []
        for step in range(1, 11):
            d = as_of + dt.timedelta(days=step)
            wd = d.weekday()
            since = [(d - x).days for x in hol if x <= d]
            lag = lambda k: (h[-1] if len(h) < k else h[-k]) if h else 0.0
            mean = lambda a: sum(a) / len(a) if a else 0.0
            std = lambda a: 0.0 if len(a) <= 1 else math.sqrt(sum((x - mean(a)) ** 2 for x in a) / (len(a) - 1))
            ex = {k: lk[k] for k in ("temp_c", "rain_mm", "promo", "event_score_100")} | {k: v for k, v in future.get(d, {}).items() if v is not None}
            ev = ex["event_score_100"]
            row = {"item_id": item, **ex, "is_holiday": 0, "is_event": int(ev > 0), "major_event_flag": int(ev >= 70),
                   "event_score_x_weekend": ev * (wd >= 5), "event_score_x_promo": ev * ex["promo"], "day_of_week": wd,
                   "is_weekend": int(wd >= 5), "month": d.month, "day_of_month": d.day, "days_to_holiday": 999,
                   "days_since_holiday": min(since) if since else 999, "shop_total_lag_7": lk["shop_total_lag_7"],
                   "trend_28d": mean(h[-28:]), "lag_1": lag(1), "lag_7": lag(7), "lag_14": lag(14), "lag_28": lag(28),
                   "roll_mean_7": mean(h[-7:]), "roll_std_7": std(h[-7:]), "roll_mean_14": mean(h[-14:]),
                   "roll_std_14": std(h[-14:])}
            p50 = max(0.0, _py_model(qm.models[0.5], row, qm.columns))
            q50s.append(p50)
            h = (h + [p50])[-28:]
        got = paths[item]["q50_path"]
        assert len(got) == 10
        for a, b in zip(got, q50s):
            assert abs(a - b) < 1e-9, (item, got, q50s)


def test_weather_feed_json(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    doc = {"response": {"header": {"resultCode": "00"}, "body": {"items": {"item": [
        {"category": "TMP", "fcstDate": "20240101", "fcstTime": "0600", "fcstValue": "3"},
        {"category": "PCP", "fcstDate": "20240101", "fcstTime": "0600", "fcstValue": "30.0~50.0mm"},
        {"category": "TMP", "fcstDate": "20240101", "fcstTime": "0600", "fcstValue": "4"},
        {"category": "PTY", "fcstDate": "20240101", "fcstTime": "0600", "fcstValue": "1"},
        {"category": "RN1", "fcstDate": "20240101", "fcstTime": "0700", "fcstValue": "1.5mm"},
        {"category": "TMP", "fcstDate": "20240101", "fcstTime": "0800", "fcstValue": "5"},
        {"category": "PCP", "fcstDate": "20240101", "fcstTime": "0800", "fcstValue": "강수없음"}]}}}}
    with open(os.path.join(d, "seoul.json"), "w", encoding="utf-8") as fh:
        json.dump(doc, fh, ensure_ascii=False)
    raw = spark.read.option("multiLine", True).json(d)
    piv = {r["base_time"]: (r["temperature"], r["precipitation"], r["pty_code"])
           for r in weather.weather_pivot(weather.parse_feed_json(raw)).collect()}
    assert piv == {"0600": (4.0, 0.0, 1), "0800": (5.0, 0.0, 0)}     # 0700 has no temperature: dropped


def test_model_plan_keeps_items_on_latest_date_by_default(spark):
    from tillcast.plans import model_run
    raw, _ = _raw(spark, n_days=70, seed=5)
    # item b stops three days before the end
    raw = raw.where(~((F.col("item_id") == "b") & (F.col("date") > dt.date(2024, 3, 7))))
    run = model_run.fit_and_evaluate(raw, params={"n_stages": 2, "learning_rate": 0.3, "max_depth": 2})
    default = {r["item_id"] for r in model_run.model_plan(raw, run).collect()}
    every = {r["item_id"] for r in model_run.model_plan(raw, run, latest_date_items_only=False).collect()}
    assert default == {"a"} and every == {"a", "b"}


def test_holiday_distance_matches_loop(spark):
    rnd = random.Random(8)
    start = dt.date(2024, 1, 1)
    days = sorted({start + dt.timedelta(days=rnd.randint(0, 120)) for _ in range(67)})     # irregular dates
    hol = {x for x in days if rnd.random() < 0.15}
    rows = [(x, "a", 1.0, int(x in hol)) for x in days]
    df = spark.createDataFrame(rows, "date date, item_id string, demand_qty double, is_holiday int")
    got = {r["date"]: (r["days_to_holiday"], r["days_since_holiday"]) for r in features.holiday_distance(df).collect()}
    for x in days:
        to = min([(h - x).days for h in hol if x <= h] or [999])
        since = min([(x - h).days for h in hol if x >= h] or [999])
        assert got[x] == (to, since), x


WINDOWED = {"roll_mean_7": ("mean", 7), "roll_std_7": ("std", 7), "roll_mean_14": ("mean", 14), "roll_std_14": ("std", 14), "trend_28d": ("mean", 28)}


def _by_index(rows, date, item):
    """What the written rules say of one row: values of the same item and of the day totals, addressed by position."""
    mine = [q for d, i, q in sorted(rows) if i == item and d < date]
    days = sorted({d for d, _, _ in rows})
    at = days.index(date)
    day_total = lambda k: sum(q for d, _, q in rows if d == days[at - k]) if at >= k else None
    return mine, day_total


def _stat(kind, xs):
    m = sum(xs) / len(xs)
    return m if kind == "mean" else math.sqrt(sum((x - m) ** 2 for x in xs) / (len(xs) - 1))


def test_strict_features_by_index(spark):
    raw, rows = _raw(spark, n_days=80, seed=12)
    got = {(r["date"], r["item_id"]): r for r in features.create_features(raw).collect()}
    whole = 0
    for date, item, qty in rows:
        past, day_total = _by_index(rows, date, item)
        if len(past) < 28 or day_total(7) is None:
            assert (date, item) not in got
            continue
        whole += 1
        r = got[(date, item)]
        assert [r[f"lag_{k}"] for k in (1, 7, 14, 28)] == [past[-k] for k in (1, 7, 14, 28)]
        for name, (kind, n) in WINDOWED.items():
            assert abs(r[name] - _stat(kind, past[-n:])) < 1e-9, name
        assert abs(r["shop_total_lag_7"] - day_total(7)) < 1e-9
        assert r["current_inventory"] == round(0.8 * (past[-2] + past[-1] + qty) / 3)
    assert whole == len(got) > 0


def test_short_history_features_by_index(spark):
    raw, rows = _raw(spark, n_days=20, seed=21)
    got = {(r["date"], r["item_id"]): r for r in features.create_features(raw, strict=False).collect()}
    assert len(got) == len(rows)
    for date, item, _ in rows:
        past, day_total = _by_index(rows, date, item)
        r = got[(date, item)]
        instead = _stat("mean", past) if past else 0.0
        for k in (1, 7, 14, 28):
            assert abs(r[f"lag_{k}"] - (past[-k] if len(past) >= k else instead)) < 1e-9
        for name, (kind, n) in WINDOWED.items():
            want = (_stat(kind, past[-n:]) if len(past) > (kind == "std") else 0.0)
            assert abs(r[name] - want) < 1e-9, name
        total = next((t for t in (day_total(7), day_total(1)) if t is not None), 0.0)
        assert abs(r["shop_total_lag_7"] - total) < 1e-9
