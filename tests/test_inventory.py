"""Replenishment maths against cases worked by hand and invariants."""

import math
import random
from statistics import NormalDist

from pyspark.sql import functions as F

from tillcast.operators import events, inventory


COLS = ("current_inventory int, q50_daily double, q95_daily double, lead_time_days int, review_period_days int, moq int, "
        "unit_margin double, unit_holding_cost double")


def test_optimal_order_by_hand(spark):
    # equal margin and holding cost: service level 1/2, z = 0, so the target is q50 times the protection days
    rows = [(0, 10.0, 20.0, 2, 2, 5, 100.0, 100.0), (38, 10.0, 20.0, 2, 2, 5, 100.0, 100.0), (40, 10.0, 20.0, 2, 2, 5, 100.0, 100.0),
            (0, 3.0, 3.0, 0, 0, 10, 1500.0, 180.0), (90, 10.0, 10.0, 2, 2, 1, 50.0, 900.0)]
    got = [(r["protection_days"], r["target_stock"], r["recommended_order_qty"]) for r in
           inventory.optimal_order(spark.createDataFrame(rows, COLS).coalesce(1)).collect()]
    assert got == [(4, 40.0, 40), (4, 40.0, 5), (4, 40.0, 0), (1, 3.0, 10), (4, 40.0, 0)]


def test_optimal_order_invariants(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 80), rnd.random() * 30, rnd.random() * 50, rnd.randint(0, 4), rnd.randint(0, 4),
             rnd.choice([1, 5, 10]), rnd.choice([100.0, 1500.0, 50.0]), rnd.choice([0.0, 180.0, 900.0])) for _ in range(300)]
    for r in inventory.optimal_order(spark.createDataFrame(rows, COLS)).collect():
        need = r["target_stock"] - r["current_inventory"]
        order = r["recommended_order_qty"]
        assert order % r["moq"] == 0 and r["target_stock"] >= 0
        assert need - 0.01 <= order < max(need, 0) + r["moq"] + 0.01  # enough, and less than one pack too much
        odds = r["service_level"] / (1 - r["service_level"]) if r["unit_holding_cost"] else None
        assert odds is None or abs(odds - r["unit_margin"] / r["unit_holding_cost"]) < 1e-9 * odds
        mean = r["q50_daily"] * r["protection_days"]
        spread = r["q95_daily"] - r["q50_daily"]
        if spread <= 0:
            assert abs(r["target_stock"] - mean) <= 0.006            # no spread, no safety stock
        elif r["unit_holding_cost"] in (0.0, 180.0) and r["unit_margin"] == 1500.0:
            assert r["target_stock"] >= round(mean, 2)               # service above 1/2 adds stock


def test_inverse_cdf_accuracy(spark):
    from tillcast.functions.stats import inv_norm_cdf
    ps = [1e-4, 0.001, 0.02, 0.02425, 0.1, 0.5, 0.8929, 0.95, 0.975, 0.999, 0.9999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.select("p", inv_norm_cdf("p").alias("z")).collect():
        assert abs(r["z"] - NormalDist().inv_cdf(r["p"])) < 5e-8


def test_priority_and_invalid_costs(spark):
    df = spark.createDataFrame([(10, 100.0), (50, 100.0), (80, 100.0), (5, 0.0)], "inv int, tgt double")
    got = [r[0] for r in df.select(inventory.order_priority("inv", "tgt")).collect()]
    assert got == ["필수", "권장", "여유", "여유"]
    bad = spark.createDataFrame([(0.0, 1.0)], "u double, o double").select(inventory.service_level("u", "o"))
    try:
        bad.collect()
        raise AssertionError("expected an error")
    except Exception as e:  # noqa: BLE001
        assert "underage_cost" in str(e)


EVENTS = [
    # visitors, metres, main road, overlap, fit, hours, public -> score
    (9000, 50.0, False, 0.9, 1.0, 5.0, True, 100),   # 25 + 25 + 20 + 20 + 10
    (9000, 50.0, True, 0.9, 1.0, 5.0, True, 100),    # the distance part stays at 25
    (9000, 50.0, True, 0.9, 1.0, 5.0, False, 0),     # not public
    (0, 5000.0, False, 0.0, 0.0, 0.0, True, 1),
    (99, 2000.0, False, 0.1, 0.5, 1.0, True, 24),    # 0 + 5 + 5 + 10 + 4
    (100, 2000.0, True, 0.2, 0.5, 2.0, True, 42),    # 5 + 10 + 10 + 10 + 7
    (1500, 300.0, False, 0.4, -1.0, 0.0, True, 56),  # 20 + 20 + 15 + 0 + 1
    (2999, 100.5, True, 1.5, 2.0, 4.0, True, 95),    # 20 + 25 + 20 + 20 + 10
    (300, 1000.0, False, -0.5, 0.025, 0.0, True, 21),  # 10 + 10 + 0 + 0 + 1
    (700, 500.0, False, 0.7, 0.075, 1.0, True, 56),  # 15 + 15 + 20 + 2 + 4
]


def test_event_score_by_hand(spark):
    df = spark.createDataFrame(EVENTS, "v int, d double, m boolean, o double, f double, w double, p boolean, want int")
    for r in df.select("*", events.event_score("v", "d", "m", "o", "f", "w", "p").alias("s")).collect():
        assert r["s"] == r["want"], r


def test_naive_plan_matches_python_on_sf0001(spark):
    from conftest import SF
    from tillcast.plans import common, order_plan
    raw = common.raw(spark, SF)
    plan = {r["item_id"]: r for r in order_plan.naive_order_plan(raw).collect()}
    rows = sorted(raw.select("item_id", "date", "demand_qty", "current_inventory").collect(), key=lambda r: (r[0], r[1]))
    items = sorted({r[0] for r in rows})
    assert set(plan) == set(items)
    for it in items:
        hist = [r for r in rows if r[0] == it]
        tail = [r[2] for r in hist[-7:]]
        q50 = sum(tail) / len(tail)
        sd = (sum((x - q50) ** 2 for x in tail) / (len(tail) - 1)) ** 0.5 if len(tail) > 1 else 0.0
        q95 = q50 * 1.15 if sd == 0 else max(q50, q50 + 1.645 * sd)
        p = plan[it]
        assert abs(p["q50_daily"] - round(q50, 2)) <= 0.0051 and abs(p["q95_daily"] - round(q95, 2)) <= 0.0051
        z = NormalDist().inv_cdf(1500 / 1680)            # margin 1500 against holding cost 180
        target = 4 * q50 + z * 2 * (q95 - q50) / 1.645   # four protection days
        assert abs(p["target_stock"] - target) <= 0.016 and p["protection_days"] == 4
        assert abs(p["service_level"] - 1500 / 1680) <= 5e-5
        assert p["recommended_order_qty"] == max(0, 5 * math.ceil((target - hist[-1][3]) / 5))
        cover = hist[-1][3] / target
        assert p["priority"] == ("필수" if cover < 0.3 else "권장" if cover < 0.7 else "여유")
