"""Upsert helpers and the fold-based grid search."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tillcast.operators import demand, features, quantile, splits, upsert
from tillcast.plans import model_run


def test_upsert_patch_delete_reset_overlay(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "id int, name string, qty int")
    u = spark.createDataFrame([(2, "B", 21), (4, "d", 40)], "id int, name string, qty int")
    assert sorted(map(tuple, upsert.upsert(t, u, ["id"], [F.col("qty").desc()]).collect())) == [(1, "a", 10), (2, "B", 21), (3, "c", 30), (4, "d", 40)]
    twice = u.unionByName(spark.createDataFrame([(2, "late", 99)], "id int, name string, qty int"))
    assert [r["qty"] for r in upsert.upsert(t, twice, ["id"], [F.col("qty").desc()]).where("id = 2").collect()] == [99]
    p = upsert.patch(t, spark.createDataFrame([(3, 5)], "id int, qty int"), ["id"])
    assert sorted(map(tuple, p.collect())) == [(1, "a", 10), (2, "b", 20), (3, "c", 5)]
    d = upsert.delete_keys(t, spark.createDataFrame([(1,)], "id int"), ["id"])
    assert sorted(r["id"] for r in d.collect()) == [2, 3]
    r = upsert.reset(t)
    assert r.count() == 0 and r.schema == t.schema
    old = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 3), 3.0)], "date date, value double")
    new = spark.createDataFrame([(dt.date(2024, 1, 1), 9.0), (dt.date(2024, 1, 3), 7.0), (dt.date(2024, 1, 4), 4.0)],
                                "date date, value double")
    got = {r["date"].day: r["value"] for r in upsert.overlay(old, new, "2024-01-02").collect()}
    assert got == {1: 1.0, 3: 7.0, 4: 4.0}
    latest = upsert.dedupe_latest(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, ts int, v string"),
                                  ["k"], [F.col("ts").desc()])
    assert [r["v"] for r in latest.collect()] == ["y"]


def test_grid_search_over_date_folds(spark):
    rnd = random.Random(0)
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=k), it, float(10 + 5 * (k % 7 == 5) + rnd.randint(0, 3)))
            for it in ("a", "b") for k in range(80)]
    raw = demand.enrich_daily(spark.createDataFrame(rows, "date date, item_id string, demand_qty double"))
    feat = features.create_features(raw)
    tiles = splits.date_tiles(feat, n_tiles=3)
    assert sorted(r["tile"] for r in tiles.select("tile").distinct().collect()) == [1, 2, 3]
    grid = [{"n_stages": 2, "learning_rate": 0.1, "max_depth": 2}, {"n_stages": 3, "learning_rate": 0.5, "max_depth": 3}]
    best = quantile.grid_search(feat, tiles, quantile=0.5, grid=grid, n_folds=2)
    assert best in grid
    assert splits.run_test_days(100) == 28 and splits.run_test_days(20) == 5 and splits.run_test_days(2) == 1


def test_job_searches_its_settings(spark, monkeypatch):
    assert [(p["max_depth"], p["n_stages"], p["learning_rate"]) for p in model_run.SEARCH_GRID] == [
        (3, 150, 0.05), (3, 300, 0.05), (4, 150, 0.05), (4, 300, 0.05)]
    rnd = random.Random(1)
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=k), it, float(10 + 30 * (k % 7 == 5) + rnd.randint(0, 2)))
            for it in ("a", "b") for k in range(130)]
    raw = demand.enrich_daily(spark.createDataFrame(rows, "date date, item_id string, demand_qty double"))
    poor, good = {"n_stages": 1, "learning_rate": 0.01, "max_depth": 2}, {"n_stages": 4, "learning_rate": 0.5, "max_depth": 2}
    monkeypatch.setattr(model_run, "SEARCH_GRID", [poor, {**good, "n_stages": 1}, good])
    run = model_run.fit_and_evaluate(raw)
    assert run.params[0.5] == good and len(run.models.models[0.5].trees) == 4 and run.models.models[0.5].learning_rate == 0.5
    # a setting with fewer stages is the start of the longer fit
    two = quantile.train_quantile_models(run.train, quantiles=(0.5,), **{**good, "n_stages": 2}).models[0.5]
    assert [{k: t[k] for k in "ftlv"} for t in run.models.models[0.5].first(2).trees] == [{k: t[k] for k in "ftlv"} for t in two.trees]
    # the same rows and settings take the stored run, others don't
    assert model_run.fit_and_evaluate(raw).folder == run.folder
    assert model_run.fit_and_evaluate(raw.where(F.col("date") < dt.date(2024, 5, 1))).folder != run.folder
    assert sorted(r["n_stages"] for r in run.search.where("quantile = 0.5").collect()) == [1, 1, 4]
    # M3: under 60 rows nothing is searched
    monkeypatch.setattr(model_run, "BASE_PARAMS", poor)
    short = model_run.fit_models(run.train.limit(59), allow_short_history=True)
    assert short.chosen == {0.5: poor, 0.95: poor} and short.scores == []
