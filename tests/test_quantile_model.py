"""Quantile boosting against a booster in plain Python; search over folds; packed trees; recursion is sane."""

import math
import pickle
import random

import numpy as np
from pyspark import RDD
from pyspark.sql import functions as F

from tillcast.operators import quantile

NUMS, ITEMS = ("lag_1", "trend_28d"), "abc"


def _rows(seed=5, n=360):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        item = ITEMS[rnd.randrange(3)]
        x, z = float(rnd.randint(0, 9)), float(rnd.randint(0, 4))
        out.append((i % 4 + 1, item, x, z, round(5 * ITEMS.index(item) + 2 * x + rnd.gauss(0, 3), 3)))
    return out


def _quantile(values, q):
    v = sorted(values)
    return v[min(max(math.ceil(q * len(v) - 1e-9) - 1, 0), len(v) - 1)]


def _plain_boost(rows, q, depth, rate, stages):
    """Trees of nested tuples by trying every split of every node."""
    y = [r[4] for r in rows]
    score = [_quantile(y, q)] * len(rows)
    cuts = {k: sorted({r[k] for r in rows})[:-1] for k in (2, 3)}
    splits = [("label", 1, c) for c in ITEMS] + [("cut", k, v) for k in (2, 3) for v in cuts[k]]
    right = lambda r, s: r[s[1]] == s[2] if s[0] == "label" else r[s[1]] > s[2]

    def grow(ids, level, g):
        if level == depth:
            return ("leaf", _quantile([y[i] - score[i] for i in ids], q))
        gains, total = [], sum(g[i] for i in ids)
        for s in splits:
            b = [i for i in ids if right(rows[i], s)]
            if 0 < len(b) < len(ids):
                sb = sum(g[i] for i in b)
                gains.append(((total - sb) ** 2 / (len(ids) - len(b)) + sb ** 2 / len(b) - total ** 2 / len(ids), s))
        top = max((x for x, _ in gains), default=0.0)
        found = next(s for x, s in gains if x >= top - 1e-9) if top > 1e-9 else None
        if found is None:
            return ("leaf", _quantile([y[i] - score[i] for i in ids], q))
        return ("split", found, grow([i for i in ids if not right(rows[i], found)], level + 1, g),
                grow([i for i in ids if right(rows[i], found)], level + 1, g))

    def value(node, r):
        while node[0] == "split":
            node = node[3] if right(r, node[1]) else node[2]
        return node[1]

    for _ in range(stages):
        tree = grow(list(range(len(rows))), 0, [q if a > b else q - 1 for a, b in zip(y, score)])
        score = [s + rate * value(tree, r) for s, r in zip(score, rows)]
    return score


def _frame(spark, rows):
    return spark.createDataFrame(rows, "tile int, item_id string, lag_1 double, trend_28d double, demand_qty double")


def test_models_equal_a_plain_booster(spark):
    rows = _rows()
    qm = quantile.train_quantile_models(_frame(spark, rows), feature_cols=("item_id", *NUMS), quantiles=(0.5, 0.95),
                                        by_quantile={0.5: {"max_depth": 2}, 0.95: {"max_depth": 3}}, n_stages=6, learning_rate=0.3)
    got = qm.predict(_frame(spark, rows), keep=("item_id", "lag_1", "trend_28d", "demand_qty")).collect()
    for q, depth in ((0.5, 2), (0.95, 3)):
        want = {r[1:]: s for r, s in zip(rows, _plain_boost(rows, q, depth, 0.3, 6))}
        for r in got:
            key = (r["item_id"], r["lag_1"], r["trend_28d"], r["demand_qty"])
            value = max(want[key], 0.0)
            if q == 0.5:
                assert abs(r["q50"] - value) < 1e-9, key
            else:
                assert abs(r["q95"] - max(value, r["q50"])) < 1e-9, key


def test_search_equals_plain_folds(spark):
    rows = _rows(seed=9)
    days = _frame(spark, rows).withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("tile")))
    tiles = spark.range(1, 5).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").cast("int").alias("tile"))
    grid = [{"n_stages": n, "learning_rate": 0.4, "max_depth": d} for d in (1, 2) for n in (2, 5)]
    # cut values come from all rows, so the folds are compared on values that every fold has
    found = quantile.search_and_fit(days.drop("tile"), tiles, grid=grid, quantiles=(0.5,), n_folds=3, feature_cols=("item_id", *NUMS))
    losses = {i: v for _, i, v in found.scores}
    for i, p in enumerate(grid):
        fold = []
        for k in (1, 2, 3):
            train, test = [r for r in rows if r[0] <= k], [r for r in rows if r[0] == k + 1]
            sub = quantile.train_quantile_models(_frame(spark, train), feature_cols=("item_id", *NUMS), quantiles=(0.5,), **p)
            fold.append(quantile.pinball_score(sub.predict(_frame(spark, test)), 0.5))
        assert abs(losses[i] - sum(fold) / 3) < 0.05 * losses[i], (i, losses[i], fold)
    best = min(losses, key=lambda i: (losses[i], i))
    assert found.chosen[0.5] == grid[best] and len(found.models.models[0.5].trees) == grid[best]["n_stages"]


def test_boosting_reduces_pinball(spark):
    rnd = random.Random(3)
    rows = [(str(i % 3), float(i % 7), float(rnd.gauss(10 + 5 * (i % 3) + (i % 7), 2))) for i in range(600)]
    df = spark.createDataFrame(rows, "item_id string, dow double, demand_qty double")
    qm = quantile.train_quantile_models(df, feature_cols=("item_id", "dow"), quantiles=(0.5, 0.95),
                                        n_stages=8, learning_rate=0.3, max_depth=3)
    pred = qm.predict(df.withColumn("date", F.lit(None).cast("date")))
    p0 = df.agg(F.avg(F.greatest(0.95 * (F.col("demand_qty") - 15), (0.95 - 1) * (F.col("demand_qty") - 15)))).first()[0]
    p = quantile.pinball_score(pred, 0.95)
    assert p < p0
    # q95 never below q50, both non-negative
    assert pred.where((F.col("q95") < F.col("q50")) | (F.col("q50") < 0)).count() == 0
    # shares of gain, over all features
    imp = qm.feature_importance()
    assert abs(sum(v for _, v, _ in imp) - 1) < 1e-9 and {n for n, _, _ in imp} <= {"item_id_0", "item_id_1", "item_id_2", "dow"}


def test_many_trees_score_in_one_projection(spark):
    """Hundreds of trees: the packed form has no code per tree to compile."""
    rnd = random.Random(2)
    trees = []
    for _ in range(300):
        trees.append({"f": [rnd.randrange(2) for _ in range(15)], "t": [rnd.random() for _ in range(15)],
                      "l": [rnd.choice([None, None, "a", "b"]) for _ in range(15)], "v": [rnd.gauss(0, 1) for _ in range(16)], "g": [0.0] * 15})
        trees[-1]["f"] = [0 if x is not None else f for f, x in zip(trees[-1]["f"], trees[-1]["l"])]
    m = quantile.QuantileBoostModel(0.5, 7.0, 0.05, trees)
    rows = [(i, "abc"[i % 3], rnd.random(), None if i % 11 == 0 else rnd.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, item_id string, x double, z double")
    qm = quantile.QuantileModels({0.5: m}, ("item_id", "x", "z"))
    got = {r["id"]: r["v"] for r in df.select("id", qm.expression(0.5, F.col).alias("v")).collect()}
    for i, item, x, z in rows:
        want = 7.0
        for t in trees:
            at = 0
            for _ in range(4):
                f, label = t["f"][at], t["l"][at]
                v = (x, z)[f]
                right = item == label if label is not None else not (v is not None and v <= t["t"][at])
                at = 2 * at + 1 + right
            want += 0.05 * t["v"][at - 15]
        assert abs(got[i] - want) < 1e-9


def test_thinned_leaf_keeps_its_quantiles():
    rng = np.random.default_rng(1)
    v = rng.normal(size=50000)
    x = quantile.thinned(np.stack([np.zeros(50000), v, np.ones(50000)]), 1024)
    assert x.shape[1] == 1024 and abs(x[2].sum() - 50000) < 1e-6
    tree = quantile.Tree(1)
    for q in (0.05, 0.5, 0.95):
        quantile.leaf_quantiles(tree, x, q)
        assert abs((v <= tree.leaf[0]).mean() - q) < 2 / 1024


def test_driver_gets_splits_and_leaves_and_no_counts(spark, monkeypatch):
    """Whatever the number of partitions: the same trees, and some numbers for each node on the driver."""
    rnd = random.Random(9)
    rows = [(1, r[1], rnd.random(), rnd.random(), r[4]) for r in _rows(9)]
    frame, got, trees = _frame(spark, rows), [], []
    plain = RDD.collect

    def spy(rdd):
        out = plain(rdd)
        got.append(len(pickle.dumps(out)))
        return out

    monkeypatch.setattr(RDD, "collect", spy)
    for part_rows, parts in ((1 << 18, 1), (90, 4), (18, 20)):
        monkeypatch.setattr(quantile, "PART_ROWS", part_rows)
        got.clear()
        qm = quantile.train_quantile_models(frame, feature_cols=("item_id", *NUMS), quantiles=(0.5, 0.95), n_stages=3, max_depth=3)
        trees.append([qm.models[q].trees for q in (0.5, 0.95)])
        assert len(got) == 3 * 4 and max(got) < 1500, (parts, got)
    assert trees[0] == trees[1] == trees[2]
