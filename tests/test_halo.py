"""Windows over blocks with halo rows equal windows by series, with a third of all rows on one series."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillcast import fixed
from tillcast.operators import demand, features, halo

SCHEMA = "date date, item_id string, demand_qty double"


def _series(spark, lengths, seed=1):
    rnd = random.Random(seed)
    start = dt.date(2020, 1, 1)
    rows = [(start + dt.timedelta(days=k), item, float(rnd.randint(0, 50))) for item, n in lengths.items() for k in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def test_blocks_equal_series(spark):
    df = _series(spark, {"hot": 400} | {f"i{k}": 3 + 7 * k for k in range(12)} | {"one": 1})
    build = lambda w: {"lag_1": F.lag("demand_qty", 1).over(w), "lag_28": F.lag("demand_qty", 28).over(w),
                       "sum_14": F.sum("demand_qty").over(w.rowsBetween(-14, -1)), "n_28": F.count("demand_qty").over(w.rowsBetween(-28, -1))}
    want = sorted(map(tuple, df.withColumns(build(Window.partitionBy("item_id").orderBy("date"))).collect()), key=repr)
    for blocks in (1, 7, 60, 300):  # 300: blocks shorter than the frames, so a halo comes from several
        got = halo.over_blocks(df, ["item_id"], "date", 28, build, blocks)
        assert sorted(map(tuple, got.collect()), key=repr) == want, blocks


def test_a_hot_series_is_spread(spark):
    df = _series(spark, {"hot": 2000} | {f"i{k}": 40 for k in range(100)})
    sizes = [r["count"] for r in halo.with_halo(df, ["item_id"], "date", 28, 30).groupBy("item_id", halo.BLOCK).count().collect()]
    assert max(sizes) <= 28 + 2 * 6000 / 30


def test_strict_features_from_blocks(spark):
    raw = demand.enrich_daily(_series(spark, {"a": 150, "b": 60, "c": 20}, seed=3))
    cols = ["date", "item_id", *[c for c in fixed.FEATURE_COLUMNS if c != "item_id"]]
    norm = lambda f: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in f.select(*cols).collect())
    assert norm(features.create_features(raw, blocks=9)) == norm(features.create_features(raw))
