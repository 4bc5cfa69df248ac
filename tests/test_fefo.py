"""FEFO operators against cases worked by hand, invariants, and brute force."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillcast.operators import fefo
from tillcast.operators.running import exclusive_prefix_sum, order_blocks


# worked by hand: (lots as (quantity, days to expiry), demand per day) -> (waste, fulfilled, lost)
BY_HAND = [
    ([], [1.0] * 7, (0, 0, 7)),
    ([(10, 20)], [1.0] * 7, (0, 7, 0)),
    ([(5, 2)], [1.0] * 7, (3, 2, 5)),                       # 2 sold on days 0 and 1, the rest expires on day 2
    ([(4, 0), (6, 9)], [2.0] * 7, (4, 6, 8)),               # the first lot is out on day 0, before any sale
    ([(3, 9), (3, 1)], [2.0] * 7, (1, 5, 9)),               # earliest expiry sells first: 2 of 3, then 1 expires
    ([(-2, 5), (2, 5)], [0.5, 1.5, 2.5, 0.0, 0.0, 0.0, 0.0], (0, 2, 2)),  # halves round to even: 0, 2, 2
    ([(8, -1)], [0.0] * 7, (8, 0, 0)),
]


def test_fefo_expected_waste_by_hand(spark):
    paths = spark.createDataFrame([(i, d) for i, (_, d, _) in enumerate(BY_HAND)], "item_id int, path array<double>")
    lots = spark.createDataFrame([(i, q, e) for i, (ls, _, _) in enumerate(BY_HAND) for q, e in ls], "item_id int, qty int, days_to_expire int")
    got = {r["item_id"]: (r["expected_waste_qty"], r["expected_sales_fulfilled_qty"], r["expected_lost_sales_qty"])
           for r in fefo.fefo_expected_waste(paths, lots, path_col="path", horizon=7).collect()}
    assert [got[i] for i in range(len(BY_HAND))] == [w for _, _, w in BY_HAND]


def test_fefo_expected_waste_invariants(spark):
    rnd = random.Random(11)
    rows, lots, want = [], [], {}
    for item in range(150):
        dem = [float(rnd.randint(0, 12)) for _ in range(7)]
        own = [(rnd.randint(0, 20), rnd.randint(-1, 10)) for _ in range(rnd.randint(0, 6))]
        rows.append((item, dem))
        lots += [(item, q, e) for q, e in own]
        want[item] = (sum(dem), sum(q for q, _ in own), sum(q for q, e in own if e <= 0), sum(q for q, e in own if e <= 6))
    got = fefo.fefo_expected_waste(spark.createDataFrame(rows, "item_id int, path array<double>"),
                                   spark.createDataFrame(lots, "item_id int, qty int, days_to_expire int"), path_col="path", horizon=7)
    for r in got.collect():
        demand, stock, dead, can_expire = want[r["item_id"]]
        waste, sold, lost = r["expected_waste_qty"], r["expected_sales_fulfilled_qty"], r["expected_lost_sales_qty"]
        assert sold + lost == demand                                # every demanded unit is sold or lost
        assert dead <= waste <= can_expire and sold <= stock - dead  # only what expires in time is waste
        assert waste + sold <= stock


def loop_deduction(batches, waste):
    out = {}
    for pid in {b[1] for b in batches}:
        rem = waste.get(pid, 0)
        for bid, _, exp, qty in sorted([b for b in batches if b[1] == pid and b[3] > 0], key=lambda b: (b[2], b[0])):
            take = min(qty, max(rem, 0))
            out[bid] = qty - take
            rem -= take
    return out


def test_fefo_deduction_matches_loop_with_hot_product(spark):
    rnd = random.Random(5)
    batches = []
    for bid in range(600):
        pid = 0 if rnd.random() < 0.4 else rnd.randint(1, 8)          # one hot product
        batches.append((bid, pid, rnd.randint(0, 12), rnd.randint(-1, 9)))
    waste = {pid: rnd.randint(0, 60) for pid in range(9)}
    b = spark.createDataFrame(batches, "batch_id long, product_id int, exp int, current_qty long") \
        .withColumn("expiration_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("exp")))
    w = spark.createDataFrame(list(waste.items()), "product_id int, quantity long")
    got = {r["batch_id"]: r["new_qty"] for r in fefo.fefo_deduction(b, w).collect()}
    exp = loop_deduction(batches, waste)
    for bid, q in exp.items():
        assert got[bid] == q, bid
    # non-positive batches are returned untouched
    for bid, _, _, qty in batches:
        if qty <= 0:
            assert got[bid] == qty


def test_prefix_sum_of_a_hot_key_is_cut_by_row_count(spark):
    """A third of the rows on one key, ids up to 1e11, one date: blocks stay near an even share, sums are exact."""
    n = 24_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.col("id") % 50).cast("int").alias("k"), F.lit("2024-01-01").alias("c"),
        (F.col("id") * 4_166_667).alias("id"), (F.col("id") % 7).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = order_blocks(df, ["k"], ["c", "id"]).groupBy("_blk").count().collect()
        got = exclusive_prefix_sum(df, keys=["k"], order=["c", "id"], value="v", out="p")
        wrong = got.withColumn("want", F.coalesce(F.sum("v").over(Window.partitionBy("k").orderBy("c", "id").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).where("p != want").count()
        assert (got.count(), wrong) == (n, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(blocks) == 8 and max(r["count"] for r in blocks) < 2 * n / 8


def test_prefix_sum_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 7), (3, 1, 1)], "k int, id long, v long")
    got = exclusive_prefix_sum(df, keys=["k"], order=["id"], value="v", out="p")
    assert sorted((r["k"] is None, r["id"], r["p"]) for r in got.collect()) == [(False, 1, 0), (True, 1, 0), (True, 2, 5)]
