"""Streaming: equals batch, drops rows beyond the watermark, replays idempotently."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from tillcast.streaming import incremental


def _lines(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, product_id long, qty double, amount double, is_return boolean")


def test_late_rows_are_dropped_and_replay_is_idempotent(spark):
    base = tempfile.mkdtemp(dir="/tmp")
    src = base + "/src"
    d = dt.datetime
    _lines(spark, [(d(2024, 1, 1, 9), 1, 2.0, 10.0, False), (d(2024, 1, 10, 9), 1, 3.0, 15.0, False)]) \
        .coalesce(1).write.parquet(src + "/f1")
    _lines(spark, [(d(2024, 1, 2, 9), 1, 100.0, 1.0, False),            # 8 days late: beyond the watermark
                   (d(2024, 1, 9, 12), 1, 4.0, 20.0, False), (d(2024, 1, 10, 10), 2, 1.0, 1.0, True)]) \
        .coalesce(1).write.parquet(src + "/f2")
    schema = spark.read.parquet(src + "/f1").schema
    products = spark.createDataFrame([(1, "latte"), (2, "mocha")], "product_id long, item_id string")

    def run(out, ck):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
        incremental.daily_demand_stream(stream, products, out, ck, late_after="2 days")
        return {(str(r["date"]), r["item_id"]): r["demand_qty"] for r in incremental.read_daily_demand(spark, out).collect()}

    out, ck = base + "/out", base + "/ck"
    got = run(out, ck)
    assert got[("2024-01-10", "latte")] == 3.0
    assert got[("2024-01-09", "latte")] == 4.0
    assert ("2024-01-02", "latte") not in got            # late row dropped
    assert got[("2024-01-01", "latte")] == 2.0
    # rerunning on the same checkpoint processes nothing new and changes nothing
    assert run(out, ck) == got


def test_waste_stream_equals_batch_deduction(spark):
    base = tempfile.mkdtemp(dir="/tmp")
    wastes = spark.createDataFrame([(1, 3), (1, 4), (2, 1)], "product_id long, quantity long")
    wastes.coalesce(1).write.parquet(base + "/w")
    batches = spark.createDataFrame([(10, 1, dt.date(2024, 1, 2), 5), (11, 1, dt.date(2024, 1, 1), 4),
                                     (12, 2, dt.date(2024, 1, 3), 2)],
                                    "batch_id long, product_id long, expiration_date date, current_qty long")
    stream = spark.readStream.schema(wastes.schema).parquet(base + "/w")
    incremental.waste_stream(stream, base + "/log", base + "/ck")
    got = {r["batch_id"]: r["new_qty"] for r in incremental.read_batches_after_waste(spark, batches, base + "/log").collect()}
    assert got == {11: 0, 10: 2, 12: 1}


def _log(spark, path, batches):
    for batch_id, rows in batches.items():
        incremental._append_batch(rows, batch_id, path)


def test_compacted_log_reads_the_same_also_after_a_replay(spark):
    base = tempfile.mkdtemp(dir="/tmp")
    day = dt.date(2024, 1, 1)
    batches = {b: spark.createDataFrame([(day, i, float(b + 1), 10.0) for i in ("a", "b")[:b + 1]],
                                        "date date, item_id string, demand_qty double, sales_amount double") for b in range(5)}
    out = base + "/x1"
    _log(spark, out, batches)
    read = lambda: sorted(tuple(r) for r in incremental.read_daily_demand(spark, out).collect())
    want = read()
    assert want == [(day, "a", 15.0, 50.0), (day, "b", 14.0, 40.0)]
    for upto in (1, 3, 3):
        incremental.compact(spark, out, incremental.FOLD_DEMAND, upto)
        assert read() == want and incremental.live_log(spark, out).count() == 2 * (4 - upto) + 2
    _log(spark, out, {3: batches[3]})            # batches that the base holds come again
    _log(spark, out, {1: batches[1], 4: batches[4]})
    assert read() == want
    incremental.compact(spark, out, incremental.FOLD_DEMAND, 4)
    assert read() == want and incremental.live_log(spark, out).count() == 2


def test_compacted_weather_keeps_the_last_value(spark):
    out = tempfile.mkdtemp(dir="/tmp") + "/x3"
    row = lambda v, seq: spark.createDataFrame([("R1", "20240101", "0600", "TMP", v, seq)],
                                               "region string, fcst_date string, fcst_time string, category string, fcst_value string, seq long")
    _log(spark, out, {0: row("9", 1), 1: row("3", 2)})
    want = incremental.read_weather(spark, out).collect()
    incremental.compact(spark, out, incremental.FOLD_WEATHER, 1)
    assert incremental.read_weather(spark, out).collect() == want and want[0]["temperature"] == 3.0
    _log(spark, out, {2: row("-1", 3)})
    assert incremental.read_weather(spark, out).first()["temperature"] == -1.0


def test_a_failed_watermark_read_is_raised(spark):
    path = tempfile.mkdtemp(dir="/tmp")
    assert incremental._watermark_before(spark, path + "/none", 1, 10) is None
    spark.createDataFrame([(1,)], "batch_id long").write.parquet(path + "/odd")
    try:
        incremental._watermark_before(spark, path + "/odd", 2, 10)
    except Exception as e:
        assert "max_ts" in str(e)
    else:
        raise AssertionError("no failure")
