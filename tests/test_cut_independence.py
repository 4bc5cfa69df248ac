"""Results do not depend on how the input is cut into files, batches, partitions or shops."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tillcast import session, tables
from tillcast.operators import features, running
from tillcast.sources import pos
from tillcast.streaming import incremental

D = dt.date


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_daily_demand_over_files(spark, tmp_path, parts):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("double").alias("qty"),
        F.col("l_extendedprice").cast("double").alias("amount"), (F.col("l_returnflag") == "R").alias("is_return"))
    lines.repartition(parts).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    products = lines.select("product_id").distinct().withColumn("item_id", F.lit("x"))
    incremental.daily_demand_stream(stream, products, f"{tmp_path}/out", f"{tmp_path}/ck")
    got = incremental.read_daily_demand(spark, f"{tmp_path}/out").agg(F.sum("demand_qty")).first()[0]
    assert got == lines.where("not is_return").agg(F.sum("qty")).first()[0]


def test_weather_over_batches(spark, tmp_path):
    rows = [("r", "20240101", "0600", "TMP", "3", 1), ("r", "20240101", "0600", "PCP", "2.0mm", 2), ("r", "20240101", "0600", "PTY", "1", 3),
            ("r", "20240101", "0600", "TMP", "4", 4), ("q", "20240101", "0600", "TMP", "1", 5)]
    df = spark.createDataFrame(rows, "region string, fcst_date string, fcst_time string, category string, fcst_value string, seq long")
    found = []
    for k, cuts in enumerate(([rows], [rows[:3], rows[3:]])):
        for i, c in enumerate(cuts):
            spark.createDataFrame(c, df.schema).coalesce(1).write.parquet(f"{tmp_path}/in{k}/f{i}")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in{k}/*")
        incremental.weather_stream(stream, f"{tmp_path}/out{k}", f"{tmp_path}/ck{k}")
        found.append(sorted(map(tuple, incremental.read_weather(spark, f"{tmp_path}/out{k}").collect())))
    assert found[0] == found[1] and len(found[0]) == 2


def test_global_row_number_keeps_every_row(spark):
    df = spark.range(300_000).select((F.col("id") * 7919 % 300_007).alias("k"), F.repeat(F.lit("x"), 50).alias("wide"))
    out = running.global_row_number(df, ["k"], "n")
    assert out.agg(F.count("*"), F.min("n"), F.max("n"), F.countDistinct("n")).first()[:] == (300_000, 1, 300_000, 300_000)


def test_features_do_not_mix_shops(spark):
    rows = [(s, "i", D(2024, 1, d), float(v * 1000 ** (s == "b")), 0.0, 0.0, 0, 0, 0.0) for s in "ab" for d, v in ((1, 1), (2, 2), (3, 3))]
    df = spark.createDataFrame(rows, "shop string, item_id string, date date, demand_qty double, temp_c double, rain_mm double, "
                                     "is_holiday int, promo int, event_score_100 double")
    hol = spark.createDataFrame([(D(2024, 2, 20),)], "date date")
    out = {(r["shop"], r["date"].day): r for r in features.create_features(df, strict=False, shop_cols=("shop",), holidays=hol).collect()}
    assert len(out) == 6
    assert out[("a", 2)]["lag_1"] == 1.0 and out[("b", 2)]["lag_1"] == 1000.0
    assert out[("a", 1)]["days_to_holiday"] == 50 and out[("b", 1)]["days_to_holiday"] == 50


def test_a_folder_of_parts_is_one_source(spark, tmp_path):
    spark.createDataFrame([(f"2024-01-{d:02d}", "x", 1.0) for d in range(1, 21)], "date string, item_id string, demand_qty double") \
        .repartition(4).write.option("header", True).csv(f"{tmp_path}/sales")
    df, path, _ = pos.first_valid_source(spark, f"{tmp_path}/sales/*.csv")
    assert path.endswith("/sales") and df.count() == 20


def test_checkpoint_folder_rules(spark, monkeypatch):
    own = spark.sparkContext.getCheckpointDir()
    session.checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == own  # never replaced

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key):
                raise KeyError(key)

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
