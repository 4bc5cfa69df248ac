"""The inputs of the registered queries reach every branch; run history; detected tags."""

from pyspark.sql import functions as F

from conftest import SF
from tillcast.operators import demand, views, weather
from tillcast.plans import model_run
from tillcast.plans.registry import load_all

QUERIES, _ = load_all()


def test_rejects_of_every_kind(spark):
    for name, kinds in (("waste_validation_rejects", 3), ("inventory_validation_rejects", 3)):
        df = QUERIES[name](spark, SF)
        assert df.select("reject_reason").distinct().where("reject_reason is not null").count() == kinds
        assert df.where("accepted").count() > 0


def test_every_keyword_rule_is_met(spark):
    df = QUERIES["request_keyword_hits"](spark, SF)
    said = {w for r in df.select("labels").distinct().collect() for w in r["labels"].split(", ") if w}
    assert len(said) == 7


def test_named_batches_lose_and_exceed(spark):
    df = QUERIES["named_batch_waste"](spark, SF)
    assert df.where("new_qty < current_qty").count() > 0 and df.where("excess_waste > 0").count() > 0


def test_run_history_is_newest_first_and_starts_from_the_dashboard(spark):
    runs = spark.createDataFrame([("A", 1, 10, "비", "", "x", 7), ("A", 2, 4, "", None, "y", 7)],
                                 "region string, run_ts int, weight_pct int, weather_factors string, event_factors string, impact_summary string, dash int")
    got = [(r["run_ts"], r["prev_value"], r["change"], r["events"]) for r in views.run_log_view(runs, first="dash").collect()]
    assert got == [(2, 10, -6, "선택 안함"), (1, 7, 3, "선택 안함")]


def test_detected_tags_join_the_chosen_ones(spark):
    chosen = spark.createDataFrame([("R1", "d", ["눈"]), ("R2", "d", None), ("R3", "d", ["폭염"])], "region string, base_date string, weather_tags array<string>")
    auto = spark.createDataFrame([("R1", "d", ["비", "눈"]), ("R2", "d", ["비"])], "region string, base_date string, weather_tags array<string>")
    got = {r["region"]: r["weather_tags"] for r in weather.with_detected_tags(chosen, auto).collect()}
    assert got == {"R1": ["눈", "비"], "R2": ["비"], "R3": ["폭염"]}


def test_feed_region_is_the_files_name(spark, tmp_path):
    (tmp_path / "seoul.json").write_text('{"response": {"header": {"resultCode": "00"}, "body": {"items": {"item": '
                                         '[{"fcstDate": "20240101", "fcstTime": "0900", "category": "TMP", "fcstValue": "3"}]}}}}')
    raw = spark.read.json(str(tmp_path), multiLine=True)
    assert weather.parse_feed_json(raw).select("region").distinct().collect() == [("seoul",)]


def test_short_history_takes_the_naive_plan(spark):
    days = spark.range(9).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                                 F.lit("tea").alias("item_id"), F.lit(4.0).alias("demand_qty"), F.lit(8.0).alias("sales_amount"), F.lit(0).alias("promo"))
    job = model_run.plan_job(demand.enrich_daily(days), allow_short_history=True)
    row = job.plan.first()
    assert job.run is None and (row["item_id"], row["q50_daily"], row["q95_daily"]) == ("tea", 4.0, 4.6)
    assert row["forecast_q50_30d"] == [4.0] * 30


def test_csv_roundtrip_skips_an_invalid_source(spark, monkeypatch):
    from conftest import SF
    from tillcast.plans import q_io
    seen, real = [], q_io.pos.first_valid_source
    monkeypatch.setattr(q_io.pos, "first_valid_source", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    assert q_io.q_csv_roundtrip(spark, SF).limit(1).count() == 1
    _, path, skipped = seen[0]
    assert path.endswith("/export") and [(p.rsplit("/", 1)[1], bool(why)) for p, why in skipped] == [("broken_export", True)]
