"""Ingest edge cases: normalized CSV, POS exports, GeoJSON regions, file ranking, sinks."""

import json
import os
import random
import tempfile

from pyspark.sql import functions as F

from tillcast.sources import pos, regions, sinks


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_normalized_csv_case_and_junk(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    p = os.path.join(d, "daily.csv")
    _write(p, "﻿Date,ITEM_ID,Demand_Qty\n2024-01-01, latte ,3\n2024-01-02,latte,x\n,latte,4\n2024-01-03,mocha,1,\n")
    df = pos.read_csv(spark, p)
    assert pos.layout(df) == "normalized"
    out = pos.load_daily_demand(df).orderBy("date").collect()
    assert [(str(r["date"]), r["item_id"], r["demand_qty"]) for r in out] == [("2024-01-01", "latte", 3.0),
                                                                              ("2024-01-03", "mocha", 1.0)]
    assert all(r["sales_amount"] is None for r in out)


def test_pos_text_order_cn_uses_sle_co_and_drops_returns(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    p = os.path.join(d, "pos.csv")
    rows = [
        "SALES_DE,SALES_CD,LCLAS_CD,MLSFC_CD,SCLAS_CD,ORDER_CN,SLE_CO,PAYMENT_PRICE",
        '20240101,매출, beverage ,커피,에스프레소,일반,1.00000,"3,200.00"',
        "20240101,매출,Beverage,커피,에스프레소,케이크 예약,2.00000,6400",
        "20240101,반품,Beverage,커피,에스프레소,일반,1.00000,3200",
        "20240101,매출,Food,빵,크루아상,일반,5.00000,9000",
        "2024010207,매출,BEVERAGE,nan,,일반,1.00000,1000",
    ]
    _write(p, "\n".join(rows) + "\n")
    df = pos.read_csv(spark, p)
    q = pos.quantity_source(df).collect()[0]
    assert q["qty_source"] == "SLE_CO"
    out = {(str(r["date"]), r["item_id"]): (r["demand_qty"], r["sales_amount"]) for r in pos.load_pos(df).collect()}
    assert out[("2024-01-01", "커피-에스프레소")] == (3.0, 9600.0)
    assert ("2024-01-02", "nan-") in out or len(out) == 2


def test_pos_title_precedence(spark):
    df = spark.createDataFrame([("20240105", "Beverage", "1", "A", "B", "Cold Brew"), ("20240105", "Beverage", "2", "A", "B", " ")],
                               "SALES_DE string, LCLAS_CD string, ORDER_CN string, MLSFC_CD string, SCLAS_CD string, TITLE string")
    out = pos.load_pos(df).collect()
    assert [(r["item_id"], r["demand_qty"]) for r in out] == [("Cold Brew", 1.0)]


def test_geojson_first_vertex(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    p = os.path.join(d, "regions.geojson")
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"adm_cd": "1", "adm_nm": "A"},
         "geometry": {"type": "Polygon", "coordinates": [[[126.123456, 37.654321], [127.0, 37.0]]]}},
        {"type": "Feature", "properties": {"adm_cd": "2", "adm_nm": "B"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[[[129.00005, 35.1], [129.1, 35.2]]]]}},
        {"type": "Feature", "properties": {"adm_cd": "3"}, "geometry": {"type": "Polygon", "coordinates": []}},
    ]}
    _write(p, json.dumps(fc))
    got = sorted((r["id"], r["name"], r["lat"], r["lon"]) for r in regions.regions_from_geojson(spark, p).collect())
    assert got == [("1", "A", 37.6543, 126.1235), ("2", "B", 35.1, 129.0001)]


def test_nearest_region_matches_brute_force(spark):
    import random
    rnd = random.Random(9)
    regs = [(str(i), f"r{i}", 33 + rnd.random() * 5, 125 + rnd.random() * 5) for i in range(60)]
    pts = [(i, 30 + rnd.random() * 12, 120 + rnd.random() * 15) for i in range(200)]
    rdf = spark.createDataFrame(regs, "id string, name string, lat double, lon double")
    pdf = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {r["id"]: r["region_id"] for r in regions.nearest_region(pdf, rdf).collect()}
    assert len(got) == len(pts)
    for pid, la, lo in pts:
        best = min(regs, key=lambda r: ((r[2] - la) ** 2 + (r[3] - lo) ** 2, r[0]))
        assert got[pid] == best[0]


def test_candidate_files_rank(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    for name in ("(sample)data.csv", "a.csv", "b.csv"):
        _write(os.path.join(d, name), "date,item_id,demand_qty\n")
    os.utime(os.path.join(d, "a.csv"), (1, 1))
    ranked = [os.path.basename(r["path"]) for r in pos.candidate_files(spark, d + "/*.csv").orderBy("rank").collect()]
    assert ranked == ["b.csv", "a.csv", "(sample)data.csv"]


def test_csv_sink_turns_arrays_into_json(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    df = spark.createDataFrame([("x", [1.0, 2.0])], "item_id string, path array<double>")
    sinks.write_csv(df, d + "/out")
    back = spark.read.option("header", True).csv(d + "/out").collect()
    assert back[0]["path"] == "[1.0,2.0]"
    assert sinks.report_range("2024-01-01") == ("2024-01-01", "2024-01-08")
    assert sinks.report_range("2024-01-05", "2024-01-01") == ("2024-01-05", "2024-01-05")


def test_separator_sniffing(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    p = os.path.join(d, "semi.csv")
    _write(p, "date;item_id;demand_qty;sales_amount\n2024-01-01;a;2;1,5\n2024-01-01;a;3;2\n")
    df = pos.read_csv(spark, p, sep="auto")
    out = pos.load_daily_demand(df).collect()                        # normalized rows are not re-aggregated
    assert sorted((r["item_id"], r["demand_qty"]) for r in out) == [("a", 2.0), ("a", 3.0)]
    assert pos.sniff_separator(spark, p) == ";"


def test_month_partitioned_sink_prunes(spark):
    import datetime as dt
    d = tempfile.mkdtemp(dir="/tmp")
    rows = [(dt.date(2024, m, 10), "a", float(m)) for m in range(1, 7)]
    df = spark.createDataFrame(rows, "date date, item_id string, demand_qty double")
    sinks.write_by_month(df, d + "/daily")
    r = sinks.read_months(spark, d + "/daily", "2024-03-01", "2024-04-30")
    assert sorted(x["demand_qty"] for x in r.collect()) == [3.0, 4.0]
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan.split("PartitionFilters")[1][:200]


def test_nearest_region_with_a_dense_city_and_far_points(spark):
    rnd = random.Random(11)
    city = [(f"c{i:04d}", 37.5 + rnd.random() * 1e-3, 127.0 + rnd.random() * 1e-3) for i in range(600)]
    wide = [(f"w{i:03d}", rnd.uniform(33, 39), rnd.uniform(124, 131)) for i in range(60)]
    same = [(f"s{i}", 35.0, 128.0) for i in range(40)]                                   # one place, many ids
    regs = city + wide + same
    pts = [(i, 37.5005, 127.0005) for i in range(200)] + [(1000 + i, rnd.uniform(-60, 60), rnd.uniform(-170, 170)) for i in range(200)]
    pts += [(2000 + i, 37.5 + rnd.random() * 1e-3, 127.0 + rnd.random() * 1e-3) for i in range(200)] + [(3000, 35.0, 128.0)]
    pdf = spark.createDataFrame(pts + [(4000, None, 1.0)], "id long, lat double, lon double")
    rdf = spark.createDataFrame([(i, i.upper(), a, b) for i, a, b in regs], "id string, name string, lat double, lon double")
    got = {r["id"]: (r["region_id"], r["region_name"]) for r in regions.nearest_region(pdf, rdf, most=5).collect()}
    for i, a, b in pts:
        best = min(regs, key=lambda r: ((a - r[1]) * (a - r[1]) + (b - r[2]) * (b - r[2]), r[0]))[0]
        assert got[i] == (best, best.upper()), i
    assert len(got) == len(pts)
    assert regions.nearest_region(pdf, rdf.limit(0)).count() == 0


def test_large_geojson_in_many_tasks_equals_the_whole_reader(spark, tmp_path):
    feats = []
    for i in range(3000):
        ring = [[125 + i / 1000, 33.123456 + i / 500], [126.0, 34.0], [125.5, 34.5]]
        multi = i % 3 == 0
        f = {"type": "Feature", "properties": None if i % 50 == 7 else {"adm_cd": str(i), "adm_nm": f'n "{i}" {{x}}'},
             "geometry": None if i % 50 == 9 else {"type": "MultiPolygon" if multi else "Polygon", "coordinates": [[ring]] if multi else [ring]}}
        if i % 50 == 11:
            f["geometry"] = {"type": "Point", "coordinates": [1, 2]}
        feats.append(f)
    path = str(tmp_path / "one.geojson")
    with open(path, "w", encoding="utf-8") as fh:
        json.dump({"type": "FeatureCollection", "features": feats}, fh)
    whole = sorted(map(tuple, regions.regions_from_geojson(spark, path).collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = regions.regions_from_large_geojson(spark, path)
        assert df.rdd.getNumPartitions() > 8
        assert sorted(map(tuple, df.collect())) == whole and len(whole) > 2700
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_gate_skips_bad_sources_with_reasons(spark, tmp_path):
    days = [f"2024-01-{k:02d}" for k in range(1, 26)]
    write = lambda name, lines: (tmp_path / name).write_text("\n".join(lines), encoding="utf-8")
    write("good.csv", ["\ufeffDate,Item_ID,Demand_Qty"] + [f'{d},"a, b",{i}' for i, d in enumerate(days)])
    write("pos.csv", ["SALES_DE,LCLAS_CD,ORDER_CN,SALES_CD,MLSFC_CD,SCLAS_CD,SLE_CO,PAYMENT_PRICE"]
          + [f"{d.replace('-', '')},beverage,x,sale,m,s,2,10" for d in days] + ["20240101,food,1,sale,m,s,2,10"])
    write("short.csv", ["date,item_id,demand_qty", "2024-01-01,a,1"])
    write("wrong.csv", ["foo,bar", "1,2"])
    write("empty.csv", ["", ""])
    for i, name in enumerate(("good.csv", "pos.csv", "short.csv", "wrong.csv", "empty.csv")):
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))               # the last is the newest
    rows, verdicts = pos.gated_source(spark, f"{tmp_path}/*.csv")
    seen = {os.path.basename(r["source"]): (r["rows"], r["ok"], r["reason"]) for r in verdicts.collect()}
    assert seen == {"good.csv": (25, True, None), "pos.csv": (25, True, None), "short.csv": (1, False, "insufficient history per item: min_item_days=1"),
                    "wrong.csv": (0, False, "no valid rows"), "empty.csv": (0, False, "no valid rows")}
    got = sorted(map(tuple, rows.collect()))                                              # the newest that passes: the POS file
    assert len(got) == 25 and {(r[1], r[2], r[3]) for r in got} == {("m-s", 2.0, 10.0)}
    os.utime(tmp_path / "good.csv", (1_800_000_000, 1_800_000_000))
    rows, _ = pos.gated_source(spark, f"{tmp_path}/*.csv")
    assert {r["item_id"] for r in rows.collect()} == {"a, b"} and rows.count() == 25
