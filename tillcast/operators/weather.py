"""Weather feed operators (S10 parse, A9, A10, G1, J11, P22, P23, R4, U3, U4).

Long forecast rows (region, fcst_date, fcst_time, category, fcst_value,
seq) are pivoted with conditional ``max_by`` aggregates keyed by arrival
order, which is exactly "last write wins" without a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast import fixed
from tillcast.functions.dates import as_of_date
from tillcast.functions.numeric import pty_code, rain_mm
from tillcast.functions.text import pty_text


def parse_feed_json(raw: DataFrame, region: str | None = None) -> DataFrame:
    """A landed forecast response (``response.body.items.item[]``) -> long rows.

    ``raw`` is ``spark.read.json(path, multiLine=True)``; the region is the column of that name, or else
    the file's name without its ending; only responses with
    result code '00' are used.  ``seq`` keeps the item order for last-write-wins.
    """
    ok = raw.where(F.col("response.header.resultCode") == "00")
    source = F.col(region) if region else F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/.]*)?$", 1)
    items = ok.select(source.alias("source"),
                      F.posexplode("response.body.items.item").alias("pos", "it"))
    return items.select(
        F.col("source").alias("region"),
        F.col("it.fcstDate").cast("string").alias("fcst_date"),
        F.col("it.fcstTime").cast("string").alias("fcst_time"),
        F.col("it.category").alias("category"),
        F.col("it.fcstValue").cast("string").alias("fcst_value"),
        F.col("pos").cast("long").alias("seq"))


def weather_pivot(long_rows: DataFrame, *, keys=("region", "fcst_date", "fcst_time")) -> DataFrame:
    """One row per (region, date, time) with temperature, precipitation, pty code.

    TMP: last TMP value; precipitation: last PCP or RN1 value parsed as mm (0
    if none / unparsable); pty: last PTY code (0 if none).  Rows without a
    temperature are dropped.
    """
    g = long_rows.groupBy(*keys).agg(
        F.expr("max_by(try_cast(fcst_value AS double), seq) FILTER (WHERE category = 'TMP')").alias("temperature"),
        F.expr("max_by(fcst_value, seq) FILTER (WHERE category IN ('PCP', 'RN1'))").alias("_rain"),
        F.expr("max_by(fcst_value, seq) FILTER (WHERE category = 'PTY')").alias("_pty"),
    )
    out = g.where(F.col("temperature").isNotNull()).select(
        F.col(keys[0]).alias("region"), F.col(keys[1]).alias("base_date"), F.col(keys[2]).alias("base_time"),
        "temperature",
        F.when(F.col("_rain").isNull(), F.lit(0.0)).otherwise(rain_mm("_rain")).alias("precipitation"),
        F.when(F.col("_pty").isNull(), F.lit(0)).otherwise(pty_code("_pty")).alias("pty_code"))
    return out


def snapshot_at(long_rows: DataFrame, *, time: str = fixed.WEATHER_SNAPSHOT_TIME) -> DataFrame:
    """A10: per (region, date): last TMP and POP at one forecast time, default 0."""
    at = long_rows.where(F.col("fcst_time") == time)
    g = long_rows.select("region", "fcst_date").distinct().join(
        at.groupBy("region", "fcst_date").agg(
            F.expr("max_by(try_cast(fcst_value AS double), seq) FILTER (WHERE category = 'TMP')").alias("tmp"),
            F.expr("max_by(try_cast(fcst_value AS double), seq) FILTER (WHERE category = 'POP')").alias("pop")),
        ["region", "fcst_date"], "left")
    return g.select("region", F.col("fcst_date").alias("base_date"),
                    F.coalesce("tmp", F.lit(0.0)).alias("temperature"), F.coalesce("pop", F.lit(0.0)).alias("precipitation"))


def cache_completeness(pivot: DataFrame, as_of, *, need: int = fixed.WEATHER_FULL_DAY_ROWS) -> DataFrame:
    """Per region, rows dated on/after as_of; a region is usable only with >= 24 rows."""
    a = F.date_format(as_of_date(as_of), "yyyyMMdd")
    return (pivot.where(F.col("base_date") >= a).groupBy("region")
            .agg(F.count(F.lit(1)).alias("rows")).withColumn("complete", F.col("rows") >= need))


def drop_incomplete(pivot: DataFrame, as_of, *, need: int = fixed.WEATHER_FULL_DAY_ROWS) -> DataFrame:
    """Remove cached rows (on/after as_of) of regions whose cache is incomplete (left anti join)."""
    bad = cache_completeness(pivot, as_of, need=need).where(~F.col("complete")).select("region")
    a = F.date_format(as_of_date(as_of), "yyyyMMdd")
    future = pivot.where(F.col("base_date") >= a)
    return pivot.where(F.col("base_date") < a).unionByName(future.join(bad, "region", "left_anti"))


def first_of_day(pivot: DataFrame) -> DataFrame:
    """The earliest row per (region, date)."""
    st = F.struct("base_time", "temperature", "precipitation", "pty_code")
    return pivot.groupBy("region", "base_date").agg(F.min_by(st, F.col("base_time")).alias("w")) \
                .select("region", "base_date", "w.*")


def weather_change_alert(pivot: DataFrame, as_of) -> DataFrame:
    """Per region, compare tomorrow's first row with today's: rain / snow text first,
    else warmer / colder / steady by the temperature difference."""
    a = as_of_date(as_of)
    today_s = F.date_format(a, "yyyyMMdd")
    tomorrow_s = F.date_format(F.date_add(a, 1), "yyyyMMdd")
    f = first_of_day(pivot.where(F.col("base_date").isin(today_s, tomorrow_s)))
    t = f.where(F.col("base_date") == today_s).select("region", F.col("temperature").alias("today_temp"))
    m = f.where(F.col("base_date") == tomorrow_s).select("region", F.col("temperature").alias("tomorrow_temp"),
                                                            "precipitation", "pty_code")
    j = m.join(t, "region", "left")
    diff = F.when(F.col("today_temp").isNotNull(), F.col("tomorrow_temp") - F.col("today_temp")).otherwise(F.lit(0.0))
    wet = (F.col("pty_code") > 0) | (F.col("precipitation") > 0)
    kind = F.when(F.col("pty_code") > 0, pty_text("pty_code")).otherwise(F.lit(fixed.RAIN_TEXT))
    alert = (F.when(wet, F.lit("precipitation"))
             .when(F.col("today_temp").isNotNull() & (diff > 0), F.lit("warmer"))
             .when(F.col("today_temp").isNotNull() & (diff < 0), F.lit("colder"))
             .otherwise(F.lit("steady")))
    return j.select("region", "tomorrow_temp", "today_temp", diff.alias("temp_diff"), "precipitation", "pty_code",
                    alert.alias("alert"), F.when(wet, kind).alias("precip_kind"))


def with_detected_tags(chosen: DataFrame, detected: DataFrame, keys=("region", "base_date")) -> DataFrame:
    """U4: the tags a request chose, then the detected ones that are not among them."""
    auto = detected.select(*keys, F.col("weather_tags").alias("_auto"))
    none = F.array().cast("array<string>")
    return chosen.join(auto, list(keys), "left").withColumn(
        "weather_tags", F.array_union(F.coalesce("weather_tags", none), F.coalesce("_auto", none))).drop("_auto")


def auto_weather_tags(pivot: DataFrame) -> DataFrame:
    """U4 detection: per (region, date): rain if any pty in (1,2,4); snow if any pty in (2,3)."""
    g = pivot.groupBy("region", "base_date").agg(
        F.bool_or(F.col("pty_code").isin(1, 2, 4)).alias("rain"),
        F.bool_or(F.col("pty_code").isin(2, 3)).alias("snow"))
    tags = F.array_compact(F.array(F.when(F.col("rain"), F.lit("비")), F.when(F.col("snow"), F.lit("눈"))))
    return g.select("region", "base_date", tags.alias("weather_tags"))
