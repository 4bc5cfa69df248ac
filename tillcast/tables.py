"""Logical retail tables derived from the provided parquet tables.

Mapping (one place, used by every query):

* sales lines   = lineitem ⨝ part: date = ship date, item = ``p_type``,
  menu = ``p_brand``, category = ``p_type``, qty = ``l_quantity``,
  amount = ``l_extendedprice * (1 - l_discount)``, return = flag 'R'.
* product       = part.
* inventory batch = non-returned lineitem rows: id = ``l_orderkey*8+l_linenumber``,
  received = ship date, expiration = received + ``p_size`` days, qty = ``l_quantity``.
* waste history = returned lineitem rows, reason = ``l_linestatus``.
* weather rows  = events (date/hour of ``ts``; category from ``event_type``).

All readers select only the columns they need so the parquet scan prunes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.session import scratch_path

# Fixed "today" for the lineitem calendar and for the events calendar, so every
# report is reproducible (the wall clock is never read).
AS_OF_SALES = "2001-06-30"
AS_OF_EVENTS = "2024-01-20"

# events.event_type -> weather forecast category (our adapter's choice)
WEATHER_CATEGORY_OF_EVENT = (
    ("view", "TMP"), ("click", "PCP"), ("purchase", "RN1"), ("error", "PTY"), ("signup", "POP"),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def product(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").alias("shelf_days"),
        F.col("p_retailprice").alias("selling_price"),
    )


def _lines(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")


def sales_lines(spark, sf_dir) -> DataFrame:
    """Row-level POS lines (one per lineitem) with the product attributes."""
    li = _lines(spark, sf_dir)
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return li.join(part, li.l_partkey == part.p_partkey, "inner").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("p_type").alias("item_id"),
        F.col("p_brand").alias("menu"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("product_name"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
        F.col("l_discount").alias("discount"),
        (F.col("l_returnflag") == "R").alias("is_return"),
        F.col("l_linestatus").alias("line_status"),
    )


def day_product_grid(spark, sf_dir) -> DataFrame:
    """``product_day_sales`` written once: what a report with several inputs reads in place of the lines."""
    path = scratch_path(spark, "day-product")
    grid = product_day_sales(spark, sf_dir)
    grid.write.parquet(path)
    return spark.read.schema(grid.schema).parquet(path)


def product_day_sales(spark, sf_dir) -> DataFrame:
    """Sales pre-aggregated to (date, product) *before* the product join.

    The partial aggregate runs map-side, so a product holding a third of all
    lines reaches the join as at most one row per day: the join cannot skew.
    """
    li = _lines(spark, sf_dir).where(F.col("l_returnflag") != "R")
    agg = li.groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_partkey")).agg(
        F.sum("l_quantity").alias("qty"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
        F.count(F.lit(1)).alias("n_lines"),
        F.max("l_discount").alias("max_discount"),
    )
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return agg.join(part, agg.l_partkey == part.p_partkey, "inner").select(
        "date",
        F.col("l_partkey").alias("product_id"),
        F.col("p_type").alias("item_id"),
        F.col("p_brand").alias("menu"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("product_name"),
        "qty", "amount", "n_lines", "max_discount",
    )


def average_quantity(spark, sf_dir) -> DataFrame:
    """(name, avg_qty) over sale lines: sums and counts by product key meet the product names, not the lines."""
    li = _lines(spark, sf_dir).where(F.col("l_returnflag") != "R")
    agg = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("s"), F.count("l_quantity").alias("n"))
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    return (agg.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("name")
            .agg((F.sum("s") / F.sum("n")).alias("avg_qty")))


def pos_rows(spark, sf_dir, *, text_order_cn: bool = True) -> DataFrame:
    """Raw POS-export shaped rows (all strings, upper-case headers).

    Two "exports" (SOURCE_TAG = line status): with ``text_order_cn`` the
    closed-line export carries text in ORDER_CN and the quantity in SLE_CO.
    """
    s = sales_lines(spark, sf_dir)
    text_cn = F.lit(bool(text_order_cn)) & (F.col("line_status") != "O")
    return s.select(
        F.date_format("date", "yyyyMMdd").alias("SALES_DE"),
        F.col("line_id").cast("string").alias("RCIPT_NO"),
        F.when(F.col("is_return"), F.lit("반품")).otherwise(F.lit("매출")).alias("SALES_CD"),
        F.initcap(F.col("category")).alias("LCLAS_CD"),
        F.col("item_id").alias("MLSFC_CD"),
        F.col("menu").alias("SCLAS_CD"),
        # quantity sits in ORDER_CN for open lines; closed lines carry text there
        # and the quantity in SLE_CO, as some POS exports do
        F.when(text_cn, F.lit("일반")).otherwise(F.col("qty").cast("string")).alias("ORDER_CN"),
        F.col("qty").cast("string").alias("SLE_CO"),
        F.col("amount").cast("string").alias("PAYMENT_PRICE"),
        F.col("line_status").alias("SOURCE_TAG"),
    )


def inventory_batches(spark, sf_dir) -> DataFrame:
    li = _lines(spark, sf_dir).where(F.col("l_returnflag") != "R")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    received = F.col("l_shipdate").cast("date")
    return j.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("batch_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        received.alias("received_date"),
        F.date_add(received, F.col("p_size")).alias("expiration_date"),
        F.col("l_quantity").cast("long").alias("received_qty"),
        F.col("l_extendedprice").alias("line_price"),
        F.col("l_quantity").cast("long").alias("current_qty"),
    )


# (order, line) repeats in the provided lineitem; these columns together are unique
BATCH_KEY = ["batch_id", "product_id", "supplier_id", "received_qty", "line_price", "received_date"]
BATCH_TIEBREAK = ["supplier_id", "received_qty", "line_price", "received_date"]


def waste_history(spark, sf_dir) -> DataFrame:
    li = _lines(spark, sf_dir).where(F.col("l_returnflag") == "R")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("waste_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_shipdate").cast("date").alias("waste_date"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.col("l_linestatus").alias("reason"),
    )


def weather_long(spark, sf_dir) -> DataFrame:
    """Long forecast rows (region, date, time, category, value text) from events."""
    return weather_long_from(read(spark, sf_dir, "events"))


def weather_long_from(events: DataFrame) -> DataFrame:
    """Same mapping for any events frame (batch or streaming)."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "value")
    cat = None
    for et, c in WEATHER_CATEGORY_OF_EVENT:
        cat = F.when(F.col("event_type") == et, F.lit(c)) if cat is None else cat.when(F.col("event_type") == et, F.lit(c))
    ts = F.col("ts").cast("timestamp")
    # value text as a forecast feed spells it: 'no rain' words, 'x.ymm', codes
    value_text = (F.when((F.col("event_type") == "click") & (F.col("value") < 5), F.lit("강수없음"))
                  .when(F.col("event_type").isin("click", "purchase"),
                        F.concat((F.col("value") / 10).cast("string"), F.lit("mm")))
                  .when(F.col("event_type") == "error", (F.floor(F.col("value")) % 5).cast("string"))
                  .otherwise((F.col("value") / 10).cast("string")))
    return ev.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("R"), (F.col("user_id") % 17).cast("string")).alias("region"),
        F.date_format(ts, "yyyyMMdd").alias("fcst_date"),
        F.date_format(ts, "HH00").alias("fcst_time"),
        cat.alias("category"),
        value_text.alias("fcst_value"),
    )


def forecast_results(spark, sf_dir, sales: DataFrame | None = None) -> DataFrame:
    """Stored forecasts (target_date, product, predicted_qty, created_at, forecast_period).

    Two runs per (target date, item), both seasonal-naive over the daily
    demand grid: a 7-day-ahead run (lag 7, created 7 days before) and a
    1-day-ahead run (lag 1, created the day before).  So every key has two
    forecasts and "latest wins" matters.
    """
    from pyspark.sql import Window
    if sales is None:
        li = _lines(spark, sf_dir).where(F.col("l_returnflag") != "R")
        part = read(spark, sf_dir, "part").select("p_partkey", "p_type")
        daily = (li.groupBy(F.col("l_shipdate").cast("date").alias("date"), "l_partkey").agg(F.sum("l_quantity").alias("q"))
                   .join(part, F.col("l_partkey") == F.col("p_partkey"))
                   .groupBy("date", F.col("p_type").alias("product")).agg(F.sum("q").alias("q")))
    else:  # the same sums from the day and product rows
        daily = sales.groupBy("date", F.col("item_id").alias("product")).agg(F.sum("qty").alias("q"))
    o = Window.partitionBy("product").orderBy("date")
    runs = []
    for k in (7, 1):
        runs.append(daily.select(
            F.col("date").alias("target_date"), "product",
            F.lag("q", k).over(o).alias("predicted_qty"),
            F.date_sub("date", k).alias("created_at"),
            F.lit(k).alias("forecast_period")))
    out = runs[0].unionByName(runs[1]).where(F.col("predicted_qty").isNotNull())
    return out.withColumn("forecast_id", F.xxhash64("target_date", "product", "forecast_period"))


def event_attributes(spark, sf_dir) -> DataFrame:
    """Event rows with the inputs of the impact score (derived from events columns)."""
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return ev.select(
        "event_id", F.col("ts").cast("date").alias("date"),
        (F.col("user_id") % 17).alias("region_no"),
        (k * 50).alias("expected_visitors"),
        (F.col("value") * 10).alias("distance_m"),
        (F.col("user_id") % 2 == 0).alias("on_main_flow"),
        ((k % 10) / 10.0).alias("overlap_ratio"),
        (F.col("value") / 400.0).alias("customer_fit"),
        (k / 20.0).alias("dwell_hours"),
        (F.col("event_type") != "error").alias("public_event"))


def customer_locations(spark, sf_dir) -> DataFrame:
    """Customer coordinates spread over the peninsula, derived from the customer key."""
    c = read(spark, sf_dir, "customer").select("c_custkey")
    return c.select(F.col("c_custkey").alias("id"),
                    (33.0 + (F.col("c_custkey") % 1000) * 0.0055).alias("lat"),
                    (125.0 + ((F.col("c_custkey") * 7919) % 1000) * 0.0045).alias("lon"))
