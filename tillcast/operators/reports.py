"""Sales, stock, waste and forecast reports (A3, A7, A8, A11-A18, A21, A22, J4-J7, J10,
P9-P15, P17-P19, P21, P24, R1-R3, R5, R6, R12, T2-T7, W11, W12).

All reports take an explicit ``as_of`` ("today") and filter on date ranges
first, so parquet row-group statistics and partition pruning apply.  Date
spines are generated (``sequence`` + ``explode``) and left-joined, never
built by looping over days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast import fixed
from tillcast.functions.dates import as_of_date, month_day_label
from tillcast.functions.numeric import pct_change, round_half_up
from tillcast.operators.inventory import stock_status


def pad_id(prefix: str, col, width: int = 3):
    """'<prefix><id>' with the id zero-padded to ``width`` (never truncated)."""
    s = F.col(col).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s))


def date_spine(spark, as_of, start_offset: int, end_offset: int) -> DataFrame:
    """One row per day from as_of+start_offset to as_of+end_offset (inclusive)."""
    a = as_of_date(as_of)
    return spark.range(1).select(F.explode(F.sequence(F.date_add(a, start_offset), F.date_add(a, end_offset))).alias("date"))


def sales_view(sales: DataFrame) -> DataFrame:
    """Id, date, menu, category, quantity, unit price (half-up of amount/qty or 1), amount."""
    qty = F.coalesce(F.col("qty"), F.lit(0.0))
    unit = F.when(F.coalesce(F.col("amount"), F.lit(0.0)) != 0,
                  round_half_up(F.col("amount") / F.coalesce(F.nullif(qty, F.lit(0.0)), F.lit(1.0)))).otherwise(F.lit(0.0))
    return sales.select(F.concat(F.lit("TX-"), F.col("line_id").cast("string")).alias("id"), "date",
                        F.coalesce("menu", F.lit("알 수 없는 메뉴")).alias("menu"),
                        F.coalesce("category", F.lit(fixed.DEFAULT_CATEGORY)).alias("category"),
                        qty.alias("quantity"), unit.alias("unit_price"),
                        F.coalesce(F.col("amount"), F.lit(0.0)).alias("amount"))


def month_category_summary(sales: DataFrame, month: str | None = None) -> DataFrame:
    """A3/R12 (P9): quantity and revenue per (month, category).

    With ``month`` ('yyyyMM') the filter is a date *range* so it prunes.
    """
    df = sales
    if month:
        start = F.to_date(F.lit(month + "01"), "yyyyMMdd")
        df = df.where((F.col("date") >= start) & (F.col("date") < F.add_months(start, 1)))
    return (df.groupBy(F.date_format("date", "yyyyMM").alias("month"), "category")
              .agg(F.sum("qty").alias("total_qty"), F.sum("amount").alias("total_sales")))


def month_over_month(sales: DataFrame, as_of) -> DataFrame:
    """Revenue this month (1st .. as_of) vs the whole previous month, and % change."""
    a = as_of_date(as_of)
    this_start = F.trunc(a, "month")
    last_start = F.add_months(this_start, -1)
    d = F.col("date")
    pre = sales.where((d >= last_start) & (d <= a))
    # totals are rounded to the amounts' 4 decimals so the % does not depend on summation order
    agg = pre.agg(
        F.round(F.coalesce(F.sum(F.when(d >= this_start, F.col("amount"))), F.lit(0.0)), 4).alias("this_month"),
        F.round(F.coalesce(F.sum(F.when(d < this_start, F.col("amount"))), F.lit(0.0)), 4).alias("last_month"))
    return agg.withColumn("change_pct", pct_change("this_month", "last_month"))


def daily_series(sales: DataFrame, as_of, days: int) -> DataFrame:
    """Quantity per day for the last ``days`` days, zero-filled, with 'M/d' label."""
    a = as_of_date(as_of)
    spine = date_spine(sales.sparkSession, as_of, -(days - 1), 0)
    per_day = (sales.where((F.col("date") >= F.date_sub(a, days - 1)) & (F.col("date") <= a))
               .groupBy("date").agg(F.sum("qty").alias("sales")))
    # the spine has `days` rows: a proven size bound
    return (F.broadcast(spine).join(per_day, "date", "left")
            .select("date", month_day_label("date").alias("label"),
                    F.coalesce("sales", F.lit(0.0)).alias("sales"), (F.col("date") == a).alias("is_today")))


def top_products(sales: DataFrame, as_of, *, k: int = 5, days: int = 30) -> DataFrame:
    """Top-k menus by quantity of the last 30 days, with the previous 30 days and trend.

    One conditional aggregate over 60 days, then a top-k (Spark keeps k rows
    per partition and merges: no global sort of the aggregate).
    """
    a = as_of_date(as_of)
    d = F.col("date")
    cur = (d > F.date_sub(a, days)) & (d <= a)
    prev = (d > F.date_sub(a, 2 * days)) & (d <= F.date_sub(a, days))
    agg = (sales.where((d > F.date_sub(a, 2 * days)) & (d <= a))
           .groupBy("menu").agg(F.sum(F.when(cur, F.col("qty"))).alias("sales"),
                                F.sum(F.when(cur, F.col("amount"))).alias("revenue"),
                                F.coalesce(F.sum(F.when(prev, F.col("qty"))), F.lit(0.0)).alias("prev_sales"))
           .where(F.col("sales").isNotNull()))
    top = agg.orderBy(F.col("sales").desc(), F.col("menu")).limit(k)
    trend = (F.when(F.col("sales") > F.col("prev_sales") * 1.05, F.lit("up"))
             .when(F.col("sales") < F.col("prev_sales") * 0.95, F.lit("down")).otherwise(F.lit("stable")))
    rank = F.row_number().over(Window.orderBy(F.col("sales").desc(), F.col("menu")))
    return top.select(rank.alias("rank"), F.col("menu").alias("name"), "sales", "revenue", "prev_sales",
                      trend.alias("trend"))


def category_share(sales: DataFrame, as_of) -> DataFrame:
    """This month's revenue per category and its share in % (1 decimal, half up)."""
    a = as_of_date(as_of)
    d = F.col("date")
    per = (sales.where((d >= F.trunc(a, "month")) & (d <= a))
           .groupBy(F.col("category").alias("name")).agg(F.round(F.sum("amount"), 4).alias("amount")))
    total = F.sum("amount").over(Window.partitionBy())          # over the categories only
    return per.withColumn("value", F.when(total > 0, F.floor(F.col("amount") / total * 1000 + 0.5) / 10)
                          .otherwise(F.lit(0.0)))


def latest_forecasts(forecasts: DataFrame) -> DataFrame:
    """One forecast per (target_date, product): latest created_at, then highest id."""
    o = Window.partitionBy("target_date", "product").orderBy(F.col("created_at").desc(), F.col("forecast_id").desc())
    return forecasts.withColumn("_rn", F.row_number().over(o)).where("_rn = 1").drop("_rn")


def forecast_day_totals(forecasts: DataFrame) -> DataFrame:
    """Latest forecasts summed per target date."""
    return latest_forecasts(forecasts).groupBy(F.col("target_date").alias("date")).agg(
        F.sum(F.coalesce("predicted_qty", F.lit(0.0))).alias("predicted"))


def stock_view(batches: DataFrame, product: DataFrame, *, min_stock=fixed.DEFAULT_MIN_STOCK,
               max_stock=fixed.DEFAULT_MAX_STOCK, daily_usage=fixed.DEFAULT_DAILY_USAGE, extra: tuple = ()) -> DataFrame:
    """P10 + P17: inventory rows with thresholds, stock % and status, and the batch columns ``extra``."""
    p = product.select("product_id", "name", "category", "selling_price")
    j = batches.join(p, "product_id", "left")
    out = j.select(
        pad_id(fixed.INVENTORY_ID_PREFIX, "batch_id").alias("id"),
        "batch_id", "product_id",
        F.coalesce("category", F.lit(fixed.DEFAULT_CATEGORY)).alias("category"),
        F.coalesce("name", F.concat(F.lit("알 수 없는 상품("), F.col("product_id").cast("string"), F.lit(")"))).alias("product"),
        F.coalesce(F.col("current_qty"), F.lit(0)).cast("double").alias("current_stock"),
        F.lit(fixed.UNIT_SUFFIX).alias("unit"),
        F.lit(min_stock).cast("double").alias("min_stock"), F.lit(max_stock).cast("double").alias("max_stock"),
        F.coalesce("selling_price", F.lit(0.0)).alias("unit_price"),
        F.lit(daily_usage).cast("double").alias("daily_usage"),
        F.col("received_date").alias("last_updated"), *extra)
    pct, status = stock_status("current_stock", "min_stock", "max_stock")
    return out.withColumn("stock_pct", pct.cast("long")).withColumn("status", status)


def inventory_counts(stock: DataFrame) -> DataFrame:
    """Total, low and high counts."""
    return stock.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "low").alias("low"),
                     F.count_if(F.col("status") == "high").alias("high"))


def low_stock_alerts(stock: DataFrame) -> DataFrame:
    """One alert line per low-stock row (never one giant concatenated string)."""
    return stock.where(F.col("current_stock") < F.col("min_stock")).select(
        "id", "batch_id", "product", "current_stock",
        F.concat(F.lit("- "), F.col("product"), F.lit(" (현재: "),
                 F.regexp_replace(F.col("current_stock").cast("string"), r"\.0$", ""),
                 F.col("unit"), F.lit(")")).alias("line"))


def inventory_search(stock: DataFrame, q: str = "", category: str = fixed.ALL_CATEGORIES) -> DataFrame:
    """Case-insensitive substring on product or category, AND category equality ('all' = any)."""
    ql = q.lower()
    hit = F.lower("product").contains(ql) | F.lower("category").contains(ql)
    if category != fixed.ALL_CATEGORIES:
        hit = hit & (F.col("category") == category)
    return stock.where(hit)


def waste_view(waste: DataFrame, product: DataFrame) -> DataFrame:
    """Waste rows with product name/category and loss = price x qty."""
    p = product.select("product_id", "name", "category", "selling_price")
    j = waste.join(p, "product_id", "left")
    return j.select(pad_id("WST-", "waste_id").alias("id"),
                    F.col("waste_date").alias("date"), F.coalesce("name", F.lit("상품")).alias("product"),
                    F.coalesce("category", F.lit(fixed.DEFAULT_CATEGORY)).alias("category"),
                    F.coalesce("quantity", F.lit(0)).alias("quantity"),
                    F.coalesce("reason", F.lit(fixed.DEFAULT_CATEGORY)).alias("reason"),
                    (F.coalesce("selling_price", F.lit(0.0)) * F.coalesce("quantity", F.lit(0))).alias("loss"))


def waste_weekly(waste_rows: DataFrame, as_of) -> DataFrame:
    """Loss of the last 7 days (as_of-7 .. as_of) vs the 7 days before, % change."""
    a = as_of_date(as_of)
    d = F.col("date")
    week_ago = F.date_sub(a, 7)
    prev_start = F.date_sub(a, 14)
    agg = (waste_rows.where((d >= prev_start) & (d <= a))
           .agg(F.round(F.coalesce(F.sum(F.when(d >= week_ago, F.col("loss"))), F.lit(0.0)), 2).alias("weekly_cost"),
                F.round(F.coalesce(F.sum(F.when(d < week_ago, F.col("loss"))), F.lit(0.0)), 2).alias("prev_weekly_cost")))
    return agg.withColumn("change_pct", pct_change("weekly_cost", "prev_weekly_cost"))


def forecast_view(forecasts: DataFrame, product_names: DataFrame | None = None) -> DataFrame:
    """Forecast rows with a display label '<name> <qty>개'."""
    df = forecasts
    name = F.col("product")
    if product_names is not None:
        df = df.join(product_names, "product", "left")
        name = F.coalesce(F.col("product_name"), F.lit("상품"))
    qty_txt = F.regexp_replace(F.col("predicted_qty").cast("string"), r"\.0$", "")
    return df.select("forecast_id", F.col("target_date").alias("date"), name.alias("product"), "predicted_qty",
                     F.concat(name, F.lit(" "), qty_txt, F.lit(fixed.UNIT_SUFFIX)).alias("predicted"))


def upcoming_forecast_total(forecasts: DataFrame, as_of) -> DataFrame:
    """Latest forecasts on/after as_of, total per day and overall."""
    lf = latest_forecasts(forecasts).where(F.col("target_date") >= as_of_date(as_of))
    return lf.groupBy(F.col("target_date").alias("date")).agg(F.sum("predicted_qty").alias("predicted_total"))
