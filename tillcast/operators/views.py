"""List views, validation and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast import fixed
from tillcast.operators.reports import pad_id


def order_view(orders: DataFrame) -> DataFrame:
    """Id 'ORD-nnn', date, '<name> <qty>개', amount.  Input: order_id, created, product, qty, cost."""
    return orders.select(pad_id("ORD-", "order_id").alias("id"), F.col("created").alias("date"),
                         F.concat(F.coalesce("product", F.lit("상품")), F.lit(" "),
                                  F.coalesce(F.col("qty"), F.lit(0)).cast("string"), F.lit(fixed.UNIT_SUFFIX)).alias("items"),
                         F.coalesce("cost", F.lit(0.0)).alias("total_amount"))


def run_log_view(runs: DataFrame, *, group: str = "region", order: str = "run_ts", value: str = "weight_pct",
                 first: str | None = None) -> DataFrame:
    """P15 + W15: runs newest first; blank factors read 'not selected'; previous run's value and the change.

    The first run of a group is compared with the column ``first`` (the dashboard's value), if given.
    The previous run is looked up within ``group`` (one history per shop/region),
    so the window never holds more than one group's runs.
    """
    w = Window.partitionBy(group).orderBy(order)
    blank = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(fixed.NOT_SELECTED))
    prev = F.lag(value).over(w) if first is None else F.coalesce(F.lag(value).over(w), F.col(first))
    return runs.select(
        group, order, blank("weather_factors").alias("weather"), blank("event_factors").alias("events"),
        "impact_summary", F.col(value).alias("value"),
        prev.alias("prev_value"), (F.col(value) - prev).alias("change")).orderBy(F.col(order).desc(), group)


def search_names(df: DataFrame, name_col: str, q: str, *, k: int = 50) -> DataFrame:
    """P20: whitespace-insensitive substring match, first k by name."""
    needle = "".join(q.split())
    hay = F.regexp_replace(F.col(name_col), r"\s+", "")
    return df.where(hay.contains(needle)).orderBy(name_col).limit(k)


def admin_filter(df: DataFrame, **equals) -> DataFrame:
    """Equality filters on any listed columns (None = no filter); date bounds via *_from / *_to."""
    cond = F.lit(True)
    for k, v in equals.items():
        if v is None:
            continue
        if k.endswith("_from"):
            cond = cond & (F.col(k[:-5]) >= F.lit(v))
        elif k.endswith("_to"):
            cond = cond & (F.col(k[:-3]) <= F.lit(v))
        else:
            cond = cond & (F.col(k) == F.lit(v))
    return df.where(cond)


def validate_waste(rows: DataFrame) -> DataFrame:
    """P25: a waste row needs a product, a non-zero quantity and a reason (truthy fields)."""
    reason = (F.when(F.col("product_id").isNull(), F.lit("missing product"))
              .when(F.col("quantity").isNull() | (F.col("quantity") == 0), F.lit("missing quantity"))
              .when(F.col("reason").isNull() | (F.trim(F.col("reason")) == ""), F.lit("missing reason")))
    return rows.withColumn("reject_reason", reason).withColumn("accepted", reason.isNull())


def validate_inventory(rows: DataFrame, required: list[str]) -> DataFrame:
    """P25: every required field present and not blank; the first missing one is reported."""
    reason = None
    for c in required:
        bad = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
        reason = F.when(bad, F.lit(f"missing {c}")) if reason is None else reason.when(bad, F.lit(f"missing {c}"))
    return rows.withColumn("reject_reason", reason).withColumn("accepted", reason.isNull())


def sort_page(df: DataFrame, keys: list, *, k: int | None = None, collation: str | None = None, text_cols=()) -> DataFrame:
    """T5: a sorted list, whole or its first ``k`` rows; text keys can sort under a collation (e.g. 'UNICODE')."""
    ks = [F.collate(F.col(c), collation) if (collation and c in text_cols) else F.col(c) for c in keys]
    out = df.orderBy(*ks)
    return out if k is None else out.limit(k)
