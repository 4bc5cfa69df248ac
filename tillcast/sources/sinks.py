"""Result sinks.

CSV cannot hold arrays, so array columns are written as JSON text; the
same frames can go to parquet unchanged.  Every write is a Spark job
writing part files in parallel: nothing is gathered on the driver.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns -> JSON strings."""
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name)
                       for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    csv_ready(df).write.mode(mode).option("header", True).csv(path)


def write_results(out_dir: str, *, metrics: DataFrame, plan: DataFrame, importance: DataFrame,
                  fmt: str = "csv") -> dict:
    """Metrics, recommendations and feature importance under one folder."""
    paths = {"metrics": f"{out_dir}/metrics", "recommendations": f"{out_dir}/recommendations",
             "feature_importance": f"{out_dir}/feature_importance"}
    for name, df in (("metrics", metrics), ("recommendations", plan), ("feature_importance", importance)):
        if fmt == "csv":
            write_csv(df, paths[name])
        else:
            df.write.mode("overwrite").parquet(paths[name])
    return paths


def report_range(date_from: str, date_to: str | None = None) -> tuple[str, str]:
    """S13 range rule: default end = start + 7 days; the range is at least one day."""
    start = _dt.date.fromisoformat(date_from)
    end = _dt.date.fromisoformat(date_to) if date_to else start + _dt.timedelta(days=7)
    if end < start:
        end = start
    return start.isoformat(), end.isoformat()


def export_report(out_dir: str, *, sales: DataFrame, stock: DataFrame, waste: DataFrame, accuracy: DataFrame,
                  date_from: str, date_to: str | None = None) -> dict:
    """Four sections for a date range, one CSV folder each (real tables, no invented rows).

    sales: quantity and revenue per day; stock: rows with stock % (ratio);
    waste: rows with loss; accuracy: forecast vs actual per (date, product).
    """
    a, b = report_range(date_from, date_to)
    rng = lambda c: F.col(c).between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    sections = {
        "daily_sales": sales.where(rng("date")).groupBy("date").agg(F.sum("qty").alias("quantity"),
                                                                     F.sum("amount").alias("revenue")),
        "stock": stock.select("id", "product", "category", "current_stock", "max_stock",
                              F.col("stock_pct").alias("ratio_pct"), "status"),
        "waste": waste.where(rng("date")),
        "forecast_accuracy": accuracy.where(rng("date")),
    }
    paths = {}
    for name, df in sections.items():
        paths[name] = f"{out_dir}/{name}"
        write_csv(df, paths[name])
    return paths


def write_by_month(df: DataFrame, path: str, *, date_col: str = "date", mode: str = "overwrite") -> None:
    """Parquet partitioned by month ('yyyy-MM') so date-range readers prune whole folders.

    Rows are range-partitioned by date before the write: each task writes few months, and a
    month of many rows is shared out by day among several tasks.
    """
    out = df.withColumn("month", F.date_format(F.col(date_col), "yyyy-MM"))
    (out.repartitionByRange("month", date_col).write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy("month").parquet(path))


def read_months(spark, path: str, date_from: str, date_to: str, *, date_col: str = "date") -> DataFrame:
    """Read a date range; the month predicate prunes partitions, the date predicate trims the edges."""
    df = spark.read.parquet(path)
    m_from, m_to = date_from[:7], date_to[:7]
    return (df.where((F.col("month") >= m_from) & (F.col("month") <= m_to))
              .where(F.col(date_col).between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date"))))
