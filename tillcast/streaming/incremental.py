"""Incremental daily demand, waste decrements and weather upserts.

Each stream reduces a micro-batch to per-key *deltas* and appends them to a
log table partitioned by ``batch_id``.  The write overwrites only that
batch's partition, so a replayed micro-batch (after a failure) rewrites the
same rows: exactly-once by idempotence.  Readers fold the log (sum, or
last-write-wins by (batch_id, seq)), which is exact because the operations
compose: daily sums add, FEFO deductions of w1 then w2 equal one of w1+w2,
and a later forecast row replaces an earlier one.

A log grows with its batches, so ``compact`` folds the batches up to one of them into
a base.  The base is named by that batch and complete once its files are committed;
readers take the newest base and only the log's batches after it, so a batch that is
replayed after its rows went into the base is not read twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators import fefo, weather


def _append_batch(df: DataFrame, batch_id: int, path: str) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("long"))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("batch_id").parquet(path))


def _base_path(path: str) -> str:
    return path.rstrip("/") + "_base"


def _table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing has been written there; other failures are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def live_log(spark: SparkSession, path: str) -> DataFrame:
    """The newest base and the batches after it."""
    log, base = spark.read.parquet(path), _table_or_none(spark, _base_path(path))
    if base is None:
        return log.drop("batch_id")
    upto = base.agg(F.max("upto")).first()[0]          # one number
    kept = base.where(F.col("upto") == upto).drop("upto")
    return log.where(F.col("batch_id") > upto).drop("batch_id").unionByName(kept)


def _sums(*keys: str):
    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(c).cast(t).alias(c) for c, t in rows.dtypes if c not in keys])
    return fold


def _last_values(rows: DataFrame) -> DataFrame:
    return rows.groupBy("region", "fcst_date", "fcst_time", "category").agg(
        F.max_by("fcst_value", "seq").alias("fcst_value"), F.max("seq").alias("seq"))


# how the rows of each log fold into fewer of the same kind
FOLD_DEMAND, FOLD_WASTE, FOLD_WEATHER = _sums("date", "item_id"), _sums("product_id"), _last_values


def compact(spark: SparkSession, path: str, fold, upto: int) -> None:
    """Fold the last base and the batches up to ``upto`` into a new base.

    The log's own partitions stay; those up to the base may be removed once no reader
    is on an older base.  Doing it again for the same batch writes the same base.
    """
    log, base = spark.read.parquet(path), _table_or_none(spark, _base_path(path))
    rows = log.where(F.col("batch_id") <= upto)
    if base is not None:
        past = base.where(F.col("upto") < upto).agg(F.max("upto")).first()[0]
        if past is not None:
            rows = rows.where(F.col("batch_id") > past).drop("batch_id").unionByName(base.where(F.col("upto") == past).drop("upto"))
    rows = fold(rows.drop("batch_id") if "batch_id" in rows.columns else rows)
    (rows.withColumn("upto", F.lit(upto).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("upto").parquet(_base_path(path)))


def _run(stream_df: DataFrame, fn, checkpoint: str, *, available_now: bool = True):
    w = stream_df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def _parse_delay(delay: str) -> int:
    n, unit = delay.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def _watermark_before(spark: SparkSession, wm_path: str, batch_id: int, delay_s: int):
    """max event time of all earlier micro-batches minus the delay (None before any data)."""
    seen = _table_or_none(spark, wm_path)
    if seen is None:           # no batch written yet
        return None
    return (seen.where(F.col("batch_id") < batch_id)
                .agg((F.max("max_ts").cast("long") - delay_s).cast("timestamp").alias("wm")).first()["wm"])


def daily_demand_stream(lines: DataFrame, products: DataFrame, out_path: str, checkpoint: str, *,
                        late_after: str | None = None, available_now: bool = True):
    """POS lines (ts, product_id, qty, amount, is_return) -> daily demand deltas per item.

    Every row counts, however the input is cut into files or batches.  With
    ``late_after`` a late-data rule holds (deterministic): a row whose event time is older than
    (max event time of all earlier micro-batches - ``late_after``) is dropped.
    Spark's built-in watermark only promises that such rows *may* be
    dropped, and an update-mode aggregation that re-creates an evicted
    window would overwrite its total; here each batch writes sums (deltas)
    and the reader adds them, so any accepted row counts exactly once.
    The batch's max event time goes to a one-row-per-batch table.
    """
    delay_s = _parse_delay(late_after) if late_after else None
    wm_path = out_path.rstrip("/") + "_watermarks"
    ev = lines.withColumn("ts", F.col("ts").cast("timestamp")).where(~F.col("is_return"))
    j = ev.join(products.select("product_id", "item_id"), "product_id")

    def per_batch(df: DataFrame, batch_id: int):
        spark = df.sparkSession
        wm = _watermark_before(spark, wm_path, batch_id, delay_s) if late_after else None
        kept = df if wm is None else df.where(F.col("ts") >= F.lit(wm))
        delta = (kept.groupBy(F.to_date("ts").alias("date"), "item_id")
                     .agg(F.sum("qty").alias("demand_qty"), F.sum("amount").alias("sales_amount")))
        _append_batch(delta, batch_id, out_path)
        if late_after:
            _append_batch(df.agg(F.max("ts").alias("max_ts")), batch_id, wm_path)

    return _run(j, per_batch, checkpoint, available_now=available_now)


def read_daily_demand(spark: SparkSession, path: str) -> DataFrame:
    log = live_log(spark, path)
    return log.groupBy("date", "item_id").agg(F.sum("demand_qty").alias("demand_qty"),
                                              F.sum("sales_amount").alias("sales_amount"))


def waste_stream(wastes: DataFrame, out_path: str, checkpoint: str, *, available_now: bool = True):
    """Waste events -> per-product waste deltas per micro-batch (summed before the deduction)."""
    def per_batch(df: DataFrame, batch_id: int):
        _append_batch(df.groupBy("product_id").agg(F.sum("quantity").cast("long").alias("quantity")), batch_id, out_path)

    return _run(wastes, per_batch, checkpoint, available_now=available_now)


def read_batches_after_waste(spark: SparkSession, batches: DataFrame, path: str, *,
                             tiebreak: list | None = None) -> DataFrame:
    """Batch quantities after every logged waste, FEFO (W13 on the summed deltas)."""
    w = live_log(spark, path).groupBy("product_id").agg(F.sum("quantity").alias("quantity"))
    return fefo.fefo_deduction(batches, w, tiebreak=tiebreak)


def weather_stream(long_rows: DataFrame, out_path: str, checkpoint: str, *, available_now: bool = True):
    """Forecast rows -> each batch's last value per key and category; pivoted (A9) at read time."""
    def per_batch(df: DataFrame, batch_id: int):
        _append_batch(_last_values(df), batch_id, out_path)

    return _run(long_rows, per_batch, checkpoint, available_now=available_now)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return weather.weather_pivot(live_log(spark, path))
