"""Registered queries: quantile models, metrics, importances, recursive forecast, model plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast import tables
from tillcast.operators import features, forecast, recursive
from tillcast.plans import common, model_run
from tillcast.plans.common import SQL_DAILY, sql_roll
from tillcast.plans.registry import query
from tillcast.session import scratch_path


def _run(spark, d):
    """The stored run of these rows, or a fit of the whole search where there is none."""
    return model_run.fit_and_evaluate(common.raw_materialized(spark, d))


@query("forecast_metrics", f"""WITH {SQL_DAILY},
f AS (SELECT date, demand_qty, {sql_roll('demand_qty', 7, 1, 'avg', 7)} AS q50,
             {sql_roll('demand_qty', 7, 1, 'avg', 7)} + 1.645 * {sql_roll('demand_qty', 7, 1, 'stddev_samp', 7)} AS q95
      FROM daily),
t AS (SELECT * FROM f WHERE q50 IS NOT NULL AND date > (SELECT max(date) FROM daily) - INTERVAL 28 DAY),
m AS (SELECT avg(abs(demand_qty - q50)) AS mae, sqrt(avg(pow(demand_qty - q50, 2))) AS rmse,
             avg(greatest(0.95 * (demand_qty - q95), (0.95 - 1) * (demand_qty - q95))) AS pin FROM t)
SELECT 'MAE (q50)' AS metric, round(mae, 6) AS value FROM m UNION ALL
SELECT 'RMSE (q50)', round(rmse, 6) FROM m UNION ALL SELECT 'Pinball Loss (q95)', round(pin, 6) FROM m""",
       ops="A20 P8")
def q_forecast_metrics(spark, d):
    """A20 on the rolling-mean baseline over the last 28 days (holdout)."""
    dd = features.rolling_features(common.daily(spark, d), windows=(7,), trend=28)
    dd = dd.withColumns({"q50": F.col("roll_mean_7"), "q95": F.col("roll_mean_7") + 1.645 * F.col("roll_std_7")})
    mx = dd.agg(F.max("date")).scalar()
    t = dd.where(F.col("q50").isNotNull() & (F.col("date") > F.date_sub(mx, 28)))
    return forecast.forecast_metrics(t).withColumn("value", F.round("value", 6))


@query("quantile_model_predict", ops="M1 M2 M3 M5")
def q_model_predict(spark, d):
    r = _run(spark, d)
    return r.predictions.select("date", "item_id", "demand_qty", F.round("q50", 4).alias("q50"),
                                F.round("q95", 4).alias("q95"))


@query("model_metrics", ops="A20 M5")
def q_model_metrics(spark, d):
    return _run(spark, d).metrics


@query("feature_importance", ops="M6 T8")
def q_feature_importance(spark, d):
    return _run(spark, d).importance.orderBy(F.col("importance").desc(), "feature")


@query("recursive_forecast", ops="M7 M8 J12 M10")
def q_recursive(spark, d):
    r = _run(spark, d)
    paths = recursive.recursive_forecast(r.models, r.raw, r.feature_df, horizon=30)
    return recursive.explode_paths(paths)


@query("model_order_plan", ops="M11 I8")
def q_model_plan(spark, d):
    r = _run(spark, d)
    plan = model_run.model_plan(r.raw, r, lots=common.lots_on_hand(spark, d, r.raw), unit_costs=common.unit_costs(spark, d))
    return plan


@query("recursive_forecast_overrides", ops="J12 M7 M8")
def q_recursive_overrides(spark, d):
    """The recursive forecast under future weather and events: what the feed said of a day of the month, promotions at weekends."""
    r = _run(spark, d)
    as_of = r.raw.agg(F.max("date")).first()[0]
    ahead = spark.range(1, 31).select(F.date_add(F.lit(as_of), F.col("id").cast("int")).alias("date"))
    days = tables.read(spark, d, "events").groupBy(F.dayofmonth("ts").alias("day")).agg(
        F.avg("value").alias("temp_c"), F.max("value").alias("rain_mm"), F.least(F.count(F.lit(1)) % 101, F.lit(100)).cast("double").alias("event_score_100"))
    future = ahead.join(days, F.dayofmonth("date") == F.col("day")).select("date", "temp_c", "rain_mm", "event_score_100",
                                                                           (F.weekday("date") >= 5).cast("int").alias("promo"))
    return recursive.explode_paths(recursive.recursive_forecast(r.models, r.raw, r.feature_df, horizon=30, future_exogenous=future))


@query("model_result_files", ops="S12 M11")
def q_model_files(spark, d):
    """The three result files of a job with models, written and read back."""
    r = _run(spark, d)
    plan = model_run.model_plan(r.raw, r, lots=common.lots_on_hand(spark, d, r.raw), unit_costs=common.unit_costs(spark, d))
    paths = model_run.write_run(scratch_path(spark, "model-results"), model_run.JobResult(plan, r))
    back = {k: spark.read.option("header", True).csv(p) for k, p in paths.items()}
    one = lambda k, name, value: back[k].select(F.lit(k).alias("file"), F.col(name).alias("name"), F.col(value).cast("double").alias("value"))
    return (one("metrics", "metric", "value").unionByName(one("recommendations", "item_id", "recommended_order_qty"))
            .unionByName(one("feature_importance", "feature", "importance_percentage")))


@query("model_search_losses", ops="M2 M3 M4")
def q_search(spark, d):
    """Mean pinball loss of every setting of the search over the date folds."""
    return _run(spark, d).search
