"""The end-to-end forecast-and-plan job.

raw daily demand -> features (W1) -> run-level split (P8) -> quantile
models (M1, settings searched by M2-M4) -> holdout predictions + metrics (M5, A20) -> recursive paths
(M7) -> order plan from the first forecast day (I8) -> importances (M6).
Fitted runs are stored by a digest of their rows and settings (``artefact``); a
run is fitted where no stored one has that digest.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast import fixed
from tillcast.operators import features, forecast, quantile, recursive, splits
from tillcast.plans import artefact, order_plan
from tillcast.sources import sinks

SEARCH_GRID = [{"n_stages": n, "learning_rate": 0.05, "max_depth": k} for k in (3, 4) for n in (150, 300)]
BASE_PARAMS = {"n_stages": 100, "learning_rate": 0.1, "max_depth": 3}   # M3: where nothing is searched


QUANTILES = (0.5, 0.95)
FOREST = "quantile double, init double, rate double, stage int, f array<int>, t array<double>, l array<string>, v array<double>, g array<double>"


@dataclass
class RunResult:
    models: quantile.QuantileModels
    raw: DataFrame
    feature_df: DataFrame
    train: DataFrame
    test: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    params: dict            # the setting of each quantile
    importance: DataFrame
    search: DataFrame       # loss of each searched setting; no rows where nothing was searched
    folder: str             # the stored run


def fit_models(train: DataFrame, *, params: dict | None = None, allow_short_history: bool = False) -> quantile.SearchResult:
    """Models with ``params``, or else with the settings that the search over three date folds finds (M2).

    With short histories allowed (M3) the search has two folds, under 60 rows are
    fitted with ``BASE_PARAMS``, and so are all where the search fails.
    """
    def plain(p: dict) -> quantile.SearchResult:
        models = quantile.train_quantile_models(train, quantiles=QUANTILES, **p)
        return quantile.SearchResult(models, {q: p for q in QUANTILES}, [])

    if params:
        return plain(params)
    if allow_short_history and quantile.short_history_setting(train):
        return plain(BASE_PARAMS)
    n_folds = 2 if allow_short_history else 3
    try:
        return quantile.search_and_fit(train, splits.date_tiles(train, n_tiles=n_folds + 1), grid=SEARCH_GRID, quantiles=QUANTILES, n_folds=n_folds)
    except Exception as e:
        if not allow_short_history:
            raise
        logging.getLogger(__name__).warning("model search failed, the base setting is used: %s", e)
        return plain(BASE_PARAMS)


def _forest_rows(found: quantile.SearchResult) -> list[tuple]:
    return [(q, m.init, m.learning_rate, i, t["f"], t["t"], t["l"], t["v"], t["g"])
            for q, m in found.models.models.items() for i, t in enumerate(m.trees)]


def load_models(spark: SparkSession, folder: str, feature_cols=fixed.FEATURE_COLUMNS) -> quantile.QuantileModels:
    """The models of a stored run; the driver reads some hundred trees."""
    models: dict = {}
    for r in artefact.read(spark, folder, "forest").orderBy("quantile", "stage").collect():
        m = models.setdefault(r["quantile"], quantile.QuantileBoostModel(r["quantile"], r["init"], r["rate"]))
        m.trees.append({k: list(r[k]) for k in "ftlvg"})
    return quantile.QuantileModels(models, tuple(feature_cols))


def _stored_run(spark: SparkSession, feat: DataFrame, train: DataFrame, test: DataFrame, settings: dict, **fit) -> str:
    """Folder of the run of these rows and settings; fitted and stored if there is none."""
    digest = artefact.digest_of(feat.select("date", "demand_qty", *fixed.FEATURE_COLUMNS), settings)
    folder = artefact.find(spark, digest)
    if folder:
        return folder
    found = fit_models(train, **fit)
    chosen = [(q, p["n_stages"], float(p["learning_rate"]), p["max_depth"]) for q, p in found.chosen.items()]
    losses = [(q, *(SEARCH_GRID[i][k] for k in ("n_stages", "max_depth")), float(SEARCH_GRID[i]["learning_rate"]), v) for q, i, v in found.scores]
    return artefact.save(spark, digest, {
        "forest": spark.createDataFrame(_forest_rows(found), FOREST),
        "settings": spark.createDataFrame(chosen, "quantile double, n_stages int, learning_rate double, max_depth int"),
        "search": spark.createDataFrame(losses, "quantile double, n_stages int, max_depth int, learning_rate double, loss double"),
        "importance": importance_frame(spark, found.models),
        "metrics": forecast.forecast_metrics(found.models.predict(test)),
    })


def fit_and_evaluate(raw: DataFrame, *, test_days: int | None = None, params: dict | None = None,
                     strict: bool = True, allow_short_history: bool = False) -> RunResult:
    """A stored run of these rows, or one fitted now: with ``params``, or else with the settings that the search finds."""
    feat = features.create_features(raw, strict=strict, blocks=2 * raw.sparkSession.sparkContext.defaultParallelism)
    feat = feat.checkpoint(eager=True)                 # reused by training, scoring and forecasting
    spark = feat.sparkSession
    if test_days is None:
        # the short holdout and the fit on all rows belong to short histories only
        test_days = splits.run_test_days(feat.select("date").distinct().count()) if allow_short_history else 28
    train, test = splits.train_test(feat, test_days=test_days)
    if allow_short_history and train.limit(1).count() == 0:                   # P8: empty train -> all rows, no test
        train, test = feat, feat.where(F.lit(False))
    settings = {"test_days": test_days, "params": params, "short": allow_short_history, "grid": SEARCH_GRID, "base": BASE_PARAMS,
                "features": list(fixed.FEATURE_COLUMNS), "bins": quantile.MAX_BINS}
    folder = _stored_run(spark, feat, train, test, settings, params=params, allow_short_history=allow_short_history)
    models = load_models(spark, folder)
    chosen = {r["quantile"]: {k: r[k] for k in ("n_stages", "learning_rate", "max_depth")} for r in artefact.read(spark, folder, "settings").collect()}
    return RunResult(models, raw, feat, train, test, models.predict(test), artefact.read(spark, folder, "metrics"), chosen,
                     artefact.read(spark, folder, "importance"), artefact.read(spark, folder, "search"), folder)


def model_plan(raw: DataFrame, run: RunResult, *, horizons=(7, 30), lots=None, unit_costs=None,
               latest_date_items_only: bool = True) -> DataFrame:
    """I8 with model paths: q50/q95 daily = first step of the recursive path.

    By default only items with a feature row on the latest date are planned
    (as in the reference); ``latest_date_items_only=False`` plans every item
    from its own last row.
    """
    h = max(horizons)
    paths = recursive.recursive_forecast(run.models, raw, run.feature_df, horizon=h)
    if latest_date_items_only:
        last = run.feature_df.agg(F.max("date")).scalar()
        on_last = run.feature_df.where(F.col("date") == last).select("item_id").distinct()
        paths = paths.join(on_last, "item_id", "left_semi")
    p = paths.select("item_id",
                     *[forecast.horizon_slice(f"{q}_path", k).alias(f"forecast_{q}_{k}d") for k in horizons for q in ("q50", "q95")],
                     F.element_at("q50_path", 1).alias("q50_daily"), F.element_at("q95_path", 1).alias("q95_daily"))
    quant = p.select("item_id", "q50_daily", "q95_daily")
    path_cols = p.drop("q50_daily", "q95_daily")
    return order_plan.plan_from_quantiles(quant, raw, lots=lots, unit_costs=unit_costs, horizons=horizons,
                                          paths=path_cols)


@dataclass
class JobResult:
    plan: DataFrame
    run: RunResult | None   # None where the naive baseline was taken


def plan_job(raw: DataFrame, *, allow_short_history: bool = False, horizons=(7, 30), lots=None, unit_costs=None) -> JobResult:
    """M11 as one job: the models' plan, or the naive plan (M9) of a short history.

    The naive branch is taken only with ``allow_short_history``, when the item
    with the fewest days has less than ten, or there is no item at all.
    """
    if allow_short_history:
        fewest = raw.groupBy("item_id").agg(F.countDistinct("date").alias("n")).agg(F.min("n")).first()[0]
        if (fewest or 0) < fixed.NAIVE_MIN_HISTORY_DAYS:
            return JobResult(order_plan.naive_order_plan(raw, lots=lots, unit_costs=unit_costs, horizons=horizons), None)
    run = fit_and_evaluate(raw, allow_short_history=allow_short_history)
    return JobResult(model_plan(raw, run, horizons=horizons, lots=lots, unit_costs=unit_costs), run)


def write_run(out_dir: str, job: JobResult, *, fmt: str = "csv") -> dict:
    """Metrics, recommendations and importances of a job with models, under one folder."""
    return sinks.write_results(out_dir, metrics=job.run.metrics, plan=job.plan, importance=job.run.importance, fmt=fmt)


def importance_frame(spark, models: quantile.QuantileModels) -> DataFrame:
    rows = models.feature_importance()
    return spark.createDataFrame(rows, "feature string, importance double, importance_percentage double")
