"""Recursive multi-step forecast.

The whole horizon is one ``aggregate`` fold per item row: each step builds
the next day's features from the item's history (array functions), scores
both quantile models (each a compiled CASE-WHEN expression), and appends
the q50 to the history.  One narrow projection over the item frame: no
driver loop over steps or items, no per-step job, no shuffle; it scales
with the number of items like any map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast import fixed
from tillcast.operators.features import holiday_distance
from tillcast.operators.quantile import QuantileModels

HIST = 28
EXOG = ("temp_c", "rain_mm", "promo", "event_score_100")


def _lag(h, k):
    n = F.size(h)
    return F.when(n == 0, F.lit(0.0)).when(n < k, F.element_at(h, -1)).otherwise(F.element_at(h, -k))


def _tail(h, w):
    n = F.size(h)
    return F.when(n == 0, h).otherwise(F.slice(h, F.greatest(n - w + 1, F.lit(1)), w))


def _mean(a):
    n = F.size(a)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n)


def _std(a):
    n = F.size(a)
    m = _mean(a)
    ss = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.sqrt(ss / (n - 1)))


def history_features(h: Column) -> dict:
    """M8: lags (latest value if the history is shorter), rolling means / sample stds, trend."""
    last7, last14, last28 = _tail(h, 7), _tail(h, 14), _tail(h, 28)
    return {"lag_1": _lag(h, 1), "lag_7": _lag(h, 7), "lag_14": _lag(h, 14), "lag_28": _lag(h, 28),
            "roll_mean_7": _mean(last7), "roll_std_7": _std(last7), "roll_mean_14": _mean(last14),
            "roll_std_14": _std(last14), "trend_28d": _mean(last28)}


def calendar_features(d: Column) -> dict:
    wd = F.weekday(d)
    return {"day_of_week": wd, "is_weekend": (wd >= 5).cast("int"), "month": F.month(d), "day_of_month": F.dayofmonth(d)}


def initial_state(raw: DataFrame, feature_df: DataFrame, as_of=None) -> DataFrame:
    """Per item: last 28 demands (<= as_of), last known exogenous values and shop lag."""
    r = raw if as_of is None else raw.where(F.col("date") <= F.lit(str(as_of)).cast("date"))
    o = Window.partitionBy("item_id").orderBy(F.col("date").desc())
    hist = (r.select("item_id", "date", "demand_qty").withColumn("_rn", F.row_number().over(o))
             .where(F.col("_rn") <= HIST)            # bounded: 28 values per item
             .groupBy("item_id")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("date", F.col("demand_qty").cast("double").alias("q")))),
                              lambda s: s["q"]).alias("hist")))
    fd = feature_df if as_of is None else feature_df.where(F.col("date") <= F.lit(str(as_of)).cast("date"))
    last = fd.groupBy("item_id").agg(F.max_by(F.struct(
        F.col("temp_c").cast("double").alias("temp_c"), F.col("rain_mm").cast("double").alias("rain_mm"),
        F.col("promo").cast("double").alias("promo"), F.col("event_score_100").cast("double").alias("event_score_100"),
        F.col("shop_total_lag_7").cast("double").alias("shop_total_lag_7")), "date").alias("k")).select("item_id", "k.*")
    return hist.join(last, "item_id", "inner")


def horizon_calendar(raw: DataFrame, as_of: Column, horizon: int, future_holidays: DataFrame | None = None,
                     future_exogenous: DataFrame | None = None) -> DataFrame:
    """One row of horizon-length arrays: holiday flag / distances and exogenous overrides per step."""
    spark = raw.sparkSession
    hol = raw.where(F.col("is_holiday") == 1).select("date").distinct()
    if future_holidays is not None:
        hol = hol.unionByName(future_holidays.select("date")).distinct()
    days = spark.range(1, horizon + 1).select(F.col("id").cast("int").alias("step"),
                                             F.date_add(as_of, F.col("id").cast("int")).alias("date"))
    days = (days.join(hol.withColumn("_h", F.lit(1)), "date", "left")
                .withColumn("is_holiday", F.coalesce("_h", F.lit(0))).drop("_h"))
    cal = holiday_distance(days, holidays=hol)
    fields = ["is_holiday", "days_to_holiday", "days_since_holiday"]
    if future_exogenous is not None:
        fx = future_exogenous.select("date", *[F.col(x).cast("double").alias(f"fx_{x}") for x in EXOG
                                               if x in future_exogenous.columns])
        cal = cal.join(fx, "date", "left")          # the planner picks the strategy: fx size is the caller's
        fields += [c for c in fx.columns if c != "date"]
    st = F.array_sort(F.collect_list(F.struct("step", *fields)))
    return cal.agg(st.alias("_cal"))


def recursive_forecast(models: QuantileModels, raw: DataFrame, feature_df: DataFrame, *, horizon: int = 30,
                       as_of=None, future_exogenous: DataFrame | None = None,
                       future_holidays: DataFrame | None = None) -> DataFrame:
    """M7: per item, q50 / q95 paths of ``horizon`` days after as_of (default: the last date).

    ``future_exogenous`` (date + any of temp_c, rain_mm, promo, event_score_100)
    overrides the held-over last known values on its dates (J12).  Without a
    future holiday calendar, future days are not holidays and
    ``days_to_holiday`` is 999 (as in the reference); ``days_since_holiday``
    counts from the last past holiday.
    """
    if as_of is None:
        as_of = raw.agg(F.max("date")).first()[0]          # one scalar to the driver
    a = F.lit(str(as_of)).cast("date")
    state = initial_state(raw, feature_df, as_of)
    const = horizon_calendar(raw, a, horizon, future_holidays, future_exogenous).withColumn("as_of", a)
    # one row of horizon arrays as a scalar subquery (evaluated once, no join)
    c1 = const.select(F.struct("_cal", "as_of").alias("c")).scalar()
    s = state.withColumns({"_cal": c1["_cal"], "as_of": c1["as_of"]})
    q_hi = max(models.models)
    q_lo = 0.5 if 0.5 in models.models else min(models.models)  # the path that feeds the history

    has_fx = {x: _has_field(const, x) for x in EXOG}

    def step(acc, i):
        c = F.col("_cal")[i]
        d = F.date_add(F.col("as_of"), i + 1)

        def feats(h):       # h: the step's history, bound once as a lambda variable
            ex = {x: (F.coalesce(c[f"fx_{x}"], F.col(x)) if has_fx[x] else F.col(x)) for x in EXOG}
            fields = {**calendar_features(d), **history_features(h), **ex,
                      "item_id": F.col("item_id"), "shop_total_lag_7": F.col("shop_total_lag_7"),
                      "is_holiday": c["is_holiday"], "days_to_holiday": c["days_to_holiday"],
                      "days_since_holiday": c["days_since_holiday"]}
            ev = fields["event_score_100"]
            fields.update({"is_event": (ev > 0).cast("int"),
                           "major_event_flag": (ev >= fixed.MAJOR_EVENT_SCORE).cast("int"),
                           "event_score_x_weekend": ev * fields["is_weekend"], "event_score_x_promo": ev * fields["promo"]})
            return F.struct(*[v.alias(k) for k, v in fields.items()])

        # each intermediate is computed once per step: history -> features -> scores
        fs_arr = F.transform(F.array(_tail(F.concat(F.col("hist"), acc["q50"]), HIST)), feats)

        def score(f):       # f: the step's feature struct, evaluated once
            lo = F.greatest(models.expression(q_lo, lambda n: f[n]), F.lit(0.0))
            hi = F.greatest(models.expression(q_hi, lambda n: f[n]), F.lit(0.0))
            return F.struct(lo.alias("lo"), F.greatest(hi, lo).alias("hi"))

        r = F.transform(fs_arr, score)
        nxt = F.transform(r, lambda p: F.struct(F.concat(acc["q50"], F.array(p["lo"])).alias("q50"),
                                                F.concat(acc["q95"], F.array(p["hi"])).alias("q95")))
        return nxt[0]

    init = F.struct(F.array().cast("array<double>").alias("q50"), F.array().cast("array<double>").alias("q95"))
    res = F.aggregate(F.sequence(F.lit(0), F.lit(horizon - 1)), init, step)
    return s.select("item_id", "as_of", res["q50"].alias("q50_path"), res["q95"].alias("q95_path"))


def _has_field(df: DataFrame, x: str) -> bool:
    t = df.schema["_cal"].dataType.elementType
    return f"fx_{x}" in t.fieldNames()


def explode_paths(paths: DataFrame) -> DataFrame:
    """One row per (item, step) with the forecast date."""
    z = F.arrays_zip("q50_path", "q95_path")
    return paths.select("item_id", "as_of", F.posexplode(z).alias("i", "p")).select(
        "item_id", (F.col("i") + 1).alias("step"), F.date_add("as_of", F.col("i") + 1).alias("date"),
        F.col("p.q50_path").alias("q50"), F.col("p.q95_path").alias("q95"))
