"""Time-series features.

Series are row-ordered per item: lag k is k *rows* back, not k calendar days,
and missing days are never filled.  All per-item windows share one
``partitionBy(item).orderBy(date)`` spec, so Spark sorts the data once.
The windows run on the daily grid (one row per item and day), whose size is
bounded by items x days no matter how many sales lines fed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast import fixed
from tillcast.operators import halo


def _item_window(item_col="item_id", date_col="date", shop_cols=()):
    items = (item_col,) if isinstance(item_col, str) else item_col
    return Window.partitionBy(*shop_cols, *items).orderBy(date_col)


def calendar_features(df: DataFrame, date_col="date") -> DataFrame:
    """day_of_week (Mon=0), is_weekend, month, day_of_month."""
    return df.withColumns({
        "day_of_week": F.weekday(date_col),
        "is_weekend": (F.weekday(date_col) >= 5).cast("int"),
        "month": F.month(date_col),
        "day_of_month": F.dayofmonth(date_col),
    })


def event_features(df: DataFrame) -> DataFrame:
    """Event score cleaned to a number (missing -> 0) and its derived flags."""
    score = (F.coalesce(F.col("event_score_100").cast("string").try_cast("double"), F.lit(0.0))
             if "event_score_100" in df.columns else F.lit(0.0))
    df = df.withColumn("event_score_100", score)
    weekend = F.col("is_weekend") if "is_weekend" in df.columns else (F.weekday("date") >= 5).cast("int")
    return df.withColumns({
        "is_event": (F.col("event_score_100") > 0).cast("int"),
        "major_event_flag": (F.col("event_score_100") >= fixed.MAJOR_EVENT_SCORE).cast("int"),
        "event_score_x_weekend": F.col("event_score_100") * weekend,
        "event_score_x_promo": F.col("event_score_100") * F.col("promo"),
    })


def holiday_distance(df: DataFrame, *, date_col="date", flag_col="is_holiday",
                     shop_cols: tuple = (), holidays: DataFrame | None = None) -> DataFrame:
    """Days to the next holiday on/after and since the last one on/before (999 if none).

    Two as-of lookups done as running min / max over the *distinct dates*
    (a calendar: thousands of rows, not facts), then joined back on date.
    ``holidays`` (one ``date`` column) overrides the flag-derived calendar.
    """
    if holidays is None:
        cal = df.groupBy(*shop_cols, date_col).agg((F.max(flag_col) == 1).alias("_hol"))
    else:
        dates = df.select(*shop_cols, date_col).distinct()
        hol = holidays.select(F.col("date").alias(date_col)).distinct().withColumn("_h", F.lit(True))
        # every shop sees every holiday: shops x calendar days, a table of dimensions
        days = hol.select(date_col)
        if shop_cols:
            days = dates.select(*shop_cols).distinct().crossJoin(days)
        cal = (dates.unionByName(days)
               .select(*shop_cols, date_col).distinct()
               .join(hol, date_col, "left").select(*shop_cols, date_col, F.coalesce("_h", F.lit(False)).alias("_hol")))
    order = Window.partitionBy(*shop_cols).orderBy(date_col)
    hdate = F.when(F.col("_hol"), F.col(date_col))
    nxt = F.min(hdate).over(order.rowsBetween(0, Window.unboundedFollowing))
    prv = F.max(hdate).over(order.rowsBetween(Window.unboundedPreceding, 0))
    cal = cal.select(
        *shop_cols, date_col,
        F.coalesce(F.datediff(nxt, F.col(date_col)), F.lit(fixed.NO_HOLIDAY_DISTANCE)).alias("days_to_holiday"),
        F.coalesce(F.datediff(F.col(date_col), prv), F.lit(fixed.NO_HOLIDAY_DISTANCE)).alias("days_since_holiday"),
    )
    # without shops the calendar has one row per distinct day: a proven size bound -> broadcast
    return df.join(cal if shop_cols else F.broadcast(cal), [*shop_cols, date_col], "left")


def shop_total_lag(df: DataFrame, *, k: int = 7, shop_cols: tuple = (), strict: bool = True) -> DataFrame:
    """Shop demand total k distinct dates back, joined on date.

    Short-history mode falls back to the 1-date lag, then 0.
    """
    tot = df.groupBy(*shop_cols, "date").agg(F.sum("demand_qty").alias("_tot"))
    o = Window.partitionBy(*shop_cols).orderBy("date")
    val = F.lag("_tot", k).over(o)
    if not strict:
        val = F.coalesce(val, F.lag("_tot", 1).over(o), F.lit(0.0))
    tot = tot.select(*shop_cols, "date", val.alias(f"shop_total_lag_{k}"))
    # without shops, one row per day: bounded by the calendar -> broadcast
    return df.join(tot if shop_cols else F.broadcast(tot), [*shop_cols, "date"], "left")


def _lags(o, lags, target) -> dict:
    return {f"lag_{k}": F.lag(target, k).over(o) for k in lags}


def lag_features(df: DataFrame, lags=fixed.LAGS, *, target="demand_qty", item_col="item_id") -> DataFrame:
    """lag_k = value k rows back within the item."""
    return df.withColumns(_lags(_item_window(item_col), lags, target))


def rolling_features(df: DataFrame, windows=fixed.ROLL_WINDOWS, trend=fixed.TREND_WINDOW, *,
                     target="demand_qty", item_col="item_id", strict: bool = True) -> DataFrame:
    """W4-W6 (strict) / W8 (relaxed): mean and sample std of the previous w rows.

    Strict: the full window is required (else NULL).  Relaxed: mean needs 1
    row, std needs 2 rows.
    """
    return df.withColumns(_rolls(_item_window(item_col), windows, trend, target, strict))


def _rolls(o, windows, trend, target, strict) -> dict:
    cols = {}
    for w in windows:
        f = o.rowsBetween(-w, -1)
        n = F.count(target).over(f)
        cols[f"roll_mean_{w}"] = F.when(n >= (w if strict else 1), F.avg(target).over(f))
        cols[f"roll_std_{w}"] = F.when(n >= (w if strict else 2), F.stddev_samp(target).over(f))
    f = o.rowsBetween(-trend, -1)
    n = F.count(target).over(f)
    cols[f"trend_{trend}d"] = F.when(n >= (trend if strict else 1), F.avg(target).over(f))
    return cols


def create_features(df: DataFrame, *, strict: bool = True, shop_cols: tuple = (),
                    holidays: DataFrame | None = None, drop_incomplete: bool = True, blocks: int | None = None) -> DataFrame:
    """W1 (strict) / W2 (short history): the full model feature frame.

    With ``blocks`` the strict frame's lags and windows run over so many blocks of
    rows with halo rows, and not over one task per item.

    Strict drops rows with a NULL in any feature or target column (not every
    column: see SURVEY 2.13 note 1).  Relaxed fills std with 0 and lags /
    means with the expanding mean of past rows, then 0.
    """
    required = {"date", "item_id", "demand_qty", "temp_c", "rain_mm", "is_holiday", "promo"}
    missing = required.difference(df.columns)
    if missing:
        raise ValueError(f"Missing required columns: {sorted(missing)}")
    data = calendar_features(df)
    data = event_features(data)
    data = holiday_distance(data, shop_cols=shop_cols, holidays=holidays)
    data = shop_total_lag(data, k=7, shop_cols=shop_cols, strict=strict)
    key = (*shop_cols, "item_id")
    if strict and blocks:
        back = max(*fixed.LAGS, *fixed.ROLL_WINDOWS, fixed.TREND_WINDOW)
        data = halo.over_blocks(data, list(key), "date", back, lambda w: _lags(w, fixed.LAGS, "demand_qty") | _rolls(
            w, fixed.ROLL_WINDOWS, fixed.TREND_WINDOW, "demand_qty", True), blocks)
    else:
        data = lag_features(data, item_col=key)
        data = rolling_features(data, item_col=key, strict=strict)
    if not strict:
        o = _item_window(key)
        exp_mean = F.avg("demand_qty").over(o.rowsBetween(Window.unboundedPreceding, -1))
        fills = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("roll_std_7", "roll_std_14")}
        for c in ("lag_1", "lag_7", "lag_14", "lag_28", "roll_mean_7", "roll_mean_14", "trend_28d",
                  "shop_total_lag_7"):
            fills[c] = F.coalesce(F.col(c), exp_mean, F.lit(0.0))
        data = data.withColumns(fills)
    elif drop_incomplete:
        data = data.dropna(how="any", subset=[c for c in fixed.FEATURE_COLUMNS if c in data.columns] + ["demand_qty"])
    return data


def small_feature_set(df: DataFrame) -> DataFrame:
    """Calendar + lags 1/7/14 + rolling 7/14, no exogenous inputs; incomplete rows dropped."""
    data = calendar_features(df)
    data = lag_features(data, lags=(1, 7, 14))
    data = rolling_features(data, windows=(7, 14), trend=28).drop("trend_28d")
    keep = ["lag_1", "lag_7", "lag_14", "roll_mean_7", "roll_std_7", "roll_mean_14", "roll_std_14"]
    return data.dropna(how="any", subset=keep + ["demand_qty"])


def sequence_windows(df: DataFrame, feature_cols, *, timesteps: int = 14, item_col="item_id") -> DataFrame:
    """For each row, the previous ``timesteps`` rows of numeric features.

    Only full windows are kept.  The window is bounded by ``timesteps`` rows,
    so the array per row never grows with the data.
    """
    o = _item_window(item_col).rowsBetween(-timesteps, -1)
    vec = F.array(*[F.col(c).cast("double") for c in feature_cols])
    seq = F.collect_list(vec).over(o)
    return (df.select(item_col, "date", "demand_qty", seq.alias("window"))
              .where(F.size("window") == timesteps))


def standardize_sequences(seq: DataFrame, n_features: int) -> DataFrame:
    """Z-score every feature over all timesteps of all windows (population std)."""
    flat = seq.select(F.explode("window").alias("v"))
    stats = flat.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(n_features)],
                     *[F.stddev_pop(F.col("v")[i]).alias(f"s{i}") for i in range(n_features)])
    # one-row statistics as a scalar subquery (evaluated once, no join)
    st = stats.select(F.struct(*stats.columns).alias("st")).scalar()
    j = seq.withColumns({c: st[c] for c in stats.columns})
    scaled = F.transform("window", lambda v: F.array(*[
        (v[i] - F.col(f"m{i}")) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(F.lit(1.0))
        for i in range(n_features)]))
    return j.select("item_id", "date", "demand_qty", scaled.alias("window"))
