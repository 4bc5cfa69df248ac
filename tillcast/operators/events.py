"""Event impact score (0-100) as one column expression, and the daily feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast import fixed


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def event_score(visitors, distance_m, on_main_flow, overlap_ratio, customer_fit, dwell_hours,
                public_event=None) -> Column:
    """Size + distance (+main-flow bonus, capped) + time overlap + fit + dwell, capped at 100."""
    v, dist = _c(visitors), _c(distance_m)
    size = F.lit(0)
    for bound, pts in reversed(fixed.EVENT_SIZE_BANDS):       # ascending bounds, last match wins
        size = F.when(v >= bound, F.lit(pts)).otherwise(size)
    d = F.lit(0)
    for bound, pts in reversed(fixed.EVENT_DISTANCE_BANDS):   # descending bounds so nearest band wins
        d = F.when(dist <= bound, F.lit(pts)).otherwise(d)
    d = F.when(_c(on_main_flow), F.least(F.lit(fixed.EVENT_DISTANCE_CAP), d + fixed.EVENT_MAIN_FLOW_BONUS)).otherwise(d)
    ov = F.least(F.greatest(_c(overlap_ratio).cast("double"), F.lit(0.0)), F.lit(1.0))
    t = F.when(ov > 0, F.lit(fixed.EVENT_OVERLAP_ANY)).otherwise(F.lit(0))
    for bound, pts in reversed(fixed.EVENT_OVERLAP_BANDS):
        t = F.when(ov >= bound, F.lit(pts)).otherwise(t)
    fit = F.least(F.greatest(_c(customer_fit).cast("double"), F.lit(0.0)), F.lit(1.0))
    f = F.bround(fit * fixed.EVENT_FIT_POINTS, 0).cast("int")          # Python round: half even
    dw = F.lit(fixed.EVENT_DWELL_MIN)
    for bound, pts in reversed(fixed.EVENT_DWELL_BANDS):
        dw = F.when(_c(dwell_hours) >= bound, F.lit(pts)).otherwise(dw)
    total = F.least(F.lit(100), size + d + t + f + dw).cast("int")
    if public_event is None:
        return total
    return F.when(_c(public_event), total).otherwise(F.lit(0))


def daily_event_score(scored: DataFrame, *, keys=("date",)) -> DataFrame:
    """Highest event score per (shop, date): the model's ``event_score_100`` input."""
    return scored.groupBy(*keys).agg(F.max("event_score_100").cast("double").alias("event_score_100"))
