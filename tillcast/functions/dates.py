"""Date helpers (F2, F7, F16).  'Today' is always an explicit ``as_of``."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_date_lit(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of.cast("date")
    if isinstance(as_of, (_dt.date, _dt.datetime)):
        as_of = as_of.isoformat()[:10]
    return F.lit(str(as_of)).cast("date")


def yyyymmdd_to_date(x) -> Column:
    """first eight characters as yyyyMMdd; invalid -> NULL."""
    s = F.substring(F.trim(_c(x).cast("string")), 1, 8)
    return F.try_to_timestamp(s, F.lit("yyyyMMdd")).cast("date")


def date_to_yyyymmdd(x) -> Column:
    return F.date_format(_c(x), "yyyyMMdd")


def days_until(target, as_of) -> Column:
    """whole days from as_of to target (negative when past)."""
    return F.datediff(_c(target), as_of_date(as_of))


def as_of_date(as_of) -> Column:
    return as_date_lit(as_of) if not isinstance(as_of, Column) else as_of.cast("date")


def month_day_label(x) -> Column:
    """F16: 'M/d' chart label."""
    return F.date_format(_c(x), "M/d")


def weekday0(x) -> Column:
    """Monday = 0 ... Sunday = 6 (the reference's convention, not dayofweek)."""
    return F.weekday(_c(x))
