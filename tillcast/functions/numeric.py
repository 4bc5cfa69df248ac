"""Numeric cleaning and rounding helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_number(x) -> Column:
    """strip thousands separators and blanks; anything unparsable -> NULL."""
    s = F.trim(F.regexp_replace(_c(x).cast("string"), ",", ""))
    # try_cast keeps ANSI mode from failing the job on junk values
    return s.try_cast("double")


def rain_mm(x) -> Column:
    """rain text to millimetres.  'no rain' text, ranges and '<1mm' all map to 0."""
    v = _c(x).cast("string")
    return F.coalesce(F.regexp_replace(v, "mm", "").try_cast("double"), F.lit(0.0))


def pty_code(x) -> Column:
    """precipitation-type code, invalid -> 0."""
    return F.coalesce(F.trim(_c(x).cast("string")).try_cast("int"), F.lit(0))


def pct_change(cur, base) -> Column:
    """Percent change with one decimal (half up); 0 when the base is <= 0."""
    cur, base = _c(cur), _c(base)
    return F.when(base > 0, F.floor((cur - base) / base * 1000 + 0.5) / 10).otherwise(F.lit(0.0))


def round_half_up(x, scale: int = 0) -> Column:
    """JavaScript Math.round semantics (ties toward +inf) at a scale."""
    m = 10 ** scale
    r = F.floor(_c(x) * m + 0.5)
    return r if scale == 0 else r / m


def round_half_even(x, scale: int = 0) -> Column:
    """Python / NumPy round (banker's rounding)."""
    return F.bround(_c(x), scale)


def days_of_stock(stock, usage, none_value: float = 999.0) -> Column:
    """stock / usage; a fixed large number when usage <= 0."""
    stock, usage = _c(stock), _c(usage)
    return F.when(usage > 0, stock / usage).otherwise(F.lit(float(none_value)))
