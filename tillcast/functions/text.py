"""Text helpers (F6, F11, F13): currency, keyword tagging, impact label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillcast import fixed


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def currency_to_number(x) -> Column:
    """keep digits only ('₩12,300' -> 12300)."""
    return F.regexp_replace(_c(x).cast("string"), "[^0-9]", "").try_cast("long")


def format_krw(x) -> Column:
    """'₩' + grouped integer amount."""
    return F.concat(F.lit("₩"), F.format_number(_c(x).cast("double"), 0))


def keyword_tags(text) -> Column:
    """array of (label, weight_pct) structs for every rule the text matches."""
    t = _c(text)
    hits = [F.when(t.rlike(pat), F.struct(F.lit(label).alias("label"), F.lit(w).alias("weight_pct")))
            for pat, label, w in fixed.KEYWORD_RULES]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def impact_label(weight_pct) -> Column:
    """demand impact sentence from an integer percent."""
    w = _c(weight_pct)
    up_pre, up_post = fixed.IMPACT_UP.split("{}")
    dn_pre, dn_post = fixed.IMPACT_DOWN.split("{}")
    return (F.when(w > 0, F.concat(F.lit(up_pre), w.cast("string"), F.lit(up_post)))
             .when(w < 0, F.concat(F.lit(dn_pre), F.abs(w).cast("string"), F.lit(dn_post)))
             .otherwise(F.lit(fixed.IMPACT_NONE)))


def pty_text(code) -> Column:
    """precipitation type code -> text."""
    c = _c(code)
    expr = None
    for k, v in fixed.PTY_TEXT.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr.otherwise(F.lit(fixed.PTY_TEXT_OTHER))
