"""Statistics as plain column arithmetic (F15 and friends)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of P. J. Acklam's rational approximation of the
# inverse standard normal CDF (published algorithm; relative error < 1.2e-9).
ACKLAM_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
ACKLAM_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00)
ACKLAM_P_LOW = 0.02425


def _horner(coefs, x: Column, tail_one: bool = False) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    if tail_one:
        acc = acc * x + F.lit(1.0)
    return acc


def inv_norm_cdf(p) -> Column:
    """Inverse standard normal CDF for p in (0, 1) as one CASE expression."""
    p = F.col(p) if isinstance(p, str) else p
    q_lo = F.sqrt(-2.0 * F.log(p))
    q_hi = F.sqrt(-2.0 * F.log(1.0 - p))
    q_mid = p - 0.5
    r = q_mid * q_mid
    lower = _horner(ACKLAM_C, q_lo) / _horner(ACKLAM_D, q_lo, tail_one=True)
    upper = -_horner(ACKLAM_C, q_hi) / _horner(ACKLAM_D, q_hi, tail_one=True)
    central = _horner(ACKLAM_A, r) * q_mid / _horner(ACKLAM_B, r, tail_one=True)
    return (F.when(p < ACKLAM_P_LOW, lower)
             .when(p > 1.0 - ACKLAM_P_LOW, upper)
             .otherwise(central))


def inv_norm_cdf_sql(p: str) -> str:
    """The same approximation as SQL text (used by the DuckDB oracle)."""
    def horner(coefs, x, tail_one=False):
        acc = repr(coefs[0])
        for c in coefs[1:]:
            acc = f"(({acc}) * ({x}) + ({c!r}))"
        if tail_one:
            acc = f"(({acc}) * ({x}) + 1.0)"
        return acc
    qlo = f"sqrt(-2.0 * ln({p}))"
    qhi = f"sqrt(-2.0 * ln(1.0 - ({p})))"
    qm = f"(({p}) - 0.5)"
    r = f"({qm} * {qm})"
    return (f"(CASE WHEN ({p}) < {ACKLAM_P_LOW} THEN {horner(ACKLAM_C, qlo)} / {horner(ACKLAM_D, qlo, True)} "
            f"WHEN ({p}) > {1.0 - ACKLAM_P_LOW!r} THEN -{horner(ACKLAM_C, qhi)} / {horner(ACKLAM_D, qhi, True)} "
            f"ELSE {horner(ACKLAM_A, r)} * {qm} / {horner(ACKLAM_B, r, True)} END)")


def pinball(y, q_pred, alpha: float) -> Column:
    """Pinball (quantile) loss of one prediction."""
    y = F.col(y) if isinstance(y, str) else y
    q_pred = F.col(q_pred) if isinstance(q_pred, str) else q_pred
    e = y - q_pred
    return F.greatest(F.lit(alpha) * e, F.lit(alpha - 1.0) * e)
