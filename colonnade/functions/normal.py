"""Standard normal quantiles as a column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Coefficients of Acklam's rational approximation of the normal quantile.
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def polynomial(coefficients: Sequence[float], x: Column) -> Column:
    """Highest power first (Horner)."""
    total = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        total = total * x + F.lit(float(c))
    return total


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal for 0 < p < 1 (relative error about 1e-9)."""
    r = (p - 0.5) * (p - 0.5)
    centre = polynomial(CENTRE_TOP, r) * (p - 0.5) / polynomial(CENTRE_BOTTOM, r)
    edge = F.least(p, 1 - p)
    q = F.sqrt(-2 * F.log(F.when(edge > 0, edge)))
    tail = polynomial(TAIL_TOP, q) / polynomial(TAIL_BOTTOM, q)
    return F.when(edge <= 0, F.lit(None)).when(edge >= TAIL, centre).when(p < 0.5, tail).otherwise(-tail)
