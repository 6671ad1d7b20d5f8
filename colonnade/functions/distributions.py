"""Tail probabilities of the F, chi-squared and normal distributions.

They run on result rows (one per tested pair), as Arrow batches inside the executors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

TINY = 1e-300
STEPS = 500


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    total = d.copy()
    for m in range(1, STEPS):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            total = total * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return total


def beta_lower(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    x = np.clip(x, 0.0, 1.0)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    direct = x < (a + 1) / (a + b + 2)
    lower = front * beta_fraction(a, b, np.where(direct, inner, 0.0)) / a
    upper = 1 - front * beta_fraction(b, a, np.where(direct, 0.0, 1 - inner)) / b
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(direct, lower, upper)))


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(a, x): series or continued fraction."""
    out = np.ones_like(x)
    for i, (s, v) in enumerate(zip(a, x)):
        if not v > 0:
            continue
        front = math.exp(-v + s * math.log(v) - math.lgamma(s))
        if v < s + 1:
            term = total = 1 / s
            k = s
            while abs(term) > abs(total) * 1e-16:
                k += 1
                term *= v / k
                total += term
            out[i] = 1 - total * front
        else:
            b = v + 1 - s
            c, d = 1 / TINY, 1 / b
            h = d
            for k in range(1, 10 * STEPS):
                step = -k * (k - s)
                b += 2
                d = 1 / (step * d + b or TINY)
                c = b + step / c or TINY
                h *= c * d
                if abs(c * d - 1) < 1e-15:
                    break
            out[i] = front * h
    return out


def with_nulls(fn, *columns: pd.Series) -> pd.Series:
    frame = pd.concat([c.astype(float) for c in columns], axis=1)
    ok = frame.notna().all(axis=1).to_numpy()
    out = np.full(len(frame), np.nan)
    if ok.any():
        out[ok] = fn(*[frame.iloc[:, i].to_numpy()[ok] for i in range(frame.shape[1])])
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def f_sf(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f)."""
    @F.pandas_udf("double")
    def tail(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return with_nulls(lambda v, m, n: beta_lower(n / 2, m / 2, n / (n + m * v)), f, a, b)

    return tail(f.cast("double"), df1.cast("double"), df2.cast("double"))


def chi2_sf(x: Column, dof: Column) -> Column:
    """P(chi-squared > x)."""
    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return with_nulls(lambda v, n: gamma_upper(n / 2, v / 2), x, k)

    return tail(x.cast("double"), dof.cast("double"))


def normal_sf(z: Column) -> Column:
    """P(Z > z)."""
    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return with_nulls(lambda v: 0.5 * np.vectorize(math.erfc, otypes=[float])(v / math.sqrt(2)), z)

    return tail(z.cast("double"))
