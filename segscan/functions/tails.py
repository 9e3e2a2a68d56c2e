"""Tail probabilities of the chi-square and the t distribution, as expressions; batches of values are worked out at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The upper regularised incomplete gamma function for a > 0, x >= 0: its series below a + 1, its continued fraction above."""
    out = np.ones(len(x))
    scale = np.array([math.exp(-v + s * math.log(v) - math.lgamma(s)) if v > 0 else 0.0 for s, v in zip(a, x)])
    low = (x > 0) & (x < a + 1)
    term = total = 1 / a[low]
    for n in range(1, 1000):
        term = term * x[low] / (a[low] + n)
        total = total + term
        if not len(term) or (np.abs(term) < np.abs(total) * 1e-16).all():
            break
    out[low] = 1 - scale[low] * total
    high = x >= a + 1
    b = x[high] + 1 - a[high]
    c, d = np.full(high.sum(), 1e300), 1 / b
    h = d
    for n in range(1, 1000):
        an = -n * (n - a[high])
        b = b + 2
        d, c = 1 / (an * d + b), b + an / c
        h = h * d * c
        if not len(h) or (np.abs(d * c - 1) < 1e-15).all():
            break
    out[high] = scale[high] * h
    return out


def beta_part(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that is quick."""
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    front = np.array([math.exp(math.lgamma(i + j) - math.lgamma(i) - math.lgamma(j) + i * math.log(v) + j * math.log1p(-v)) / i if 0 < v < 1 else 0.0 for i, j, v in zip(p, q, y)])
    c, d = np.ones(len(y)), 1 / (1 - (p + q) * y / (p + 1))
    h = d
    for n in range(1, 1000):
        even = n * (q - n) * y / ((p + 2 * n - 1) * (p + 2 * n))
        d, c = 1 / (1 + even * d), 1 + even / c
        h = h * d * c
        odd = -(p + n) * (p + q + n) * y / ((p + 2 * n) * (p + 2 * n + 1))
        d, c = 1 / (1 + odd * d), 1 + odd / c
        h = h * d * c
        if not len(h) or (np.abs(d * c - 1) < 1e-15).all():
            break
    part = np.where(y <= 0, 0.0, front * h)
    return np.where(flip, 1 - part, part)


def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    fit = (x.notna() & df.notna() & (df > 0) & (x >= 0)).to_numpy()
    out = np.full(len(x), np.nan)
    out[fit] = gamma_tail(df.to_numpy(float)[fit] / 2, x.to_numpy(float)[fit] / 2)
    return pd.Series(out).astype(object).where(fit, None)


def _t(t: pd.Series, df: pd.Series) -> pd.Series:
    fit = (t.notna() & df.notna() & (df > 0)).to_numpy()
    v, s = df.to_numpy(float)[fit], t.to_numpy(float)[fit]
    out = np.full(len(t), np.nan)
    out[fit] = beta_part(v / 2, np.full(len(v), 0.5), v / (v + s * s))
    return pd.Series(out).astype(object).where(fit, None)


def chi2_tail(x: Column, df: Column | int) -> Column:
    """The probability of ``x`` or more; null for nulls, negative values and degrees of freedom that aren't above 0."""
    return F.pandas_udf(_chi2, "double")(x.cast("double"), (F.lit(df) if isinstance(df, int) else df).cast("double"))


def t_tails(t: Column, df: Column) -> Column:
    """The probability of ``t`` or more on either side; null for nulls and degrees of freedom that aren't above 0."""
    return F.pandas_udf(_t, "double")(t.cast("double"), df.cast("double"))
