"""Tail probabilities that Spark has no function for, as Arrow-batched functions of columns.

Continued fractions follow the public modified Lentz scheme; all of a batch at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300
_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, for x below (a + 1) / (a + b + 2)."""
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return h


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.where(np.isnan(a) | np.isnan(b) | np.isnan(x), np.nan, np.clip(x, 0, 1))
    inner = (out > 0) & (out < 1) & (a > 0) & (b > 0)
    if inner.any():
        p, q, z = a[inner], b[inner], x[inner]
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z))
        flip = z > (p + 1) / (p + q + 2)
        u, v, w = np.where(flip, q, p), np.where(flip, p, q), np.where(flip, 1 - z, z)
        part = front * _beta_fraction(u, v, w) / u
        out = out.copy()
        out[inner] = np.where(flip, 1 - part, part)
    return out


def gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.where(np.isnan(a) | np.isnan(x), np.nan, np.where(x <= 0, 1.0, 0.0))
    live = (x > 0) & np.isfinite(x) & (a > 0)
    low = live & (x < a + 1)
    if low.any():
        p, z = a[low], x[low]
        term = 1 / p
        total = term.copy()
        for k in range(1, 2000):
            term = term * z / (p + k)
            total += term
            if (np.abs(term) < np.abs(total) * 1e-16).all():
                break
        out[low] = 1 - total * np.exp(-z + p * np.log(z) - _lgamma(p))
    high = live & ~low
    if high.any():
        p, z = a[high], x[high]
        b = z + 1 - p
        c = np.full_like(z, 1 / _TINY)
        d = 1 / b
        h = d.copy()
        for k in range(1, 2000):
            num = -k * (k - p)
            b = b + 2
            d = num * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = h * np.exp(-z + p * np.log(z) - _lgamma(p))
    return out


def norm_sf_array(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2)) if np.size(z) else np.zeros(0)


def t_two_sided_array(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def f_sf_array(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


@F.pandas_udf(DoubleType())
def norm_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value of z."""
    return pd.Series(2 * norm_sf_array(z.abs().to_numpy()))


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of t with ``df`` degrees of freedom, which needn't be whole."""
    return pd.Series(t_two_sided_array(t.to_numpy(), df.to_numpy()))


@F.pandas_udf(DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_sf_array(f.to_numpy(), d1.to_numpy(), d2.to_numpy()))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(gamma_q(df.to_numpy() / 2, x.to_numpy() / 2))


def hypergeom_sf_array(k: np.ndarray, total: np.ndarray, marked: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Chance of at least ``k`` marked among ``drawn`` of ``total``."""

    def one(k: float, n: float, m: float, d: float) -> float:
        lo, hi = int(max(k, d - (n - m), 0)), int(min(m, d))
        if lo > hi:
            return 0.0
        i = np.arange(lo, hi + 1)
        lc = lambda a, b: _lgamma(a + 1.0) - _lgamma(b + 1.0) - _lgamma(a - b + 1.0)
        return float(min(1.0, np.exp(lc(m, i) + lc(n - m, d - i) - lc(n, d)).sum()))

    return np.array([one(*v) for v in zip(k, total, marked, drawn, strict=True)])


@F.pandas_udf(DoubleType())
def hypergeom_sf(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series(hypergeom_sf_array(k.to_numpy(float), total.to_numpy(float), marked.to_numpy(float), drawn.to_numpy(float)))
