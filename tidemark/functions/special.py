"""Tail probabilities, vectorised over one value per series or pair.

The statistics themselves are DataFrame aggregates; only these last steps run in pandas.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])
TINY = 1e-300
EXACT_KS_ROWS = 10_000  # the published rule: exact up to this many rows on a side


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(
            _LGAMMA(p + q) - _LGAMMA(p) - _LGAMMA(q) + p * np.log(z) + q * np.log1p(-z)
        )
        c = np.ones_like(z)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < TINY, TINY, d)
        frac = d.copy()
        for m in range(1, 300):
            for step in (
                m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 + step * d
                d = 1 / np.where(np.abs(d) < TINY, TINY, d)
                c = 1 + step / c
                c = np.where(np.abs(c) < TINY, TINY, c)
                frac = frac * d * c
        value = np.where(z <= 0, 0.0, front * frac / p)
    return np.where(swap, 1 - value, value)


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - _LGAMMA(a))
        term = 1 / a
        total = term.copy()
        for n in range(1, 600):
            term = term * x / (a + n)
            total = total + term
        low = 1 - front * total
        b = x + 1 - a
        c = np.full_like(x, 1 / TINY)
        d = 1 / b
        frac = d.copy()
        for i in range(1, 600):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            frac = frac * d * c
        high = front * frac
    return np.where(x <= 0, 1.0, np.where(x < a + 1, low, high))


def ks_probability(d: float, n1: int, n2: int) -> float:
    """P(D >= d) of two samples: exact by lattice paths, asymptotic for large samples."""
    if not np.isfinite(d) or n1 < 1 or n2 < 1:
        return float("nan")
    if max(n1, n2) > EXACT_KS_ROWS:
        z = d * math.sqrt(n1 * n2 / (n1 + n2))
        k = np.arange(1, 101)
        return float(np.clip(2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k**2 * z**2)), 0, 1))
    # share of the monotone paths (0,0) -> (n1,n2) that stay strictly inside the band
    inside = np.zeros(n1 + 1)
    inside[0] = 1.0
    i = np.arange(n1 + 1)
    for s in range(1, n1 + n2 + 1):
        j = s - i
        ok = (j >= 0) & (j <= n2) & (np.abs(i / n1 - j / n2) < d - 1e-12)
        from_left = np.concatenate([[0.0], inside[:-1]])
        inside = np.where(ok, from_left * (i / s) + inside * (np.clip(j, 0, None) / s), 0.0)
    return float(np.clip(1 - inside[n1], 0, 1))


@pandas_udf(DoubleType())
def f_sf(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution; NULL in, NULL out."""
    known = (f.notna() & df1.notna() & df2.notna()).to_numpy()
    out = np.full(len(f), np.nan)
    if known.any():
        v, a, b = (s.to_numpy(dtype=float)[known] for s in (f, df1, df2))
        out[known] = beta_inc(b / 2, a / 2, b / (b + a * np.maximum(v, 0)))
    return pd.Series(out)


@pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution."""
    known = (x.notna() & df.notna()).to_numpy()
    out = np.full(len(x), np.nan)
    if known.any():
        v, k = (s.to_numpy(dtype=float)[known] for s in (x, df))
        out[known] = gamma_upper(k / 2, np.maximum(v, 0) / 2)
    return pd.Series(out)


@pandas_udf(DoubleType())
def ks_sf(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """p-value of the two-sample Kolmogorov-Smirnov statistic."""
    return pd.Series(
        [ks_probability(float(x), int(a), int(b)) for x, a, b in zip(d, n1, n2, strict=True)]
    )
