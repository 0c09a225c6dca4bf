"""Scaling, z-score thresholds and peaks-over-threshold (SPOT) detection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import with_scalar
from tidemark.schema import SERIES
from tidemark.session import spread


def standard_scale(
    df: DataFrame,
    columns: list[str],
    keys: list[str] = (),
    with_mean: bool = True,
    with_std: bool = True,
) -> DataFrame:
    """Scale the named columns by mean and population std; scaled columns come first.

    A zero deviation divides by one. Without keys the parameters are one row; with keys they
    are joined back on the key.
    """
    keys = list(keys)
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}")]
    params = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    joined = df.join(params, keys) if keys else with_scalar(df, params)
    scaled = []
    for c in columns:
        out = F.col(c) - F.col(f"_m_{c}") if with_mean else F.col(c)
        if with_std:
            s = F.col(f"_s_{c}")
            out = out / F.when(s == 0, F.lit(1.0)).otherwise(s)
        scaled.append(out.alias(c))
    return joined.select(*scaled, *[c for c in df.columns if c not in columns])


def zscore_fit(df: DataFrame, keys: list[str] = SERIES, value: str = "residual") -> DataFrame:
    """Mean and population std per key: the parameter table."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sigma"))


def zscore_predict(
    df: DataFrame,
    params: DataFrame,
    keys: list[str] = SERIES,
    value: str = "residual",
    threshold: Column | float = 3.0,
) -> DataFrame:
    """Every row with its z-score and the flag abs(z) > threshold (strict)."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    z = F.try_divide(F.col(value) - F.col("mu"), F.col("sigma"))
    return (
        df.join(params, keys)
        .withColumn("z", z)
        .withColumn("is_anomaly", F.coalesce(F.abs("z") > limit, F.lit(False)))
        .drop("mu", "sigma")
    )


def split_calibration(
    df: DataFrame,
    n_init: int | float,
    keys: list[str] = SERIES,
    order: str = "ts",
) -> DataFrame:
    """Mark the first n rows (int) or the first share of rows (float) as calibration."""
    ordered = Window.partitionBy(*keys).orderBy(order)
    rn = F.row_number().over(ordered)
    if isinstance(n_init, float):
        size = F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) * F.lit(n_init))
    else:
        size = F.lit(n_init)
    return df.withColumn("is_init", rn <= size)


def pot_init(
    df: DataFrame, level: float = 0.98, keys: list[str] = SERIES, value: str = "value"
) -> DataFrame:
    """Initial threshold (sorted element floor(level * n)) with n and the number of peaks.

    ``df`` holds the calibration rows of each series, a bounded group.
    """
    by_value = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    ranked = df.select(
        *keys,
        value,
        (F.row_number().over(by_value) - 1).alias("_i"),
        F.count(F.lit(1)).over(whole).alias("_n"),
    )
    at = F.floor(F.lit(float(level)) * F.col("_n"))
    level_rows = ranked.withColumn(
        "_t", F.max(F.when(F.col("_i") == at, F.col(value))).over(whole)
    )
    return level_rows.groupBy(*keys).agg(
        F.first("_t").alias("init_threshold"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col(value) > F.col("_t"), 1)).alias("n_peaks"),
    )


def pot_quantile(
    init_threshold: Column, gamma: Column, sigma: Column, n: Column, n_peaks: Column, q: float
) -> Column:
    """Extreme quantile at risk q for a generalised Pareto tail; NULL without peaks."""
    r = F.try_divide(n * F.lit(q), n_peaks)
    pareto = init_threshold + F.try_divide(sigma, gamma) * (F.pow(r, -gamma) - 1)
    exponential = init_threshold - sigma * F.log(r)
    return F.when(gamma == 0, exponential).otherwise(pareto)


def grimshaw(peaks: np.ndarray, grid: int = 64) -> tuple[float, float]:
    """Maximum-likelihood (gamma, sigma) of a generalised Pareto tail, by Grimshaw's reduction.

    Candidates are the roots of u(t) v(t) = 1, bracketed on fixed grids over
    (-1 / max, 0) and (0, 2 (mean - min) / min^2] and bisected, plus the exponential tail
    (gamma = 0). The grids are logarithmic towards zero; closer to zero than 1e-4 / mean the
    tail is exponential for all purposes. Deterministic.
    """
    y = np.asarray(peaks, dtype=float)
    mean, low, high = y.mean(), y.min(), y.max()
    best = (0.0, float(mean))
    best_ll = -y.size * (1.0 + np.log(mean))
    if low == high:
        return best

    def w(t: np.ndarray) -> np.ndarray:
        s = 1.0 + np.multiply.outer(t, y)
        return (1.0 + np.log(s).mean(axis=-1)) * (1.0 / s).mean(axis=-1) - 1.0

    near, edge = 1e-4 / mean, 1.0 / high
    left = np.concatenate(
        [
            -edge * (1 - np.geomspace(1e-8, 0.5, grid)),
            -np.geomspace(0.5 * edge, near, grid)[1:] if near < 0.5 * edge else [],
        ]
    )
    far = 2 * (mean - low) / low**2
    right = np.geomspace(near, far, 2 * grid) if far > near else np.zeros(0)
    roots: list[float] = []
    for t in (left, right):
        if len(t) < 2:
            continue
        f = w(t)
        turn = np.flatnonzero(np.sign(f[:-1]) * np.sign(f[1:]) < 0)
        if not len(turn):
            continue
        a, b, fa = t[turn], t[turn + 1], f[turn]
        for _ in range(50):
            m = (a + b) / 2
            same = np.sign(w(m)) == np.sign(fa)
            a, b = np.where(same, m, a), np.where(same, b, m)
        roots += list((a + b) / 2)
    for t in roots:
        gamma = np.log1p(t * y).mean()
        sigma = gamma / t
        if gamma == 0 or sigma <= 0:
            continue
        ll = -y.size * np.log(sigma) - (1 + 1 / gamma) * np.log1p(t * y).sum()
        if ll > best_ll:
            best, best_ll = (float(gamma), float(sigma)), ll
    return best


def extreme_quantile(t: float, peaks: np.ndarray, n: int, q: float) -> float:
    """Fit the tail and return the quantile; infinite while there is no peak to fit."""
    if len(peaks) == 0:
        return np.inf
    gamma, sigma = grimshaw(peaks)
    r = n * q / len(peaks)
    if gamma != 0:
        return t + sigma / gamma * (r**-gamma - 1)
    return t - sigma * np.log(r)


class Spot:
    """State of one series: initial threshold, peaks, count and current extreme quantile."""

    def __init__(self, t: float, peaks, n: int, q: float, with_alarm: bool = True):
        self.t, self.n, self.q, self.with_alarm = t, int(n), q, with_alarm
        self.peaks = list(peaks)
        self.z = extreme_quantile(t, np.asarray(self.peaks), self.n, q)

    @classmethod
    def calibrate(cls, init: np.ndarray, q: float, level: float, with_alarm: bool = True):
        ordered = np.sort(init)
        t = float(ordered[min(int(level * ordered.size), ordered.size - 1)])
        return cls(t, init[init > t] - t, init.size, q, with_alarm)

    def step(self, x: float) -> tuple[float, bool]:
        """Consume one value; returns the threshold after it and whether it raised an alarm."""
        if x > self.z and self.with_alarm:
            return self.z, True
        self.n += 1
        if x > self.t:
            self.peaks.append(x - self.t)
            self.z = extreme_quantile(self.t, np.asarray(self.peaks), self.n, self.q)
        return self.z, False


def gpd_fit(df: DataFrame, keys: list[str] = SERIES, peak: str = "peak") -> DataFrame:
    """(gamma, sigma) per series from its peaks (bounded by the rows of one series)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        gamma, sigma = grimshaw(pdf[peak].to_numpy())
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "gamma": [gamma], "sigma": [sigma], "n_peaks": [len(pdf)]})

    schema = ", ".join([f"{k} string" for k in keys] + ["gamma double, sigma double, n_peaks long"])
    return spread(df.select(*keys, peak), keys).groupBy(*keys).applyInPandas(fit, schema)


def spot_run(
    df: DataFrame,
    n_init: int = 168,
    q: float = 1e-4,
    level: float = 0.98,
    with_alarm: bool = True,
    keys: list[str] = SERIES,
) -> DataFrame:
    """SPOT over each series in time order: one threshold and alarm flag per row after the
    calibration rows. Each step depends on the one before, hence a grouped map per series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        values = pdf["value"].to_numpy()
        out = pdf.iloc[n_init:].copy()
        if len(out):
            state = Spot.calibrate(values[:n_init], q, level, with_alarm)
            steps = [state.step(float(x)) for x in values[n_init:]]
            out["threshold"] = [s[0] for s in steps]
            out["alarm"] = [s[1] for s in steps]
        else:
            out["threshold"], out["alarm"] = pd.Series(dtype=float), pd.Series(dtype=bool)
        return out

    schema = ", ".join(
        [f"{k} string" for k in keys]
        + ["ts timestamp_ntz, value double, threshold double, alarm boolean"]
    )
    rows = df.filter(F.col("value").isNotNull()).select(*keys, "ts", "value")
    return spread(rows, keys).groupBy(*keys).applyInPandas(run, schema)
