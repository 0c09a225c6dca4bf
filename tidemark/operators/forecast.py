"""Trend-plus-seasonality forecaster: features, fit, prediction, cross-validation, repair.

The model is y = trend * (1 + multiplicative terms) + additive terms with a piecewise-linear
trend (Taylor and Letham 2018). The fit is the maximum a posteriori: Gaussian priors on level, slope
and seasonal terms, a Laplace prior of scale ``changepoint_prior_scale`` on the trend changes, most
of which it sets to zero. Histories travel as (ds, y); their features are made where they are fitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import (
    US_HOLIDAYS,
    conditional_seasonality,
    epoch_days,
    fourier_features,
    us_holiday,
)
from tidemark.operators.aggregates import argmin_row, median_daily_iqr
from tidemark.operators.stattests import levene_test
from tidemark.operators.windows import along, freeze_after, last_satisfying_point
from tidemark.schema import SERIES
from tidemark.session import spread

N_CHANGEPOINTS = 25
DAILY_ORDER, WEEKLY_ORDER = 3, 5
DAILY_TERMS = 4 * DAILY_ORDER  # weekday half and weekend half
WEEKLY_TERMS = 2 * WEEKLY_ORDER
TREND_PRIOR_SCALE, HOLIDAY_PRIOR_SCALE = 5.0, 10.0
SIGNIFICANT_DELTA = 0.01
HORIZON_HOURS = 168
OUT_OF_BOUNDS_SHARE = 0.1


# Features


def changepoints(
    df: DataFrame, n: int = N_CHANGEPOINTS, share: float = 0.8, keys: list[str] = SERIES
) -> DataFrame:
    """Changepoints at even row positions in the first ``share`` of each series' history."""
    rows = df.select(
        *keys, "ds",
        (F.row_number().over(along(keys, "ds")) - 1).alias("_i"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"),
    )
    size = F.floor(F.col("_n") * F.lit(share))
    count = F.least(F.lit(n), size - 1)
    at = F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1)).cast("int")),
        lambda j: F.bround(j * (size - 1) / count).cast("int"),
    )
    return (
        rows.filter(F.array_contains(at, F.col("_i")) & (count >= 1))
        .withColumn("j", F.array_position(at, F.col("_i")).cast("int"))
        .select(*keys, "j", F.col("ds").alias("changepoint"))
    )


def trend_features(
    df: DataFrame, n: int = N_CHANGEPOINTS, share: float = 0.8, keys: list[str] = SERIES
) -> DataFrame:
    """Scaled time ``t`` in [0, 1] and the hinge basis max(0, t - s_j) as an array."""
    points = (
        changepoints(df, n, share, keys)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("changepoint")).alias("_s"))
    )
    span = df.groupBy(*keys).agg(F.min("ds").alias("_a"), F.max("ds").alias("_b"))
    lo, hi = epoch_days(F.col("_a")), epoch_days(F.col("_b"))

    def scaled(ds: Column) -> Column:
        return F.try_divide(epoch_days(ds) - lo, hi - lo)

    return (
        df.join(span, keys)
        .join(points, keys, "left")
        .withColumn("t", scaled(F.col("ds")))
        .withColumn(
            "hinges",
            F.transform("_s", lambda s: F.greatest(F.lit(0.0), F.col("t") - scaled(s))),
        )
        .drop("_a", "_b", "_s")
    )


def with_season(df: DataFrame) -> DataFrame:
    """Add the seasonal feature arrays: daily terms for all days and split by weekend.

    Layout of both: daily (weekday half, weekend half), weekly, one indicator per holiday.
    """
    ds = F.col("ds")
    weekly = fourier_features(ds, 7.0, WEEKLY_ORDER)
    holidays = list(us_holiday(ds).values())
    plain = fourier_features(ds, 1.0, DAILY_ORDER)
    zeros = [F.lit(0.0)] * len(plain)
    return df.withColumns(
        {
            "_day": epoch_days(ds),
            "_plain": F.array(*plain, *zeros, *weekly, *holidays),
            "_split": F.array(*conditional_seasonality(ds, DAILY_ORDER), *weekly, *holidays),
        }
    )


# Fit

MODEL_FIELDS = (
    "p_id string, mode string, weekend boolean, t0 double, span double, k double, m double, "
    "cps array<double>, deltas array<double>, beta array<double>"
)


def season_matrices(ds: pd.Series) -> dict[bool, np.ndarray]:
    """The arrays of ``with_season`` as matrices: {False: all days alike, True: split by weekend}."""
    days = ds.to_numpy("datetime64[s]").astype(np.int64) / 86_400.0

    def waves(period: float, order: int) -> np.ndarray:
        angles = np.outer(days, 2.0 * np.pi * np.arange(1, order + 1) / period)
        return np.stack((np.sin(angles), np.cos(angles)), axis=2).reshape(len(days), -1)

    date = ds.dt
    month, day, weekday, year = (x.to_numpy() for x in (date.month, date.day, date.weekday, date.year))
    flags = []
    for name, m, rule in US_HOLIDAYS:
        if isinstance(rule, int):
            hit = (month == m) & (day == rule) & ((name != "juneteenth") | (year >= 2021))
        else:
            which, nth = rule
            week = (day - 1) // 7 == nth - 1 if nth > 0 else day > date.days_in_month.to_numpy() - 7
            hit = (month == m) & (weekday == which) & week
        flags.append(hit.astype(float))
    daily, rest = waves(1.0, DAILY_ORDER), np.column_stack([waves(7.0, WEEKLY_ORDER), *flags])
    work = (weekday < 5).astype(float)[:, None]
    return {
        False: np.hstack([daily, np.zeros_like(daily), rest]),
        True: np.hstack([daily * work, daily * (1.0 - work), rest]),
    }


def sparse_mode(a: np.ndarray, b: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """argmin of c'Ac/2 - b'c + sum(weight * |c|), exactly; zero weights are not penalised.

    An active set with signs: solve for it, stop at the first change of sign that does not improve,
    drop what became zero, and take in the zero whose gradient breaks its bound most."""
    coef, free = start.copy(), weight == 0
    sign = np.sign(coef) * ~free
    cost = lambda c: c @ a @ c / 2 - b @ c + weight @ np.abs(c)
    slack = 1e-9 * max(1.0, np.abs(b).max(initial=0.0))
    while True:
        while True:
            on = np.flatnonzero(free | (sign != 0))
            goal = np.zeros_like(coef)
            goal[on] = np.linalg.solve(a[np.ix_(on, on)], (b - weight * sign)[on])
            flips = np.flatnonzero(~free & (sign != 0) & (np.sign(goal) != sign))
            if not flips.size:
                coef = goal
                break
            # cost is convex along the way; look at every zero crossing and at the goal
            way = goal - coef
            at = np.unique(np.clip(-coef[flips] / np.where(way[flips] == 0, 1.0, way[flips]), 0.0, 1.0))
            tries = [coef + t * way for t in (*at, 1.0)]
            for t, c in zip(at, tries):
                c[flips[np.abs(coef[flips] + t * way[flips]) <= 1e-12 * (1.0 + np.abs(coef[flips]))]] = 0.0
            coef = min(tries, key=cost)
            sign = np.sign(coef) * ~free
        slope = a @ coef - b
        excess = np.where(free | (coef != 0), -np.inf, np.abs(slope) - weight)
        worst = int(np.argmax(excess)) if excess.size else 0
        if not excess.size or excess[worst] <= slack:
            return coef
        sign[worst] = -np.sign(slope[worst])


def _mode(gram: np.ndarray, xy: np.ndarray, yy: float, n: int, var: np.ndarray, weight: np.ndarray):
    """Posterior mode with the noise variance re-estimated a few times.

    ``var``: variances of Gaussian priors (inf: none), ``weight``: inverse scales of Laplace priors."""
    noise = max(yy / n, 1e-8)
    coef = np.zeros(len(xy))
    firm = np.diag(1e-10 * gram.diagonal().max(initial=1.0) * np.ones(len(xy)))
    for _ in range(4):
        coef = sparse_mode(gram + firm + np.diag(noise / var), xy, noise * weight, coef)
        rss = yy - 2 * coef @ xy + coef @ gram @ coef
        noise = max(rss / n, 1e-8)
    return coef


def _fit_rows(days: np.ndarray, y: np.ndarray, seasons: dict[bool, np.ndarray], grid: list[dict]) -> Iterator[dict]:
    """Fit every parameter set on one history in time order; normal matrices are shared."""
    n = len(y)
    if n < 2:
        return
    t0, span = days[0], max(days[-1] - days[0], 1e-9)
    t = (days - t0) / span
    scale = np.abs(y).max() or 1.0
    ys = y / scale
    n_season, n_holiday = seasons[False].shape[1], len(US_HOLIDAYS)
    cache: dict = {}
    for p in grid:
        share = p.get("changepoint_range", 0.8)
        seasonal = p.get("seasonal", True)
        weekend = bool(p.get("weekend", False))
        mode = p.get("seasonality_mode", "additive")
        size = int(np.floor(n * share))
        count = min(N_CHANGEPOINTS, size - 1)
        at = np.round(np.linspace(0, max(size - 1, 0), count + 1)).astype(int)[1:] if count > 0 else []
        cps = t[at] if len(at) else np.zeros(0)
        n_trend = 2 + len(cps)
        trend_var = np.concatenate([np.full(2, TREND_PRIOR_SCALE**2), np.full(len(cps), np.inf)])
        weight = np.concatenate([np.zeros(2), np.full(len(cps), 1.0 / p["changepoint_prior_scale"])])
        season_var = np.concatenate(
            [
                np.full(n_season - n_holiday, p.get("seasonality_prior_scale", 10.0) ** 2),
                np.full(n_holiday, HOLIDAY_PRIOR_SCALE**2),
            ]
        )
        joint = seasonal and mode == "additive"
        key = (share, weekend if joint else None)
        if key not in cache:
            trend = np.column_stack([np.ones(n), t, np.maximum(0.0, t[:, None] - cps)])
            design = np.hstack([trend, seasons[weekend]]) if joint else trend
            cache[key] = trend, design.T @ design, design.T @ ys
        trend, gram, xy = cache[key]
        beta = np.zeros(n_season)
        if joint:
            coef = _mode(gram, xy, ys @ ys, n, np.concatenate([trend_var, season_var]), np.concatenate([weight, np.zeros(n_season)]))
            head, beta = coef[:n_trend], coef[n_trend:] * scale
        else:
            head = _mode(gram, xy, ys @ ys, n, trend_var, weight)
        if seasonal and not joint:
            g = trend @ head
            design, rest = seasons[weekend] * g[:, None], ys - g
            beta = _mode(design.T @ design, design.T @ rest, rest @ rest, n, season_var, np.zeros(n_season))
        yield {
            "p_id": p["p_id"], "mode": mode, "weekend": weekend, "t0": t0, "span": span,
            "k": head[1] * scale, "m": head[0] * scale, "cps": list(cps),
            "deltas": list(head[2:] * scale), "beta": list(beta),
        }


def _value_of(model: dict, days: np.ndarray, seasons: dict[bool, np.ndarray]) -> np.ndarray:
    """yhat of one model, as ``predict_forecaster`` computes it."""
    t = (days - model["t0"]) / model["span"]
    trend = model["m"] + model["k"] * t + np.maximum(0.0, t[:, None] - np.array(model["cps"])) @ np.array(model["deltas"])
    terms = seasons[model["weekend"]] @ model["beta"]
    return trend + terms if model["mode"] == "additive" else trend * (1 + terms)


def _ordered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows with a value in time order, their days and their values."""
    pdf = pdf.dropna(subset=["y"]).sort_values("ds")
    days = pdf["ds"].to_numpy("datetime64[s]").astype(np.int64) / 86_400.0
    return pdf, days, pdf["y"].to_numpy(dtype=float)


MODEL_COLUMNS = [f.strip().split(" ")[0] for f in MODEL_FIELDS.split(",")]


def fit_forecaster(
    history: DataFrame, grid: list[dict], keys: list[str] = SERIES, chosen: DataFrame | None = None
) -> DataFrame:
    """One model row per (key, parameter set) from rows (keys, ds, y).

    A history is bounded by the calendar, so a grouped map per key is safe; the parameter grid
    is looped inside the task, which shares the normal matrices and avoids shipping each
    history once per parameter set. ``chosen`` (keys, p_id), one row per key, fits that set only.
    """
    fields = {f.name: f.dataType.simpleString() for f in history.schema if f.name in keys}
    one_set = chosen is not None

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [p for p in grid if p["p_id"] == pdf["p_id"].iloc[0]] if one_set else grid
        rows, days, y = _ordered(pdf)
        out = pd.DataFrame(list(_fit_rows(days, y, season_matrices(rows["ds"]), sets)), columns=MODEL_COLUMNS)
        for name in reversed(keys):
            out.insert(0, name, pdf[name].iloc[0])
        return out

    schema = ", ".join([f"{k} {fields[k]}" for k in keys] + [MODEL_FIELDS])
    rows = history.select(*keys, "ds", "y")
    if one_set:
        rows = rows.join(chosen.select(*[F.col(k).alias(k) for k in keys], "p_id"), keys)
    return spread(rows, keys).groupBy(*keys).applyInPandas(fit, schema)


def _dot(a: Column, b: Column, start: int, length: int) -> Column:
    return F.aggregate(
        F.zip_with(F.slice(a, start, length), F.slice(b, start, length), lambda x, w: x * w),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def predict_forecaster(times: DataFrame, models: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """yhat and its components for every (key, ds) under every model of the key."""
    x = F.when(F.col("weekend"), F.col("_split")).otherwise(F.col("_plain"))
    t = (F.col("_day") - F.col("t0")) / F.col("span")
    bends = F.aggregate(
        F.zip_with("cps", "deltas", lambda s, d: d * F.greatest(F.lit(0.0), F.col("_t") - s)),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    first_holiday = DAILY_TERMS + WEEKLY_TERMS
    parts = (
        with_season(times)
        .join(models, keys)
        .withColumns({"_t": t, "_x": x})
        .withColumns(
            {
                "trend": F.col("m") + F.col("k") * F.col("_t") + bends,
                "daily": _dot(F.col("_x"), F.col("beta"), 1, DAILY_TERMS),
                "weekly": _dot(F.col("_x"), F.col("beta"), DAILY_TERMS + 1, WEEKLY_TERMS),
                "holidays": _dot(F.col("_x"), F.col("beta"), first_holiday + 1, len(US_HOLIDAYS)),
            }
        )
    )
    terms = F.col("daily") + F.col("weekly") + F.col("holidays")
    additive = F.col("mode") == "additive"
    return (
        parts.withColumn("additive_terms", F.when(additive, terms).otherwise(0.0))
        .withColumn("multiplicative_terms", F.when(additive, 0.0).otherwise(terms))
        .withColumn("yhat", recompose())
        .select(
            *times.columns, "p_id", "mode", "yhat", "trend", "additive_terms",
            "multiplicative_terms", "holidays", "daily", "weekly",
        )
    )


def recompose() -> Column:
    return F.col("trend") * (1 + F.col("multiplicative_terms")) + F.col("additive_terms")


# Time grids


def make_future(history: DataFrame, hours: int = HORIZON_HOURS, keys: list[str] = SERIES) -> DataFrame:
    """The history's timestamps plus the next ``hours`` hours of every series."""
    last = history.groupBy(*keys).agg(F.max("ds").alias("_end"))
    ahead = last.select(
        *keys,
        F.explode(
            F.sequence(
                F.col("_end") + F.expr("INTERVAL 1 HOUR"),
                F.col("_end") + F.make_dt_interval(hours=F.lit(hours)),
                F.expr("INTERVAL 1 HOUR"),
            )
        ).alias("ds"),
    )
    return history.select(*keys, "ds").unionByName(ahead)


def time_spine(spans: DataFrame, step: str = "INTERVAL 5 MINUTES") -> DataFrame:
    """Fixed-step grid over the half-open [start, end) of each row."""
    points = F.sequence(F.col("start"), F.col("end"), F.expr(step))
    rest = [c for c in spans.columns if c not in ("start", "end")]
    return spans.select(
        *rest, F.explode(F.filter(points, lambda p: p < F.col("end"))).alias("ds")
    )


# Cross-validation


def cv_regime(missing_ratio: Column, days: Column) -> Column:
    """(initial, horizon, period) in hours; NULL when the history is too short."""

    def hours(initial: int, horizon: int, period: int) -> Column:
        return F.struct(
            F.lit(initial * 24).alias("initial"),
            F.lit(horizon * 24).alias("horizon"),
            F.lit(period * 24).alias("period"),
        )

    return (
        F.when(missing_ratio < 0.15, hours(16, 2, 2))
        .when((days > 14) & (days < 18), hours(14, 1, 1))
        .when(days > 14, hours(16, 1, 1))
    )


def cv_cutoffs(history: DataFrame, regimes: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Rolling-origin cutoffs: max(ds) - horizon, back by period, to min(ds) + initial.

    ``regimes`` holds initial, horizon and period (hours) per key; NULL yields no cutoff.
    """
    span = history.groupBy(*keys).agg(F.min("ds").alias("_a"), F.max("ds").alias("_b"))
    latest = F.col("_b") - F.make_dt_interval(hours=F.col("horizon"))
    earliest = F.col("_a") + F.make_dt_interval(hours=F.col("initial"))
    steps = F.timestamp_diff("HOUR", earliest, latest)
    back = F.sequence(F.lit(0), F.floor(steps / F.col("period")).cast("int"))
    return (
        span.join(regimes.filter("period IS NOT NULL"), keys)
        .filter(steps >= 0)
        .withColumn("_n", F.explode(back))
        .select(
            *keys,
            (latest - F.make_dt_interval(hours=F.col("_n") * F.col("period"))).alias("cutoff"),
            "horizon",
        )
    )


def cross_validate(
    history: DataFrame, cutoffs: DataFrame, grid: list[dict], keys: list[str] = SERIES
) -> DataFrame:
    """Forecast every (series, cutoff, parameter set) over its horizon -> ds, y, yhat.

    A history meets its cutoffs in one task, travels once as (ds, y) and has its features made once;
    every cutoff fits and forecasts from slices of them.
    """
    kinds = {f.name: f.dataType.simpleString() for f in history.schema if f.name in keys}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    schema += ", cutoff timestamp_ntz, p_id string, ds timestamp_ntz, y double, yhat double"
    names = [*keys, "cutoff", "p_id", "ds", "y", "yhat"]

    def validate(key: tuple, rows: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        rows, days, y = _ordered(rows)
        ds, seasons, parts = rows["ds"].to_numpy(), season_matrices(rows["ds"]), []
        for cutoff, horizon in zip(cuts["cutoff"], cuts["horizon"]):
            a, b = (np.searchsorted(ds, np.datetime64(x), "right") for x in (cutoff, cutoff + pd.Timedelta(hours=horizon)))
            if a == b:
                continue
            known, ahead = ({k: m[s] for k, m in seasons.items()} for s in (slice(a), slice(a, b)))
            for model in _fit_rows(days[:a], y[:a], known, grid):
                parts.append(pd.DataFrame({
                    **dict(zip(keys, key)), "cutoff": cutoff, "p_id": model["p_id"], "ds": ds[a:b],
                    "y": y[a:b], "yhat": _value_of(model, days[a:b], ahead),
                }))
        return pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)

    rows = spread(history.select(*keys, F.col("ds").cast("timestamp_ntz").alias("ds"), F.col("y").cast("double").alias("y")), keys)
    own = [F.col(k).alias(k) for k in keys]  # cutoffs come from the same history: other column ids
    cuts = spread(cutoffs.select(*own, F.col("cutoff").cast("timestamp_ntz").alias("cutoff"), "horizon"), keys)
    return rows.groupBy(*keys).cogroup(cuts.groupBy(*keys)).applyInPandas(validate, schema)


def forecast_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """mse, rmse, mae, mape, mdape, smape; mape is NULL if an actual is (nearly) zero."""
    e = F.col("y") - F.col("yhat")
    ape = F.try_divide(F.abs(e), F.abs(F.col("y")))
    zero = F.max(F.when(F.abs(F.col("y")) < 1e-8, 1).otherwise(0)) == 1
    spread = (F.abs(F.col("y")) + F.abs(F.col("yhat"))) / 2
    return df.filter(F.col("y").isNotNull() & F.col("yhat").isNotNull()).groupBy(*by).agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(~zero, F.avg(ape)).alias("mape"),
        F.when(~zero, F.percentile(ape, F.lit(0.5))).alias("mdape"),
        F.avg(F.coalesce(F.try_divide(F.abs(e), spread), F.lit(0.0))).alias("smape"),
        F.lit(None).cast("double").alias("coverage"),
    )


def select_best_params(metrics: DataFrame, keys: list[str] = SERIES, score: str = "mae") -> DataFrame:
    """The metrics row with the lowest score per series; ties go to the smaller p_id."""
    return argmin_row(metrics, keys, score, "p_id")


# Checks on the future part of a forecast (rows at or after the last known hour ``end``)


def future_shape(
    forecast: DataFrame,
    margin: Column | float = 0.0,
    keys: list[str] = SERIES,
) -> DataFrame:
    """Per series: share of future rows below and above the bounds, and how the trend ends.

    ``forecast`` carries ``end``, ``lower`` and ``upper``. The margin widens the tested value
    downwards for the lower bound and upwards for the upper bound.
    """
    margin = F.lit(float(margin)) if isinstance(margin, (int, float)) else margin
    future = forecast.filter(F.col("ds") >= F.col("end"))
    last_two = F.slice(
        F.reverse(F.sort_array(F.collect_list(F.struct("ds", "trend")))), 1, 2
    )
    return (
        future.groupBy(*keys)
        .agg(
            F.avg(F.when(F.col("yhat") - margin < F.col("lower"), 1.0).otherwise(0.0)).alias("below"),
            F.avg(F.when(F.col("yhat") + margin > F.col("upper"), 1.0).otherwise(0.0)).alias("above"),
            last_two.alias("_l"),
        )
        .select(
            *keys, "below", "above",
            F.try_element_at("_l", F.lit(1))["trend"].alias("last_trend"),
            (
                F.try_element_at("_l", F.lit(1))["trend"] - F.try_element_at("_l", F.lit(2))["trend"]
            ).alias("trend_step"),
        )
    )


def additive_violation(shape: DataFrame, percent: float = OUT_OF_BOUNDS_SHARE) -> Column:
    """Too much of the future leaves a bound and the trend drives it there."""
    down = (shape["below"] > percent) & (shape["trend_step"] < 0)
    up = (shape["above"] > percent) & (shape["trend_step"] > 0)
    return F.coalesce(down | up, F.lit(False))


def trend_violation(forecast: DataFrame, history: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """``additive_violation`` with the median daily IQR as margin, and the margin itself."""
    iqr = median_daily_iqr(
        history.select(*keys, F.col("ds").alias("ts"), F.col("y").alias("value")), keys
    )
    shape = future_shape(forecast.join(iqr, keys), F.col("iqr"), keys)
    return shape.withColumn("violation", additive_violation(shape)).join(iqr, keys)


def multiplicative_reject(
    forecast: DataFrame,
    history: DataFrame,
    keys: list[str] = SERIES,
    percent: float = OUT_OF_BOUNDS_SHARE,
    max_days: int = 5,
) -> DataFrame:
    """Whether the multiplicative fit of each series must be replaced by an additive one.

    Rejected when the trend ends negative, too much of the future is out of bounds, or the
    trend falls while at most ``max_days`` days of history are as quiet as the last full
    forecast day (a smaller sample std, or a variance Levene's test cannot tell apart).
    """
    shape = future_shape(forecast, 0.0, keys)
    day = F.to_date("ds")
    last_day = forecast.groupBy(*keys).agg(F.date_sub(F.max(day), 1).alias("_full"))
    full = (
        forecast.join(last_day, keys)
        .filter(F.to_date("ds") == F.col("_full"))
        .select(*keys, F.col("yhat").alias("value"))
    )
    full_std = full.groupBy(*keys).agg(F.stddev_samp("value").alias("_last_std"))
    days = history.select(*keys, day.alias("day"), F.col("y").alias("value"))
    sizes = days.groupBy(*keys, "day").agg(
        F.count("value").alias("_n"), F.stddev_samp("value").alias("_std")
    ).filter("_n > 20")
    levene = levene_test(
        days.join(sizes.select(*keys, "day"), [*keys, "day"], "left_semi"), full, keys, "day"
    )
    quiet = (
        sizes.join(full_std, keys)
        .join(levene, [*keys, "day"], "left")
        .groupBy(*keys)
        .agg(
            F.count(
                F.when((F.col("_std") < F.col("_last_std")) | (F.col("p") > 0.05), 1)
            ).alias("quiet_days")
        )
    )
    variance = (F.col("trend_step") < 0) & (F.coalesce("quiet_days", F.lit(0)) <= max_days)
    bounds = (
        (F.col("last_trend") < 0) | (F.col("above") > percent) | (F.col("below") > percent)
    )
    return shape.join(quiet, keys, "left").select(
        *keys, "below", "above", "last_trend", "trend_step", "quiet_days",
        F.coalesce(bounds, F.lit(False)).alias("bound_part"),
        F.coalesce(bounds | variance, F.lit(False)).alias("reject"),
    )


# Repair and results


def significant_changepoint(
    models: DataFrame, start: DataFrame, keys: list[str] = SERIES, by: list[str] = ()
) -> DataFrame:
    """Last changepoint with abs(delta) >= 0.01 of the scaled trend, else the window start.

    ``by``: further columns of ``models`` to keep, such as the parameter set.

    Deltas are compared on the scale of the fit (values divided by their largest magnitude).
    """
    pairs = F.filter(
        F.zip_with("cps", "deltas", lambda s, d: F.struct(s.alias("s"), d.alias("d"))),
        lambda p: F.abs(p["d"]) >= SIGNIFICANT_DELTA * F.col("y_scale"),
    )
    last = F.array_max(F.transform(pairs, lambda p: p["s"]))
    seconds = (F.col("t0") + last * F.col("span")) * 86_400
    at = F.timestamp_seconds(F.round(seconds).cast("long")).cast("timestamp_ntz")
    return models.join(start, keys).select(
        *keys, *by, F.coalesce(at, F.col("start")).alias("last_changepoint")
    )


def repair_trend(
    forecast: DataFrame,
    changepoint: DataFrame,
    low: Column,
    high: Column,
    keys: list[str] = SERIES,
) -> DataFrame:
    """Freeze the trend after the last point that keeps trend + [low, high] inside the bounds,
    then recompute yhat. ``forecast`` must hold only the series to repair."""
    inside = (
        (F.col("ds") >= F.col("last_changepoint"))
        & (F.col("trend") + low > F.col("lower"))
        & (F.col("trend") + high < F.col("upper"))
    )
    points = last_satisfying_point(forecast.join(changepoint, keys), keys, inside)
    frozen = freeze_after(forecast, points, keys, "trend")
    return frozen.withColumn("yhat", recompose())


def forecast_results(forecast: DataFrame, history: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Ground truth, prediction, scaled error and the trend- and season-free parts."""
    scale = history.groupBy(*keys).agg(F.stddev_pop("y").alias("_sd"))
    joined = forecast.drop("y").join(history.select(*keys, "ds", "y"), [*keys, "ds"], "left").join(
        scale, keys
    )
    sd = F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    shape = F.col("trend") + F.col("holidays") + F.col("daily")
    return joined.select(
        *keys, "ds",
        F.col("y").alias("ground_truth"),
        F.col("yhat").alias("pred"),
        ((F.col("y") - F.col("yhat")) / sd).alias("error"),
        "trend",
        (F.col("y") - F.col("trend")).alias("gt_wo_trend"),
        (F.col("yhat") - F.col("trend")).alias("pred_wo_trend"),
        (F.col("y") - shape).alias("ground_truth_noise"),
        (F.col("yhat") - shape).alias("pred_noise"),
    )
