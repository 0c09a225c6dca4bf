"""Tune-and-forecast plans for seasonal and trend series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip
from tidemark.operators import forecast as fc
from tidemark.operators.reshape import union_all
from tidemark.schema import SERIES
from tidemark.session import cut

# Hyper-parameter grids.
TREND_GRID = [
    {
        "p_id": f"cps={cps:g} range={share:g}",
        "changepoint_prior_scale": cps,
        "changepoint_range": share,
    }
    for cps in (0.01, 0.1, 1.0)
    for share in (0.8, 0.9, 0.95)
]
SEASONAL_GRID = [
    {
        "p_id": f"cps={cps:g} sps={sps:g} {mode} weekend={weekend}",
        "changepoint_prior_scale": cps,
        "seasonality_prior_scale": sps,
        "seasonality_mode": mode,
        "weekend": weekend,
    }
    for cps in (0.01, 0.1, 1.0)
    for sps in (0.1, 1.0, 10.0, 50.0)
    for mode in ("additive", "multiplicative")
    for weekend in (True, False)
]
# The trend variant fits no seasonality.
TREND_FIT_GRID = [{**p, "seasonal": False} for p in TREND_GRID]


def regimes(history: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Cross-validation regime of every series from its length and missing ratio."""
    span = history.groupBy(*keys).agg(
        F.min("ds").alias("_a"), F.max("ds").alias("_b"), F.count("y").alias("_n")
    )
    days = F.timestamp_diff("DAY", F.col("_a"), F.col("_b"))
    missing = 1 - F.col("_n") / F.lit(28 * 24)
    return span.select(*keys, fc.cv_regime(missing, days).alias("_r")).select(*keys, "_r.*")


def tune(history: DataFrame, grid: list[dict], keys: list[str] = SERIES) -> DataFrame:
    """Cross-validated metrics per (series, parameter set)."""
    cutoffs = fc.cv_cutoffs(history, regimes(history, keys), keys)
    return fc.forecast_metrics(fc.cross_validate(history, cutoffs, grid, keys), [*keys, "p_id"])


def best_models(
    history: DataFrame, metrics: DataFrame, grid: list[dict], keys: list[str] = SERIES
) -> DataFrame:
    """Models of the best parameter set per series, fitted on the whole history."""
    best = fc.select_best_params(metrics, keys).select(*keys, "p_id")
    return fc.fit_forecaster(history, grid, keys, chosen=best)


def with_context(forecast: DataFrame, history: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the last known hour, the bounds and the scale of the fit to a forecast."""
    end = history.groupBy(*keys).agg(F.max("ds").alias("end"))
    return forecast.join(end, keys).join(
        F.broadcast(rules.select("kpi", "lower", "upper")), "kpi"
    )


def changepoint_of(
    models: DataFrame, history: DataFrame, keys: list[str], by: list[str] = ()
) -> DataFrame:
    span = history.groupBy(*keys).agg(
        F.min("ds").alias("start"), F.max(F.abs("y")).alias("y_scale")
    )
    return fc.significant_changepoint(
        models.join(span.select(*keys, "y_scale"), keys), span.select(*keys, "start"), keys, by
    )


def repaired(
    forecast: DataFrame, flagged: DataFrame, changepoint: DataFrame, low: Column, high: Column,
    keys: list[str],
) -> DataFrame:
    """Repair the flagged series, keep the others, clip everything to the bounds."""
    broken = flagged.filter("violation").drop("violation")
    fixed = fc.repair_trend(forecast.join(broken, keys), changepoint, low, high, keys)
    whole = union_all(
        fixed.select(*forecast.columns),
        forecast.join(broken.select(*keys), keys, "left_anti").select(*forecast.columns),
    )
    return whole.withColumn("yhat", clip(F.col("yhat"), F.col("lower"), F.col("upper")))


def forecast_trend(
    history: DataFrame, metrics: DataFrame, rules: DataFrame, alpha: float = 1.0,
    keys: list[str] = SERIES,
) -> DataFrame:
    """Best trend model per series, predicted a week ahead, repaired, clipped and scored."""
    models = cut(best_models(history, metrics, TREND_FIT_GRID, keys))
    forecast = cut(
        with_context(
            fc.predict_forecaster(fc.make_future(history, keys=keys), models, keys),
            history, rules, keys,
        )
    )
    checked = fc.trend_violation(forecast, history, keys).select(*keys, "violation", "iqr")
    done = repaired(
        forecast, checked, changepoint_of(models, history, keys),
        -alpha * F.col("iqr"), alpha * F.col("iqr"), keys,
    )
    return fc.forecast_results(done, history, keys)


def forecast_seasonal(
    history: DataFrame, metrics: DataFrame, rules: DataFrame, keys: list[str] = SERIES
) -> DataFrame:
    """Best seasonal model per series; a rejected multiplicative fit falls back to the best
    additive one; out-of-bounds additive trends are frozen; then clipped and scored."""
    metrics = cut(metrics)
    best = fc.select_best_params(metrics, keys).select(*keys, "p_id")
    future = fc.make_future(history, keys=keys)
    first = cut(fc.fit_forecaster(history, SEASONAL_GRID, keys, chosen=best))
    first_forecast = cut(
        with_context(fc.predict_forecaster(future, first, keys), history, rules, keys)
    )
    multiplicative = first_forecast.filter("mode = 'multiplicative'")
    rejected = fc.multiplicative_reject(multiplicative, history, keys).filter("reject")
    additive_ids = [p["p_id"] for p in SEASONAL_GRID if p["seasonality_mode"] == "additive"]
    fallback = fc.select_best_params(
        metrics.filter(F.col("p_id").isin(additive_ids)).join(
            rejected.select(*keys), keys, "left_semi"
        ),
        keys,
    ).select(*keys, "p_id")
    chosen = cut(
        union_all(best.join(rejected.select(*keys), keys, "left_anti"), fallback)
    )
    again = history.join(rejected.select(*keys), keys, "left_semi")
    refitted = fc.fit_forecaster(again, SEASONAL_GRID, keys, chosen=chosen)
    final_models = cut(union_all(first.join(rejected.select(*keys), keys, "left_anti"), refitted))
    second = fc.predict_forecaster(
        future.join(rejected.select(*keys), keys, "left_semi"), final_models, keys
    )
    forecast = cut(
        union_all(
            first_forecast.join(rejected.select(*keys), keys, "left_anti"),
            with_context(second, history, rules, keys),
        )
    )
    shape = fc.future_shape(forecast, 0.0, keys)
    terms = (
        forecast.filter(F.col("ds") >= F.col("end"))
        .groupBy(*keys)
        .agg(
            F.percentile("additive_terms", F.lit(0.05)).alias("_low"),
            F.percentile("additive_terms", F.lit(0.95)).alias("_high"),
            F.first("mode").alias("_mode"),
        )
    )
    checked = (
        shape.withColumn("violation", fc.additive_violation(shape))
        .join(terms, keys)
        .select(
            *keys, (F.col("violation") & (F.col("_mode") == "additive")).alias("violation"),
            "_low", "_high",
        )
    )
    done = repaired(
        forecast, checked, changepoint_of(final_models, history, keys),
        F.col("_low"), F.col("_high"), keys,
    )
    return fc.forecast_results(done, history, keys)
