"""Train-and-score plans for residual anomaly detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.anomaly import standard_scale, zscore_fit, zscore_predict
from tidemark.operators.baseline import apply_profile, seasonal_profile
from tidemark.operators.joins import residual_join
from tidemark.operators.reshape import hourly_grid
from tidemark.schema import SERIES


def residual_anomalies(
    kpi_long: DataFrame, threshold: Column | float = 3.0, keys: list[str] = SERIES
) -> DataFrame:
    """Grid -> hour-of-week baseline -> residual -> z-score, for every hour of the grid.

    Profile and z parameters are both partitioned by the series key, so one exchange on the
    key serves the whole chain.
    """
    spine = hourly_grid(kpi_long, keys)
    fitted = apply_profile(spine, seasonal_profile(kpi_long, keys), keys)
    residual = fitted.filter(F.col("value").isNotNull()).withColumn(
        "residual", F.col("value") - F.col("yhat")
    )
    return zscore_predict(residual, zscore_fit(residual, keys), keys, threshold=threshold)


def train_ad(kpi_long: DataFrame, horizon_hours: int = 168, keys: list[str] = SERIES) -> dict:
    """Scale, forecast history and the next week, take residuals, fit thresholds.

    Returns the lazy frames ``scaler``, ``forecast`` and ``zparams``.
    """
    scaler = kpi_long.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    scaled = standard_scale(kpi_long, ["value"], keys)
    profile = seasonal_profile(scaled, keys)
    last = scaled.groupBy(*keys).agg(F.max("ts").alias("_last"), F.min("ts").alias("_first"))
    times = last.select(
        *keys,
        F.explode(
            F.sequence(
                F.col("_first"),
                F.col("_last") + F.make_dt_interval(hours=F.lit(horizon_hours)),
                F.expr("INTERVAL 1 HOUR"),
            )
        ).alias("ts"),
    )
    forecast = apply_profile(times, profile, keys)
    residual = residual_join(scaled, forecast, [*keys, "ts"], y="value")
    return {"scaler": scaler, "forecast": forecast, "zparams": zscore_fit(residual, keys)}


def score_ad(
    incoming: DataFrame, model: dict, threshold: Column | float = 3.0, keys: list[str] = SERIES
) -> DataFrame:
    """Scale incoming rows, match the forecast on time, return the offending input rows."""
    std = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    scaled = (
        incoming.join(model["scaler"], keys)
        .withColumn("_scaled", (F.col("value") - F.col("mean")) / std)
        .drop("mean", "std")
    )
    residual = residual_join(scaled, model["forecast"], [*keys, "ts"], y="_scaled")
    scored = zscore_predict(residual, model["zparams"], keys, threshold=threshold)
    return scored.filter("is_anomaly").select(*incoming.columns, "z")
