"""Hour-of-week baseline forecast: deterministic and a pure aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import SERIES


def seasonal_profile(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Mean value per (series, weekday, hour)."""
    return df.groupBy(*keys, F.weekday("ts").alias("dow"), F.hour("ts").alias("hour")).agg(
        F.avg("value").alias("yhat")
    )


def apply_profile(times: DataFrame, profile: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Forecast the given timestamps from the profile."""
    return (
        times.withColumn("dow", F.weekday("ts"))
        .withColumn("hour", F.hour("ts"))
        .join(profile, [*keys, "dow", "hour"])
        .drop("dow", "hour")
    )
