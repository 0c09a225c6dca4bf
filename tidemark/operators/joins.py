"""Joins between series, forecasts, histories and parameter grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import SERIES


def align_left(forecast: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """Every forecast row with its ground truth where there is one."""
    return forecast.join(actual, on, "left")


def residual_join(
    actual: DataFrame, forecast: DataFrame, on: list[str], y: str = "y", yhat: str = "yhat"
) -> DataFrame:
    """residual = y - yhat, matched on key and timestamp."""
    return actual.join(forecast, on).withColumn("residual", F.col(y) - F.col(yhat))


def semi_join(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def anti_join(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def split_past_future(
    forecast: DataFrame, history: DataFrame, on: list[str]
) -> tuple[DataFrame, DataFrame]:
    return semi_join(forecast, history, on), anti_join(forecast, history, on)


def param_product(series: DataFrame, grid: list[dict]) -> DataFrame:
    """Every series with every parameter set.

    The grid is a fixed literal of the program, so it rides along as an array column and is
    exploded in place: no join at all, and nothing to broadcast.
    """
    names = list(grid[0])
    literal = F.array(
        *[F.struct(*[F.lit(row[c]).alias(c) for c in names]) for row in grid]
    )
    return series.withColumn("_p", F.explode(literal)).select(
        *series.columns, *[F.col(f"_p.{c}").alias(c) for c in names]
    )


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Attach a one-row frame to every row (its size is one by construction)."""
    return df.crossJoin(F.broadcast(scalar))


def trailing_window(df: DataFrame, days: int = 7, ts: str = "ts") -> DataFrame:
    """Rows within ``days`` of the newest row."""
    newest = df.agg(F.max(ts).alias("_newest"))
    keep: Column = F.col(ts) >= F.col("_newest") - F.make_dt_interval(F.lit(days))
    return with_scalar(df, newest).filter(keep).drop("_newest")


__all__ = [
    "SERIES",
    "align_left",
    "anti_join",
    "param_product",
    "residual_join",
    "semi_join",
    "split_past_future",
    "trailing_window",
    "with_scalar",
]
