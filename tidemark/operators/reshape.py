"""Reshaping between wide, long, grid and matrix layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import SERIES

HOUR = "INTERVAL 1 HOUR"


def wide_to_long(df: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    """Melt measure columns into (variable, value) without a shuffle."""
    return df.unpivot(ids, measures, "variable", "value")


def long_to_time_matrix(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """One row per series with its time-ordered values as an array."""
    return df.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("ts", "value"))), lambda p: p["value"]
        ).alias("values")
    )


def hour_by_day_pivot(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Calendar day x 24-hour matrix per series; the column set is fixed, so no pre-scan is needed."""
    hours = list(range(24))
    days = (
        df.withColumn("_hour", F.hour("ts"))
        .groupBy(*keys, F.to_date("ts").alias("day"))
        .pivot("_hour", hours)
        .agg(F.first("value"))
    )
    return days.select(*keys, "day", *[F.col(f"`{h}`").alias(f"h{h:02d}") for h in hours])


def hourly_grid(
    df: DataFrame,
    keys: list[str] = SERIES,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Regular hourly spine per series, with NULL for missing hours.

    Without bounds the spine runs from the first to the last row of each series.
    """
    span = df.groupBy(*keys).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    lo = F.col("_lo") if start is None else start
    hi = F.col("_hi") if end is None else end
    spine = span.select(*keys, F.explode(F.sequence(lo, hi, F.expr(HOUR))).alias("ts"))
    return spine.join(df, [*keys, "ts"], "left")


def dedupe(df: DataFrame, keys: list[str], order: list[Column], keep: str = "last") -> DataFrame:
    """One row per key: the first or last in ``order``.

    Written as a struct min/max aggregate, not a window: it combines map-side, so a key with
    very many copies never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    pick = F.max_by if keep == "last" else F.min_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), rank).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def forecast_matrix(df: DataFrame, columns: list[str], value: str = "value") -> DataFrame:
    """One row per hour, one column per listed dimension value.

    The caller names the columns: a wide result only makes sense for a bounded set.
    """
    return df.groupBy("ts").pivot("dim_key", columns).agg(F.first(value))


def row_index(keys: list[str], order: str = "ts") -> Column:
    """0-based position inside a series."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
