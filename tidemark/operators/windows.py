"""Window operators along one series (a bounded group, see ``schema.SERIES``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.schema import SERIES


def along(keys: list[str] = SERIES, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def lag_diff(value: Column, w: WindowSpec) -> Column:
    return value - F.lag(value).over(w)


def gap_hours(ts: Column, w: WindowSpec) -> Column:
    """Hours since the previous row."""
    seconds = F.unix_timestamp(ts.cast("timestamp"))
    return (seconds - F.lag(seconds).over(w)) / 3600.0


def lead_shift(value: Column, w: WindowSpec, window: int = 7) -> Column:
    """Move a trailing statistic back by half its window, which centres it."""
    return F.lead(value, window // 2).over(w)


def rolling_mean(value: Column, w: WindowSpec, window: int = 7) -> Column:
    """Centred mean over ``window`` rows; NULL unless all are present."""
    half = window // 2
    frame = w.rowsBetween(-half, window - 1 - half)
    return F.when(F.count(value).over(frame) == window, F.avg(value).over(frame))


def rolling_triangular_mean(value: Column, w: WindowSpec) -> Column:
    """Trailing 4-row mean with triangular weights .25 .75 .75 .25, divided by their sum."""
    weighted = (
        0.25 * F.lag(value, 3).over(w)
        + 0.75 * F.lag(value, 2).over(w)
        + 0.75 * F.lag(value, 1).over(w)
        + 0.25 * value
    )
    return weighted / 2.0


def rolling_quantile(value: Column, w: WindowSpec, q: float, window: int = 48) -> Column:
    """Centred quantile over rows -window/2 .. window/2 - 1; NULL at the edges."""
    frame = w.rowsBetween(-(window // 2), window // 2 - 1)
    return F.when(
        F.count(value).over(frame) == window, F.percentile(value, F.lit(q)).over(frame)
    )


def avg_rank(value: str, keys: list[str] = SERIES) -> Column:
    """Rank with ties averaged."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def equal_slices(k: int, keys: list[str] = SERIES, order: str = "ts") -> Column:
    """0-based slice number with bounds floor(i * n / k)."""
    i = F.row_number().over(along(keys, order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    # slice s holds floor(s*n/k) <= i < floor((s+1)*n/k), i.e. s = ceil((i+1)*k/n) - 1
    return (F.ceil((i + 1) * k / n) - 1).cast("int")


def last_satisfying_point(
    df: DataFrame, keys: list[str], condition: Column, ts: str = "ds"
) -> DataFrame:
    """Latest timestamp that satisfies the condition; NULL if none does."""
    return df.groupBy(*keys).agg(F.max(F.when(condition, F.col(ts))).alias("last_point"))


def freeze_after(df: DataFrame, points: DataFrame, keys: list[str], value: str, ts: str = "ds"):
    """Hold ``value`` at ``last_point`` for all later rows; no point leaves the series as is."""
    held = (
        df.join(points, keys)
        .filter(F.col(ts) == F.col("last_point"))
        .select(*keys, "last_point", F.col(value).alias("_held"))
    )
    return (
        df.join(held, keys, "left")
        .withColumn(
            value,
            F.when(F.col(ts) > F.col("last_point"), F.col("_held")).otherwise(F.col(value)),
        )
        .drop("_held", "last_point")
    )


def sort_curve(df: DataFrame, keys: list[str], value: str = "value", tie: str = "ts") -> DataFrame:
    """Values in ascending order with their 1-based rank."""
    w = Window.partitionBy(*keys).orderBy(value, tie)
    return df.withColumn("rank", F.row_number().over(w))


def top1_by_rank(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(score), tie)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
