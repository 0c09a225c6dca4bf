"""Aggregations over the long KPI table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import exact_quantiles, value_ranks
from tidemark.schema import SERIES


def missing_ratio(
    df: DataFrame, start: Column, last_week: Column, end: Column, keys: list[str] = SERIES
) -> DataFrame:
    """Share of missing hours in the four-week window and in its last week."""
    seen = F.col("value").isNotNull() & (F.col("ts") >= start) & (F.col("ts") < end)
    recent = seen & (F.col("ts") >= last_week)
    return df.groupBy(*keys).agg(
        (1 - F.count(F.when(seen, 1)) / F.lit(4 * 7 * 24)).alias("missing_data_ratio_all"),
        (1 - F.count(F.when(recent, 1)) / F.lit(7 * 24)).alias("missing_data_ratio_last_week"),
    )


def mean_std(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )


def series_quantiles(df: DataFrame, probs: dict[str, float], keys: list[str] = SERIES) -> DataFrame:
    """Exact quantiles inside a series (bounded by the calendar) in one aggregate."""
    ordered = list(probs)
    picked = F.percentile("value", F.array(*[F.lit(float(probs[p])) for p in ordered]))
    return df.groupBy(*keys).agg(picked.alias("_q")).select(
        *keys, *[F.col("_q")[i].alias(p) for i, p in enumerate(ordered)]
    )


def median_daily_iqr(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Difference of the daily quartiles, then the median over days."""
    daily = df.groupBy(*keys, F.to_date("ts").alias("day")).agg(
        (F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))).alias("iqr")
    )
    return daily.groupBy(*keys).agg(F.percentile("iqr", F.lit(0.5)).alias("iqr"))


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per column.

    The columns are melted so that every column is one key of the distributed quantile;
    no column is ever sorted in one task.
    """
    melted = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "variable", "value"
    )
    moments = melted.groupBy("variable").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(
        melted, ["variable"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    )
    return moments.join(quartiles, "variable")


def majority_label(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Most frequent label; ties go to the smaller label."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(
        F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label))).alias(label),
        F.max("n").alias("n"),
    )


def valid_span_trim(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Rows between the first and the last non-null value of each series."""
    known = F.when(F.col("value").isNotNull(), F.col("ts"))
    span = df.groupBy(*keys).agg(F.min(known).alias("_a"), F.max(known).alias("_b"))
    return (
        df.join(span, keys).filter(F.col("ts").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    )


def envelope_by_time(
    df: DataFrame, keys: list[str], time: str, value: str, is_main: Column
) -> DataFrame:
    """Per-time extreme of the main rows on the side that faces the other rows."""
    sides = df.groupBy(*keys).agg(
        F.avg(F.when(is_main, F.col(value))).alias("main_mean"),
        F.avg(F.when(~is_main, F.col(value))).alias("other_mean"),
    )
    edges = (
        df.filter(is_main)
        .groupBy(*keys, time)
        .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    )
    lower_side = F.coalesce(F.col("main_mean") > F.col("other_mean"), F.lit(False))
    return edges.join(sides, keys).select(
        *keys,
        time,
        F.when(lower_side, F.col("_lo")).otherwise(F.col("_hi")).alias("envelope"),
        lower_side.alias("outliers_below"),
    )


def tie_correction(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """1 - sum(t^3 - t) / (n^3 - n) over groups of equal values."""
    ties = df.groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("t"))
    n = F.sum("t")
    return ties.groupBy(*keys).agg(
        (1 - F.try_divide(F.sum(F.pow("t", F.lit(3)) - F.col("t")), n * n * n - n)).alias(
            "tie_correction"
        )
    )


def argmin_row(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The whole row with the smallest score; ties go to the smaller ``tie``."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(score, tie)).alias("_row"))
        .select(*keys, "_row.*")
    )


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by the rank formula, ties counted half.

    Scores are reduced to distinct values first; ranks come from the sliced cumulative sum.
    """
    from tidemark.operators.ranking import cumulative

    counts = df.groupBy(score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
    )
    ranked = cumulative(counts, [], score, ["neg", "pos"])
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return ranked.agg(
        F.try_divide(won, F.max("neg_total") * F.max("pos_total")).alias("auc")
    )


__all__ = [
    "argmin_row",
    "auc",
    "describe_numeric",
    "envelope_by_time",
    "majority_label",
    "mean_std",
    "median_daily_iqr",
    "missing_ratio",
    "series_quantiles",
    "tie_correction",
    "valid_span_trim",
    "value_ranks",
]
