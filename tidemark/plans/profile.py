"""The metadata store: one profile row per series, and the model class it is routed to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import quality, stattests
from tidemark.operators.joins import with_scalar
from tidemark.operators.reshape import hourly_grid
from tidemark.schema import SERIES
from tidemark.session import cut


def windowed(kpi_long: DataFrame) -> DataFrame:
    """Rows inside the four-week window that closes at the newest row's Monday."""
    newest = kpi_long.agg(F.max("ts").alias("_newest"))
    window = scalar.analysis_window(scalar.ts_to_epoch(F.col("_newest")))
    bounds = newest.select(*[c.alias(f"_{n}") for n, c in window.items()])
    return with_scalar(kpi_long, bounds).filter(
        (F.col("ts") >= F.col("_window_start")) & (F.col("ts") < F.col("_window_end"))
    )


def quality_columns(kpi_long: DataFrame, rules: DataFrame) -> DataFrame:
    """Missing ratios and the early model classes, in one aggregate per series.

    KPIs without a rule are skipped. ``rules`` is the fixed rule table, hence the broadcast.
    """
    recent = F.col("ts") >= F.col("_last_week_start")
    stats = (
        windowed(kpi_long)
        .groupBy(*SERIES)
        .agg(
            (1 - F.count("value") / F.lit(28 * 24)).alias("missing_data_ratio_all"),
            (1 - F.count(F.when(recent, F.col("value"))) / F.lit(7 * 24)).alias(
                "missing_data_ratio_last_week"
            ),
            F.percentile("value", F.array(F.lit(0.49), F.lit(0.51))).alias("_q"),
            F.stddev_samp("value").alias("_std"),
            F.first("_window_end").alias("ts"),
        )
        .join(F.broadcast(rules), "kpi")
    )
    constant = quality.flag_constant(
        F.col("_q")[0], F.col("_q")[1], F.col("_std"), F.col("lower"), F.col("upper")
    )
    early = F.when(
        quality.flag_bad_quality(F.col("missing_data_ratio_all")), "bad_quality_data"
    ).when(constant, "constant")
    return stats.select(
        *SERIES, "ts", "missing_data_ratio_all", "missing_data_ratio_last_week",
        "bad_direction", early.alias("model_type"),
    )


def series_profile(kpi_long: DataFrame, rules: DataFrame, path: str) -> DataFrame:
    """Profile every series and route it.

    Quality flags first; the surviving series are trimmed, gridded and interpolated; then the
    seasonality vote, and stationarity for those without seasonality. All steps are keyed by
    series; the cleaned rows are cut once because both tests read them several times.
    """
    flags = quality_columns(kpi_long, rules)
    good = flags.filter("model_type IS NULL").select(*SERIES, "bad_direction")
    rows = windowed(kpi_long).select(*SERIES, "ts", "value").join(good, SERIES, "left_semi")
    trims = quality.trim_gappy_edges(rows)
    kept = rows.join(trims, SERIES).filter(
        F.col("ts").between(F.col("new_start"), F.col("new_end"))
    )
    gridded = hourly_grid(kept.select(*SERIES, "ts", "value"))
    # the plan below reads these rows about ten times
    clean = cut(
        quality.interpolate(
            gridded.withColumn("_raw", F.col("value")), "pchip"
        )
    )
    imputed = clean.groupBy(*SERIES).agg(
        (F.count(F.when(F.col("_raw").isNull(), 1)) > 0).alias("missing_data_imputation_flag")
    )
    votes = stattests.seasonality_vote(clean.select(*SERIES, "ts", "value")).select(
        *SERIES, F.col("is_seasonal").alias("seasonality_flag")
    )
    observed = clean.select(*SERIES, "ts", F.col("_raw").alias("value")).filter("value IS NOT NULL")
    directed = observed.join(good, SERIES)
    steady = stattests.stationarity(
        directed, F.coalesce(F.col("bad_direction"), F.lit("both"))
    ).select(*SERIES, "is_stationary")
    full = (
        flags.join(trims.select(*SERIES, F.col("changed").alias("nan_trimming_flag")), SERIES, "left")
        .join(imputed, SERIES, "left")
        .join(votes, SERIES, "left")
        .join(steady, SERIES, "left")
    )
    model = quality.route_model(
        F.coalesce(F.col("model_type") == "bad_quality_data", F.lit(False)),
        F.coalesce(F.col("model_type") == "constant", F.lit(False)),
        F.col("seasonality_flag"),
        F.col("is_stationary"),
    )
    return full.select(
        "ts",
        F.lit(path).alias("path"),
        F.col("dim_key").alias("dimension_name"),
        F.col("kpi").alias("kpi_name"),
        "missing_data_ratio_all",
        "missing_data_ratio_last_week",
        "seasonality_flag",
        F.when(~F.col("seasonality_flag"), F.col("is_stationary")).alias("stationarity_flag"),
        "missing_data_imputation_flag",
        F.concat_ws("_", F.lit(path), F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("table"),
        "nan_trimming_flag",
        model.alias("model_type"),
    )
