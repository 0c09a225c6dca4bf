"""Statistical tests per series; statistics are aggregates, p-values one call per row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from tidemark.functions.special import chi2_sf, f_sf, ks_sf
from tidemark.operators.windows import along, avg_rank, equal_slices, rolling_quantile
from tidemark.schema import SERIES
from tidemark.session import cut

HOURS = 24
K_SLICES = 4
# Row sums of the mismatch table that still count as stationary.
LONE_SLICE_PATTERNS = [[1, 3, 1, 1], [3, 1, 1, 1], [1, 1, 3, 1]]


def welch_statistic(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Welch ANOVA of the 24 hour-of-day groups -> f, df1, df2.

    The correction factor uses (k + 2), as the programs this reproduces do.
    """
    hours = (
        df.filter(F.col("value").isNotNull())
        .groupBy(*keys, F.hour("ts").alias("hour"))
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.var_samp("value").alias("var"),
        )
        # an hour without variance makes the statistic undefined (NaN), as infinite weight does
        .withColumn(
            "w", F.when(F.col("var") == 0, F.lit(float("inf"))).otherwise(F.col("n") / F.col("var"))
        )
    )
    whole = Window.partitionBy(*keys)
    weighed = hours.withColumn("total", F.sum("w").over(whole)).withColumn(
        "centre", F.sum(F.col("w") * F.col("mean")).over(whole) / F.col("total")
    )
    k = F.lit(float(HOURS))
    spread = F.pow(1 - F.col("w") / F.col("total"), F.lit(2.0)) / (F.col("n") - 1)
    stats = weighed.groupBy(*keys).agg(
        (F.sum(F.col("w") * F.pow(F.col("mean") - F.col("centre"), F.lit(2.0))) / (k - 1)).alias("b"),
        F.sum(spread).alias("s"),
    )
    return stats.select(
        *keys,
        (F.col("b") / (1 + 2 * (k + 2) / (k * k - 1) * F.col("s"))).alias("f"),
        (k - 1).alias("df1"),
        F.try_divide(k * k - 1, 3 * F.col("s")).alias("df2"),
    )


def welch_seasonality(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Welch ANOVA with its p-value."""
    return welch_statistic(df, keys).withColumn("p", f_sf("f", "df1", "df2"))


def friedman_statistic(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Friedman statistic: hours are treatments, complete days are blocks, ties corrected."""
    day = [*keys, "day"]
    rows = df.filter(F.col("value").isNotNull()).select(
        *keys, F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "value"
    )
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*day)))
    complete = rows.filter(F.col("_n") == HOURS)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*day, "value"))
    ranked = complete.select(
        *day, "hour", avg_rank("value", day).alias("r"), (ties * ties - 1).alias("tie")
    )
    per_hour = ranked.groupBy(*keys, "hour").agg(
        F.sum("r").alias("R"), F.count(F.lit(1)).alias("n"), F.sum("tie").alias("tie")
    )
    k = float(HOURS)
    n = F.max("n")
    # a group of t ties adds t^3 - t, i.e. t^2 - 1 for each of its t rows
    corr = 1 - F.sum("tie") / (n * F.lit(k * (k * k - 1)))
    raw = 12.0 / (n * F.lit(k * (k + 1))) * F.sum(F.col("R") * F.col("R")) - 3 * n * F.lit(k + 1)
    return per_hour.groupBy(*keys).agg(
        F.try_divide(raw, corr).alias("chi2"), n.alias("n_days")
    )


def friedman_test(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Friedman test with its p-value."""
    return friedman_statistic(df, keys).withColumn("p", chi2_sf("chi2", F.lit(HOURS - 1.0)))


def kruskal_statistic(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Kruskal-Wallis H of the hour groups, ties corrected; H is NULL if all values agree."""
    rows = df.filter(F.col("value").isNotNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, "value"))
    ranked = rows.select(
        *keys, F.hour("ts").alias("hour"),
        avg_rank("value", keys).alias("r"), (ties * ties - 1).cast("double").alias("tie"),
    )
    per_hour = ranked.groupBy(*keys, "hour").agg(
        F.sum("r").alias("R"), F.count(F.lit(1)).cast("double").alias("n"), F.sum("tie").alias("tie")
    )
    n = F.sum("n")
    corr = 1 - F.try_divide(F.sum("tie"), n * n * n - n)
    raw = 12 / (n * (n + 1)) * F.sum(F.col("R") * F.col("R") / F.col("n")) - 3 * (n + 1)
    return per_hour.groupBy(*keys).agg(
        F.try_divide(raw, corr).alias("h"), (F.count(F.lit(1)) - 1.0).alias("df")
    )


def kruskal_wallis(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Kruskal-Wallis test with its p-value."""
    return kruskal_statistic(df, keys).withColumn("p", chi2_sf("h", "df"))


@pandas_udf(ArrayType(DoubleType()))
def _solve_ar(moments: pd.Series) -> pd.Series:
    """AR coefficients [c0, phi1, ...] of the order with the least AIC, from moment sums."""
    out = []
    for flat in moments:
        size = int(np.sqrt(len(flat)))
        g = np.asarray(flat, dtype=float).reshape(size, size)
        n, best, best_aic = g[0, 0], None, np.inf
        for p in range(1, size - 1):
            a, b = g[: p + 1, : p + 1], g[: p + 1, -1]
            coef = np.linalg.lstsq(a, b, rcond=None)[0]
            rss = max(g[-1, -1] - coef @ b, 1e-300)
            aic = n * np.log(rss / n) + 2 * (p + 1)
            if aic < best_aic - 1e-12:
                best, best_aic = coef, aic
        out.append(list(best) if best is not None else None)
    return pd.Series(out)


def ar_residual(df: DataFrame, max_p: int = 3, keys: list[str] = SERIES) -> DataFrame:
    """Residual after an AR(p <= max_p) model chosen by AIC (no moving-average terms).

    Lags come from one window; the normal equations are plain sums per series; only the
    (max_p + 2)-square moment matrix of each series is solved in Python. Values are centred
    first, which keeps the sums well scaled. The first rows, without lags, have no residual.
    """
    w = along(keys)
    rows = df.filter(F.col("value").isNotNull())
    rows = rows.withColumn("_v", F.col("value") - F.avg("value").over(Window.partitionBy(*keys)))
    for j in range(1, max_p + 1):
        rows = rows.withColumn(f"_y{j}", F.lag("_v", j).over(w))
    terms = [F.lit(1.0), *[F.col(f"_y{j}") for j in range(1, max_p + 1)], F.col("_v")]
    usable = rows.filter(F.col(f"_y{max_p}").isNotNull())
    sums = [F.sum(a * b) for a in terms for b in terms]
    fits = (
        usable.groupBy(*keys)
        .agg(F.array(*sums).alias("_m"))
        .select(*keys, _solve_ar("_m").alias("_c"))
    )
    predicted = F.col("_c")[0]
    for j in range(1, max_p + 1):
        predicted = predicted + F.coalesce(
            F.try_element_at("_c", F.lit(j + 1)), F.lit(0.0)
        ) * F.col(f"_y{j}")
    return (
        usable.join(fits, keys)
        .withColumn("residual", F.col("_v") - predicted)
        .select(*df.columns, "residual")
    )


def seasonality_tests(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """p-values of the three tests per series. All-equal values count as p = 0 in H.

    The statistics are joined first, so the p-values are one Python step over one row per
    series.
    """
    stats = (
        welch_statistic(df, keys)
        .join(friedman_statistic(df, keys), keys, "full")
        .join(kruskal_statistic(df, keys), keys, "full")
    )
    return stats.select(
        *keys, "h",
        f_sf("f", "df1", "df2").alias("p_welch"),
        chi2_sf("chi2", F.lit(HOURS - 1.0)).alias("p_friedman"),
        chi2_sf("h", "df").alias("_p_kruskal"),
    ).select(
        *keys, "p_welch", "p_friedman",
        F.when(F.col("h").isNull(), F.lit(0.0)).otherwise(F.col("_p_kruskal")).alias("p_kruskal"),
    )


def seasonality_vote(
    df: DataFrame, alpha: float = 0.001, alpha_r: float = 0.01, keys: list[str] = SERIES
) -> DataFrame:
    """Majority of three tests on the values, plus three on the AR residuals of series
    without NULLs. Both passes share one plan: the source is part of the key."""
    nulls = df.groupBy(*keys).agg(F.count(F.when(F.col("value").isNull(), 1)).alias("_nulls"))
    whole = df.join(nulls.filter("_nulls = 0"), keys, "left_semi")
    residual = ar_residual(whole.select(*keys, "ts", "value"), keys=keys).select(
        *keys, "ts", F.col("residual").alias("value")
    )
    both = (
        df.select(*keys, "ts", "value")
        .withColumn("src", F.lit("value"))
        .unionByName(residual.withColumn("src", F.lit("residual")))
    )
    tests = seasonality_tests(cut(both), [*keys, "src"])  # read by all three tests
    limit = F.when(F.col("src") == "value", alpha).otherwise(alpha_r)
    hits = sum(
        F.when(F.coalesce(F.nanvl(F.col(p), F.lit(1.0)) < limit, F.lit(False)), 1).otherwise(0)
        for p in ("p_welch", "p_friedman", "p_kruskal")
    )
    return (
        tests.groupBy(*keys)
        .agg(F.sum(hits).alias("votes"), (3 * F.count(F.lit(1))).alias("n_tests"))
        .withColumn("is_seasonal", 2 * F.col("votes") >= F.col("n_tests"))
    )


def ks_two_sample(df: DataFrame, keys: list[str], group: str = "slice", k: int = K_SLICES) -> DataFrame:
    """KS statistic and p-value of every pair of the ``k`` groups of each key.

    Values are first reduced to counts per (key, group, value); the ECDF difference is one
    running sum over the union of both samples, read at the last row of equal values.
    """
    counts = df.groupBy(*keys, group, "value").agg(F.count(F.lit(1)).alias("_c"))
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    literal = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    mine = F.filter(literal, lambda p: (p["i"] == F.col(group)) | (p["j"] == F.col(group)))
    sides = counts.withColumn("_p", F.explode(mine)).select(
        *keys, F.col("_p.i").alias("i"), F.col("_p.j").alias("j"), "value",
        F.when(F.col("_p.i") == F.col(group), F.col("_c")).otherwise(0).alias("_a"),
        F.when(F.col("_p.j") == F.col(group), F.col("_c")).otherwise(0).alias("_b"),
    )
    pair = [*keys, "i", "j"]
    merged = sides.groupBy(*pair, "value").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    run = Window.partitionBy(*pair).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*pair)
    steps = merged.select(
        *pair,
        F.sum("_a").over(run).alias("_ca"), F.sum("_b").over(run).alias("_cb"),
        F.sum("_a").over(whole).alias("n1"), F.sum("_b").over(whole).alias("n2"),
    )
    gap = F.abs(
        F.try_divide(F.col("_ca"), F.col("n1")) - F.try_divide(F.col("_cb"), F.col("n2"))
    )
    return (
        steps.groupBy(*pair)
        .agg(F.max(gap).alias("d"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
        .withColumn("p", F.when(F.col("d").isNotNull(), ks_sf("d", "n1", "n2")))
    )


def stationarity(
    df: DataFrame,
    direction: Column | str = "both",
    alpha: float = 0.02,
    ratio: float = 0.4,
    window: int = 48,
    keys: list[str] = SERIES,
) -> DataFrame:
    """Stationary unless the four time slices of the low (or high) rows differ too often.

    ``direction`` picks the tail: ``min`` keeps rows at or below the rolling quantile, ``max``
    rows at or above the mirrored one, ``both`` either; a series is stationary if one of its
    tails is.
    """
    side = F.lit(direction) if isinstance(direction, str) else direction
    w = along(keys)
    rows = (
        df.filter(F.col("value").isNotNull())
        .withColumn("_side", side)
        .withColumn("_lo", rolling_quantile(F.col("value"), w, ratio, window))
        .withColumn("_hi", rolling_quantile(F.col("value"), w, 1 - ratio, window))
    )
    low = (F.col("value") <= F.col("_lo")) & F.col("_side").isin("min", "both")
    high = (F.col("value") >= F.col("_hi")) & F.col("_side").isin("max", "both")
    tails = F.array_compact(F.array(F.when(low, F.lit("min")), F.when(high, F.lit("max"))))
    by_tail = [*keys, "tail"]
    sliced = rows.withColumn("tail", F.explode(tails)).withColumn(
        "slice", equal_slices(K_SLICES, by_tail)
    )
    ks = ks_two_sample(sliced, by_tail).withColumn(
        "_bad", F.when(F.col("p") < alpha, 1).otherwise(0)
    )
    per_slice = [
        F.sum(F.when((F.col("i") == s) | (F.col("j") == s), F.col("_bad")).otherwise(0)).cast("int")
        for s in range(K_SLICES)
    ]
    patterns = F.array(*[F.array(*[F.lit(v) for v in p]) for p in LONE_SLICE_PATTERNS])
    table = ks.groupBy(*by_tail).agg(
        F.array(*per_slice).alias("row_sums"), (2 * F.sum("_bad")).alias("cells")
    )
    moving = (F.col("cells") > 4) & ~F.array_contains(patterns, F.col("row_sums"))
    verdict = table.groupBy(*keys).agg(
        F.bool_or(~moving).alias("is_stationary"), F.sum("cells").alias("mismatch_cells")
    )
    # a series too short for the rolling window has no tail rows to compare
    everyone = df.select(*keys).distinct()
    return everyone.join(verdict, keys, "left").select(
        *keys,
        F.coalesce("is_stationary", F.lit(False)).alias("is_stationary"),
        F.coalesce("mismatch_cells", F.lit(0)).alias("mismatch_cells"),
    )


def acf_max_diff(df: DataFrame, lo: int = 10, hi: int = 24, keys: list[str] = SERIES) -> DataFrame:
    """Largest difference between autocorrelations at lags lo..hi."""
    w = along(keys)
    rows = df.filter(F.col("value").isNotNull()).withColumn(
        "_c", F.col("value") - F.avg("value").over(Window.partitionBy(*keys))
    )
    lags = range(lo, hi + 1)
    products = rows.select(
        *keys, (F.col("_c") * F.col("_c")).alias("_0"),
        *[(F.col("_c") * F.lag("_c", k).over(w)).alias(f"_{k}") for k in lags],
    )
    sums = products.groupBy(*keys).agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in (0, *lags)])
    acf = [F.try_divide(F.coalesce(F.col(f"_{k}"), F.lit(0.0)), F.col("_0")) for k in lags]
    return sums.select(*keys, (F.greatest(*acf) - F.least(*acf)).alias("acf_max_diff"))


def levene_test(
    df: DataFrame, other: DataFrame, keys: list[str], group: str, value: str = "value"
) -> DataFrame:
    """Brown-Forsythe test of each group of ``df`` against the one sample of ``other``."""

    def deviations(frame: DataFrame, by: list[str], tag: str) -> DataFrame:
        mid = frame.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("_mid"))
        z = frame.join(mid, by).withColumn("_z", F.abs(F.col(value) - F.col("_mid")))
        return z.groupBy(*by).agg(
            F.count("_z").cast("double").alias(f"n{tag}"),
            F.avg("_z").alias(f"m{tag}"),
            F.coalesce(F.var_pop("_z") * F.count("_z"), F.lit(0.0)).alias(f"s{tag}"),
        )

    pair = deviations(df, [*keys, group], "1").join(deviations(other, keys, "2"), keys)
    n1, n2, m1, m2 = (F.col(c) for c in ("n1", "n2", "m1", "m2"))
    n = n1 + n2
    mean = (n1 * m1 + n2 * m2) / n
    between = n1 * F.pow(m1 - mean, F.lit(2.0)) + n2 * F.pow(m2 - mean, F.lit(2.0))
    stat = F.try_divide((n - 2) * between, F.col("s1") + F.col("s2"))
    return (
        pair.select(*keys, group, stat.alias("w"), (n - 2).alias("df2"))
        .withColumn("p", f_sf("w", F.lit(1.0), "df2"))
        .drop("df2")
    )
