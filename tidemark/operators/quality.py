"""Gaps, elbows, imputation and smoothing of each series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.geometry import rotate_2d
from tidemark.operators.windows import along, gap_hours, rolling_triangular_mean
from tidemark.schema import SERIES
from tidemark.session import spread

MAX_MISSING_RATIO = 0.35
TWO_WEEKS_HOURS = 14 * 24


def known(df: DataFrame) -> DataFrame:
    return df.filter(F.col("value").isNotNull())


def gap_profile(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Gaps between consecutive known hours: count, largest, and whether all are <= 2 h."""
    gaps = known(df).withColumn("_gap", gap_hours(F.col("ts"), along(keys)))
    return gaps.groupBy(*keys).agg(
        F.count("_gap").alias("n_gaps"),
        F.max("_gap").alias("max_gap_hours"),
        F.coalesce(F.max("_gap") <= 2, F.lit(True)).alias("dense"),
    )


def chord_rotation(
    df: DataFrame, keys: list[str], x: str, y: str, scale: bool = True
) -> DataFrame:
    """Rotate each curve so that its first-to-last chord is flat; adds ``rotated``.

    Only per-key extremes are aggregated and joined back, so curves of any length work.
    """
    ends = df.groupBy(*keys).agg(
        F.min(x).alias("_x0"), F.max(x).alias("_x1"),
        F.min(y).alias("_ylo"), F.max(y).alias("_yhi"),
        F.min_by(y, x).alias("_y0"), F.max_by(y, x).alias("_y1"),
    )
    joined = df.join(ends, keys)
    wide, tall = F.col("_x1") - F.col("_x0"), F.col("_yhi") - F.col("_ylo")
    sx = F.when(wide == 0, 1.0).otherwise(wide) if scale else F.lit(1.0)
    sy = F.when(tall == 0, 1.0).otherwise(tall) if scale else F.lit(1.0)
    theta = F.atan2((F.col("_y1") - F.col("_y0")) / sy, wide / sx)
    _, up = rotate_2d(
        (F.col(x) - F.col("_x0")) / sx, (F.col(y) - F.col("_ylo")) / sy, theta
    )
    return joined.select(*df.columns, up.alias("rotated"))


def elbow_point(
    df: DataFrame, keys: list[str], x: str, y: str, scale: bool = True, knee: bool = False
) -> DataFrame:
    """The curve's row farthest below (elbow) or above (knee) its chord; ties: smaller x."""
    rest = [c for c in df.columns if c not in keys]
    up = F.round("rotated", 9)
    order = F.struct(-up if knee else up, F.col(x))
    return (
        chord_rotation(df, keys, x, y, scale)
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("_row"))
        .select(*keys, "_row.*")
    )


def trim_gappy_edges(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Cut a gappy start or end: (changed, new_start, new_end) per series.

    The gap curve is smoothed with the 4-row triangular mean in time order; its elbow is the
    cut. The start is cut when more than two weeks remain after it, else the end is cut when
    more than two weeks precede it. Series without a gap over two hours stay whole.
    """
    w = along(keys)
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    gaps = known(df).select(
        *keys, "ts", ((F.lead(seconds).over(w) - seconds) / 3600.0).alias("gap")
    )
    span = gaps.groupBy(*keys).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.coalesce(F.max("gap") <= 2, F.lit(True)).alias("dense"),
    )
    curve = (
        gaps.filter("gap IS NOT NULL")
        .select(
            *keys, "ts",
            (F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600.0).alias("hour_no"),
            rolling_triangular_mean(F.col("gap"), w).alias("smooth_gap"),
        )
        .filter("smooth_gap IS NOT NULL")
    )
    cut = elbow_point(curve, keys, "hour_no", "smooth_gap", scale=False).select(
        *keys, F.col("ts").alias("cut")
    )
    after = F.timestamp_diff("HOUR", F.col("cut"), F.col("last")) > TWO_WEEKS_HOURS
    before = F.timestamp_diff("HOUR", F.col("first"), F.col("cut")) > TWO_WEEKS_HOURS
    cut_start = ~F.col("dense") & F.coalesce(after, F.lit(False))
    cut_end = ~F.col("dense") & ~cut_start & F.coalesce(before, F.lit(False))
    new_start = F.when(cut_start, F.col("cut")).otherwise(F.col("first"))
    new_end = F.when(cut_end, F.col("cut")).otherwise(F.col("last"))
    return span.join(cut, keys, "left").select(
        *keys,
        ((new_start != F.col("first")) | (new_end != F.col("last"))).alias("changed"),
        new_start.alias("new_start"),
        new_end.alias("new_end"),
    )


def flag_bad_quality(missing: Column) -> Column:
    return missing > MAX_MISSING_RATIO


def flag_constant(q49: Column, q51: Column, std: Column, lower: Column, upper: Column) -> Column:
    """The middle of the distribution sits on a bound, or the series does not vary."""
    return F.coalesce(
        (q51 == upper) | (q49 == lower) | (std < 1e-14), std < 1e-14, F.lit(False)
    )


# Interpolation: knot slopes on the known rows, forward-filled to the gap rows.


def _pchip_slopes(h: Column, m: Column, w) -> Column:
    """Fritsch-Carlson knot slopes from segment widths ``h`` and secants ``m``."""
    h0, m0 = F.lag(h).over(w), F.lag(m).over(w)
    wa, wb = 2 * h + h0, h + 2 * h0
    interior = F.when(m0 * m <= 0, F.lit(0.0)).otherwise((wa + wb) / (wa / m0 + wb / m))

    def edge(ha: Column, ma: Column, hb: Column, mb: Column) -> Column:
        d = ((2 * ha + hb) * ma - ha * mb) / (ha + hb)
        return (
            F.when(mb.isNull(), ma)
            .when(F.signum(d) != F.signum(ma), F.lit(0.0))
            .when((F.signum(ma) != F.signum(mb)) & (F.abs(d) > 3 * F.abs(ma)), 3 * ma)
            .otherwise(d)
        )

    first = edge(h, m, F.lead(h).over(w), F.lead(m).over(w))
    last = edge(h0, m0, F.lag(h, 2).over(w), F.lag(m, 2).over(w))
    return F.when(m0.isNull(), first).when(m.isNull(), last).otherwise(interior)


def _akima_slopes(m: Column, w) -> Column:
    """(weight, slope) inputs of Akima's rule from the secants around each knot."""
    a, b, c, e = (F.lag(m, 2).over(w), F.lag(m).over(w), m, F.lead(m).over(w))
    b = F.coalesce(b, 2 * c - e)
    c = F.coalesce(c, 2 * b - a)
    a = F.coalesce(a, 2 * b - c)
    e = F.coalesce(e, 2 * c - b)
    left, right = F.abs(b - a), F.abs(e - c)
    return F.struct(
        (left + right).alias("weight"),
        F.try_divide(right * b + left * c, left + right).alias("weighted"),
        ((b + c) / 2).alias("plain"),
    )


def interpolate(
    df: DataFrame, method: str = "pchip", keys: list[str] = SERIES, x: Column | None = None
) -> DataFrame:
    """Fill inner NULLs of ``value`` by a cubic through the known rows.

    ``method`` is ``pchip`` (monotone), ``akima`` or ``linear``; Akima with fewer than five
    known rows falls back to linear. ``x`` defaults to the hour number. Values before the
    first and after the last known row stay NULL.

    Knot slopes are windows over (key, is known), the forward fill is a window over the key;
    the first window fixes the exchange on the key, which serves all the others.
    """
    w = along(keys)
    if x is None:
        x = F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600.0
    rows = df.withColumn("_x", x).withColumn(
        "_n", F.count("value").over(Window.partitionBy(*keys))
    )
    rows = rows.withColumn("_known", F.col("value").isNotNull())
    wk = Window.partitionBy(*keys, "_known").orderBy("ts")
    seg = rows.withColumn("_h", F.lead("_x").over(wk) - F.col("_x"))
    seg = seg.withColumn("_m", (F.lead("value").over(wk) - F.col("value")) / F.col("_h"))
    if method == "pchip":
        seg = seg.withColumn("_d", _pchip_slopes(F.col("_h"), F.col("_m"), wk))
    elif method == "akima":
        seg = seg.withColumn("_a", _akima_slopes(F.col("_m"), wk))
        most = F.max("_a.weight").over(Window.partitionBy(*keys, "_known"))
        slope = F.when(F.col("_a.weight") > 1e-9 * most, F.col("_a.weighted")).otherwise(
            F.col("_a.plain")
        )
        seg = seg.withColumn("_d", F.when(F.col("_n") >= 5, slope))
    else:
        seg = seg.withColumn("_d", F.lit(None).cast("double"))
    seg = seg.withColumn("_d1", F.lead("_d").over(wk))
    knot = F.struct("_x", "value", "_h", "_m", "_d", "_d1")
    filled = seg.withColumn(
        "_k", F.last(F.when(F.col("_known"), knot), ignorenulls=True).over(w)
    )
    s = F.col("_x") - F.col("_k._x")
    y, h, m, d0, d1 = (F.col(f"_k.{n}") for n in ("value", "_h", "_m", "_d", "_d1"))
    linear = y + s * m
    c2 = (3 * m - 2 * d0 - d1) / h
    c3 = (d0 + d1 - 2 * m) / (h * h)
    cubic = y + s * (d0 + s * (c2 + s * c3))
    value = F.coalesce(F.col("value"), F.coalesce(cubic, linear))
    return filled.select(
        *[value.alias("value") if c == "value" else F.col(c) for c in df.columns]
    )


# Variable-span smoother.

SPANS = (0.05, 0.2, 0.5)  # fixed values: tweeter, midrange, woofer shares of the series
MIDDLE, FINAL = 0.2, 0.05


def _running_line(y: np.ndarray, span: float) -> tuple[np.ndarray, np.ndarray]:
    """Local straight-line fit (and leverage) around each row over ``span`` of the series."""
    n = len(y)
    x = np.arange(n, dtype=float)
    half = max(1, int(round(span * n / 2)))
    lo = np.maximum(0, np.arange(n) - half)
    hi = np.minimum(n, np.arange(n) + half + 1)

    def window_sum(v: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(v)])
        return total[hi] - total[lo]

    size = (hi - lo).astype(float)
    mx, my = window_sum(x) / size, window_sum(y) / size
    sxx = np.maximum(window_sum(x * x) - size * mx * mx, 0.0)
    sxy = window_sum(x * y) - size * mx * my
    flat = sxx < 1e-12
    slope = np.where(flat, 0.0, sxy / np.where(flat, 1.0, sxx))
    lean = np.where(flat, 0.0, (x - mx) ** 2 / np.where(flat, 1.0, sxx))
    return my + slope * (x - mx), 1 / size + lean


def smooth_values(y: np.ndarray) -> np.ndarray:
    """Three running-line fits; at each row the span with the least smoothed
    cross-validation residual is chosen, the chosen spans are smoothed, the fits are
    interpolated to that span and smoothed once more."""
    fits, misses = [], []
    for span in SPANS:
        fit, leverage = _running_line(y, span)
        fits.append(fit)
        loo = np.abs(y - fit) / np.maximum(1 - leverage, 1e-9)
        misses.append(_running_line(loo, MIDDLE)[0])
    best = np.asarray(SPANS)[np.argmin(misses, axis=0)]
    s = np.clip(_running_line(best, MIDDLE)[0], SPANS[0], SPANS[-1])
    low = fits[0] + (s - SPANS[0]) / (SPANS[1] - SPANS[0]) * (fits[1] - fits[0])
    high = fits[1] + (s - SPANS[1]) / (SPANS[2] - SPANS[1]) * (fits[2] - fits[1])
    return _running_line(np.where(s <= SPANS[1], low, high), FINAL)[0]


def super_smoother(df: DataFrame, keys: list[str] = SERIES, value: str = "value") -> DataFrame:
    """Friedman's variable-span smoother over equally weighted rows; adds ``smooth``.

    The spans are shares of the series length, which no window frame can state, so this is a
    grouped map over one series (bounded by the calendar) with linear-time prefix sums.
    """

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        return pdf.assign(smooth=smooth_values(pdf[value].to_numpy(dtype=float)))

    schema = T.StructType([*df.schema.fields, T.StructField("smooth", T.DoubleType())])
    return spread(df, keys).groupBy(*keys).applyInPandas(smooth, schema)


def iqr_outlier_flag(
    df: DataFrame, keys: list[str] = SERIES, value: str = "value", smooth: str = "smooth"
) -> DataFrame:
    """Flag rows whose residual to ``smooth`` leaves [q1 - 3 IQR, q3 + 3 IQR]."""
    r = df.withColumn("_r", F.col(value) - F.col(smooth)).withColumn(
        "_q",
        F.percentile("_r", F.array(F.lit(0.25), F.lit(0.75))).over(Window.partitionBy(*keys)),
    )
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    outside = (F.col("_r") < q1 - 3 * (q3 - q1)) | (F.col("_r") > q3 + 3 * (q3 - q1))
    return r.withColumn("is_outlier", outside).drop("_r", "_q")


def iqr_outlier_replace(
    df: DataFrame, keys: list[str] = SERIES, smooth: str = "smooth"
) -> DataFrame:
    """Replace flagged rows by the smooth plus an Akima-interpolated residual; raw is ``ytop``."""
    flagged = iqr_outlier_flag(df, keys, "value", smooth)
    index = F.row_number().over(along(keys)) - 1
    residual = flagged.select(
        *keys, "ts", smooth, F.col("value").alias("ytop"), "is_outlier",
        index.cast("double").alias("_i"),
        F.when(~F.col("is_outlier"), F.col("value") - F.col(smooth)).alias("value"),
    )
    filled = interpolate(residual, "akima", keys, x=F.col("_i"))
    return filled.select(
        *keys, F.col("ts").alias("ds"), (F.col("value") + F.col(smooth)).alias("y"), "ytop"
    )


def extract_series(
    df: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    smoothing: bool = True,
    keys: list[str] = SERIES,
) -> DataFrame:
    """Clean (ds, y, ytop) rows of all series at once: window, drop nulls, smooth."""
    rows = known(df)
    if start is not None:
        rows = rows.filter(F.col("ts") >= start)
    if end is not None:
        rows = rows.filter(F.col("ts") <= end)
    if smoothing:
        return iqr_outlier_replace(super_smoother(rows, keys), keys)
    return rows.select(
        *keys, F.col("ts").alias("ds"), F.col("value").alias("y"), F.col("value").alias("ytop")
    )


def route_model(bad: Column, constant: Column, seasonal: Column, stationary: Column) -> Column:
    """Model class of a series; bad and constant series keep their own class."""
    yes = F.lit(False)
    return (
        F.when(bad, "bad_quality_data")
        .when(constant, "constant")
        .when(F.coalesce(seasonal, yes), "seasonal_prophet")
        .when(F.coalesce(stationary, yes), "non_seasonal_dbscan")
        .otherwise("non_seasonal_trend")
    )
