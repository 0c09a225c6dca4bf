"""Reshape, join and aggregation queries."""

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    EH_SQL,
    EHW_SQL,
    GRID_SQL,
    eh,
    eh_wide,
    grid,
    query,
    rnd,
    rsql,
    table,
)
from tidemark.functions import scalar
from tidemark.operators import aggregates, joins, reshape
from tidemark.plans.forecasting import SEASONAL_GRID

LONG = f"SELECT kpi, dim_key, ts, {rsql('value')} AS value"
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def long_out(df):
    return df.select("kpi", "dim_key", "ts", rnd("value").alias("value"))


@query(
    "wide_to_long",
    "SELECT l_orderkey, l_linenumber, variable, value FROM ("
    + " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, '{m}' AS variable, {m} AS value FROM lineitem"
        for m in MEASURES
    )
    + ")",
)
def wide_to_long(spark, d):
    return reshape.wide_to_long(
        table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], MEASURES
    )


@query(
    "long_to_time_matrix",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, CAST(count(*) AS INT) AS n_points,
       string_agg(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ' ' ORDER BY ts) AS row
    FROM eh WHERE kpi <> 'value_wmean' GROUP BY 1, 2""",
)
def long_to_time_matrix(spark, d):
    matrix = reshape.long_to_time_matrix(eh(spark, d).filter("kpi <> 'value_wmean'"))
    cents = F.transform("values", lambda v: F.round(v * 100).cast("long").cast("string"))
    return matrix.select(
        "kpi", "dim_key", F.size("values").alias("n_points"), F.array_join(cents, " ").alias("row")
    )


HOURS = ", ".join(
    f"{rsql(f'max(value) FILTER (hour(ts) = {h})')} AS h{h:02d}" for h in range(24)
)


@query(
    "hour_by_day_pivot",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {HOURS}
    FROM eh GROUP BY 1, 2, 3""",
)
def hour_by_day_pivot(spark, d):
    days = reshape.hour_by_day_pivot(eh(spark, d))
    return days.select("kpi", "dim_key", F.col("day").cast("string").alias("day"), *[rnd(f"h{h:02d}").alias(f"h{h:02d}") for h in range(24)])


@query("hourly_grid", f"WITH {GRID_SQL} {LONG} FROM grid")
def hourly_grid(spark, d):
    return long_out(grid(spark, d))


def dedupe_sql(direction):
    return f"""SELECT event_type, hour_ts, event_id, {rsql('value')} AS value FROM (
      SELECT event_type, date_trunc('hour', ts) AS hour_ts, event_id, value,
             row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts)
                                ORDER BY ts {direction}, event_id {direction}) AS rn
      FROM events) WHERE rn = 1"""


def dedupe_query(spark, d, keep):
    events = table(spark, d, "events").select(
        "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_ts"),
        "event_id", "value", "ts",
    )
    kept = reshape.dedupe(
        events, ["event_type", "hour_ts"], [F.col("ts"), F.col("event_id")], keep
    )
    return kept.select("event_type", "hour_ts", "event_id", rnd("value").alias("value"))


@query("dedupe_keep_last", dedupe_sql("DESC"))
def dedupe_keep_last(spark, d):
    return dedupe_query(spark, d, "last")


@query("dedupe_keep_first", dedupe_sql("ASC"))
def dedupe_keep_first(spark, d):
    return dedupe_query(spark, d, "first")


@query(
    "explode_list",
    f"""WITH {EHW_SQL} SELECT dim_key, ts, unnest([value_sum, value_sample]) AS value FROM ehw""",
)
def explode_list(spark, d):
    return eh_wide(spark, d).select(
        "dim_key", "ts", F.explode(F.array("value_sum", "value_sample")).alias("value")
    )


@query(
    "union_all",
    f"""WITH {EHW_SQL}
    SELECT dim_key, ts, value_sum, NULL::DOUBLE AS value_sample FROM ehw
    UNION ALL SELECT dim_key, ts, NULL, value_sample FROM ehw""",
)
def union_all(spark, d):
    wide = eh_wide(spark, d)
    return reshape.union_all(
        wide.select("dim_key", "ts", "value_sum"), wide.select("ts", "value_sample", "dim_key")
    )


TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "forecast_matrix",
    f"""WITH {EHW_SQL} SELECT ts, """
    + ", ".join(f"{rsql(f'''max(value_wmean) FILTER (dim_key = '{t}')''')} AS {t}" for t in TYPES)
    + " FROM ehw GROUP BY 1",
)
def forecast_matrix(spark, d):
    wide = eh_wide(spark, d).select("dim_key", "ts", F.col("value_wmean").alias("value"))
    out = reshape.forecast_matrix(wide, TYPES)
    return out.select("ts", *[rnd(t).alias(t) for t in TYPES])


@query("distinct_values", f"WITH {EH_SQL} SELECT DISTINCT kpi, dim_key FROM eh")
def distinct_values(spark, d):
    return eh(spark, d).select("kpi", "dim_key").distinct()


# Joins: "actuals" are the first three weeks, "forecast" every hour of the grid.
FORECAST_SQL = """act AS (SELECT kpi, dim_key, ts, value AS y FROM eh
  WHERE ts < TIMESTAMP '2024-01-22 00:00:00'),
fc AS (SELECT kpi, dim_key, ts, coalesce(value, 10) * 0.9 AS yhat FROM grid)"""
CUT = "2024-01-22 00:00:00"


def actual_forecast(spark, d):
    actual = (
        eh(spark, d)
        .filter(F.col("ts") < F.lit(CUT).cast("timestamp_ntz"))
        .withColumnRenamed("value", "y")
    )
    forecast = grid(spark, d).select(
        "kpi", "dim_key", "ts", (F.coalesce("value", F.lit(10.0)) * 0.9).alias("yhat")
    )
    return actual, forecast


ON = ["kpi", "dim_key", "ts"]


@query(
    "align_left",
    f"""WITH {GRID_SQL}, {FORECAST_SQL}
    SELECT f.kpi, f.dim_key, f.ts, {rsql('f.yhat')} AS yhat, {rsql('a.y')} AS y
    FROM fc f LEFT JOIN act a ON f.kpi = a.kpi AND f.dim_key = a.dim_key AND f.ts = a.ts""",
)
def align_left(spark, d):
    actual, forecast = actual_forecast(spark, d)
    out = joins.align_left(forecast, actual, ON)
    return out.select(*ON, rnd("yhat").alias("yhat"), rnd("y").alias("y"))


@query(
    "residual_join",
    f"""WITH {GRID_SQL}, {FORECAST_SQL}
    SELECT f.kpi, f.dim_key, f.ts, {rsql('a.y - f.yhat')} AS residual
    FROM fc f JOIN act a ON f.kpi = a.kpi AND f.dim_key = a.dim_key AND f.ts = a.ts""",
)
def residual_join(spark, d):
    actual, forecast = actual_forecast(spark, d)
    out = joins.residual_join(actual, forecast, ON)
    return out.select(*ON, rnd("residual").alias("residual"))


@query(
    "semi_join",
    f"""WITH {GRID_SQL}, {FORECAST_SQL} SELECT kpi, dim_key, ts, {rsql('yhat')} AS yhat
    FROM fc WHERE (kpi, dim_key, ts) IN (SELECT (kpi, dim_key, ts) FROM act)""",
)
def semi_join(spark, d):
    actual, forecast = actual_forecast(spark, d)
    return joins.semi_join(forecast, actual, ON).select(*ON, rnd("yhat").alias("yhat"))


@query(
    "anti_join",
    f"""WITH {GRID_SQL}, {FORECAST_SQL} SELECT kpi, dim_key, ts, {rsql('yhat')} AS yhat
    FROM fc WHERE (kpi, dim_key, ts) NOT IN (SELECT (kpi, dim_key, ts) FROM act)""",
)
def anti_join(spark, d):
    actual, forecast = actual_forecast(spark, d)
    return joins.anti_join(forecast, actual, ON).select(*ON, rnd("yhat").alias("yhat"))


@query(
    "param_cross_join",
    f"""WITH {EH_SQL}
    SELECT s.kpi, s.dim_key, cps, sps, mode, weekend
    FROM (SELECT DISTINCT kpi, dim_key FROM eh) s,
         (SELECT unnest([0.01, 0.1, 1.0]::DOUBLE[]) AS cps) a,
         (SELECT unnest([0.1, 1.0, 10.0, 50.0]::DOUBLE[]) AS sps) b,
         (SELECT unnest(['additive', 'multiplicative']) AS mode) c,
         (SELECT unnest([true, false]) AS weekend) w""",
)
def param_cross_join(spark, d):
    series = eh(spark, d).select("kpi", "dim_key").distinct()
    return joins.param_product(series, SEASONAL_GRID).select(
        "kpi", "dim_key",
        F.col("changepoint_prior_scale").alias("cps"),
        F.col("seasonality_prior_scale").alias("sps"),
        F.col("seasonality_mode").alias("mode"),
        "weekend",
    )


# Aggregations
@query(
    "sum_by_key_time",
    f"""WITH {EH_SQL} SELECT kpi, ts, {rsql('sum(value)')} AS value FROM eh GROUP BY 1, 2""",
)
def sum_by_key_time(spark, d):
    return (
        eh(spark, d)
        .groupBy("kpi", "ts")
        .agg(rnd(F.sum("value")).alias("value"))
        .orderBy("kpi", "ts")
    )


WINDOW_SQL = """win AS (SELECT date_trunc('week', max(ts)) + INTERVAL 7 DAY AS e FROM eh)"""


@query(
    "missing_ratio",
    f"""WITH {EH_SQL}, {WINDOW_SQL}
    SELECT kpi, dim_key,
      {rsql("1 - count(value) FILTER (ts >= e - INTERVAL 28 DAY AND ts < e) / 672.0")}
        AS missing_data_ratio_all,
      {rsql("1 - count(value) FILTER (ts >= e - INTERVAL 7 DAY AND ts < e) / 168.0")}
        AS missing_data_ratio_last_week
    FROM eh, win GROUP BY 1, 2""",
)
def missing_ratio(spark, d):
    kpi = eh(spark, d)
    newest = kpi.agg(F.max("ts").alias("_newest"))
    window = scalar.analysis_window(scalar.ts_to_epoch(F.col("_newest")))
    out = aggregates.missing_ratio(
        joins.with_scalar(kpi, newest),
        window["window_start"], window["last_week_start"], window["window_end"],
    )
    cols = ["missing_data_ratio_all", "missing_data_ratio_last_week"]
    return out.select("kpi", "dim_key", *[rnd(c).alias(c) for c in cols])


@query(
    "mean_std",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, {rsql('avg(value)')} AS mean,
       {rsql('stddev_pop(value)')} AS std FROM eh GROUP BY 1, 2""",
)
def mean_std(spark, d):
    out = aggregates.mean_std(eh(spark, d), ["kpi", "dim_key"])
    return out.select("kpi", "dim_key", rnd("mean").alias("mean"), rnd("std").alias("std"))


PROBS = {"q05": 0.05, "q25": 0.25, "q49": 0.49, "q51": 0.51, "q75": 0.75, "q95": 0.95, "q975": 0.975}


@query(
    "quantiles",
    f"WITH {EH_SQL} SELECT kpi, dim_key, "
    + ", ".join(f"{rsql(f'quantile_cont(value, {p})')} AS {n}" for n, p in PROBS.items())
    + " FROM eh GROUP BY 1, 2",
)
def quantiles(spark, d):
    out = aggregates.series_quantiles(eh(spark, d), PROBS)
    return out.select("kpi", "dim_key", *[rnd(n).alias(n) for n in PROBS])


@query(
    "median_daily_iqr",
    f"""WITH {EH_SQL}, day AS (
      SELECT kpi, dim_key, CAST(ts AS DATE) AS day,
             quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
      FROM eh GROUP BY 1, 2, 3)
    SELECT kpi, dim_key, {rsql('quantile_cont(iqr, 0.5)')} AS iqr FROM day GROUP BY 1, 2""",
)
def median_daily_iqr(spark, d):
    out = aggregates.median_daily_iqr(eh(spark, d))
    return out.select("kpi", "dim_key", rnd("iqr").alias("iqr"))


STATS = ["mean", "std", "min", "max", "q25", "q50", "q75"]


@query(
    "describe_numeric",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS variable, CAST(count({m}) AS BIGINT) AS count,
        {rsql(f'avg({m})', 4)} AS mean, {rsql(f'stddev_samp({m})', 4)} AS std,
        {rsql(f'min({m})', 4)} AS min, {rsql(f'max({m})', 4)} AS max,
        {rsql(f'quantile_cont({m}, 0.25)', 4)} AS q25, {rsql(f'quantile_cont({m}, 0.5)', 4)} AS q50,
        {rsql(f'quantile_cont({m}, 0.75)', 4)} AS q75 FROM lineitem"""
        for m in MEASURES
    ),
)
def describe_numeric(spark, d):
    out = aggregates.describe_numeric(table(spark, d, "lineitem"), MEASURES)
    return out.select("variable", "count", *[rnd(s, 4).alias(s) for s in STATS])


@query(
    "series_count",
    f"""WITH {EH_SQL} SELECT kpi, CAST(count(DISTINCT dim_key) AS BIGINT) AS n_series
    FROM eh GROUP BY 1""",
)
def series_count(spark, d):
    keys = eh(spark, d).select("kpi", "dim_key").distinct()
    return keys.groupBy("kpi").agg(F.count(F.lit(1)).alias("n_series"))


@query(
    "value_counts",
    "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1",
)
def value_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "majority_label",
    f"""WITH {EH_SQL}, c AS (SELECT kpi, dim_key, CAST(floor(value / 10) AS BIGINT) AS label,
         count(*) AS n FROM eh GROUP BY 1, 2, 3)
    SELECT kpi, dim_key, label, CAST(n AS BIGINT) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY kpi, dim_key ORDER BY n DESC, label) AS rn FROM c)
    WHERE rn = 1""",
)
def majority_label(spark, d):
    points = eh(spark, d).withColumn("label", F.floor(F.col("value") / 10))
    return aggregates.majority_label(points, ["kpi", "dim_key"], "label")


@query(
    "valid_span_trim",
    f"""WITH {GRID_SQL}, holed AS (
      SELECT kpi, dim_key, ts, CASE WHEN hour(ts) < 3 OR value > 90 THEN NULL ELSE value END AS value
      FROM grid)
    SELECT h.kpi, h.dim_key, h.ts, {rsql('h.value')} AS value FROM holed h JOIN (
      SELECT kpi, dim_key, min(ts) FILTER (value IS NOT NULL) AS a,
             max(ts) FILTER (value IS NOT NULL) AS b FROM holed GROUP BY 1, 2) s
    ON h.kpi = s.kpi AND h.dim_key = s.dim_key AND h.ts BETWEEN s.a AND s.b""",
)
def valid_span_trim(spark, d):
    holed = grid(spark, d).withColumn(
        "value", F.when((F.hour("ts") < 3) | (F.col("value") > 90), None).otherwise(F.col("value"))
    )
    return long_out(aggregates.valid_span_trim(holed))


@query(
    "envelope_by_time",
    f"""WITH {EH_SQL}, m AS (
      SELECT kpi, avg(value) FILTER (dim_key <> 'error') AS a,
             avg(value) FILTER (dim_key = 'error') AS b FROM eh GROUP BY 1)
    SELECT e.kpi, e.ts, {rsql('CASE WHEN m.a > m.b THEN min(e.value) ELSE max(e.value) END')}
             AS envelope, m.a > m.b AS outliers_below
    FROM eh e JOIN m ON e.kpi = m.kpi WHERE e.dim_key <> 'error' GROUP BY e.kpi, e.ts, m.a, m.b""",
)
def envelope_by_time(spark, d):
    out = aggregates.envelope_by_time(
        eh(spark, d), ["kpi"], "ts", "value", F.col("dim_key") != "error"
    )
    return out.select("kpi", "ts", rnd("envelope").alias("envelope"), "outliers_below")


@query(
    "daily_std",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
       {rsql('stddev_samp(value)')} AS std FROM eh GROUP BY 1, 2, 3""",
)
def daily_std(spark, d):
    return (
        eh(spark, d)
        .groupBy("kpi", "dim_key", F.to_date("ts").cast("string").alias("day"))
        .agg(rnd(F.stddev_samp("value")).alias("std"))
    )


@query(
    "min_group_size",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, CAST(count(*) AS BIGINT) AS n FROM eh
    GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def min_group_size(spark, d):
    return eh(spark, d).groupBy("kpi", "dim_key").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


@query(
    "tie_correction",
    f"""WITH {EH_SQL}, t AS (SELECT kpi, dim_key, value, CAST(count(*) AS DOUBLE) AS t
         FROM eh GROUP BY 1, 2, 3)
    SELECT kpi, dim_key, {rsql('1 - sum(t*t*t - t) / (pow(sum(t), 3) - sum(t))')} AS tie_correction
    FROM t GROUP BY 1, 2""",
)
def tie_correction(spark, d):
    out = aggregates.tie_correction(eh(spark, d), ["kpi", "dim_key"])
    return out.select("kpi", "dim_key", rnd("tie_correction").alias("tie_correction"))


@query(
    "argmin_row",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, ts, {rsql('value')} AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY kpi, dim_key ORDER BY value, ts) AS rn FROM eh)
    WHERE rn = 1""",
)
def argmin_row(spark, d):
    return long_out(aggregates.argmin_row(eh(spark, d), ["kpi", "dim_key"], "value", "ts"))
