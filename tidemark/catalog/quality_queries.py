"""Gap, elbow, imputation, smoothing and quality-flag queries."""

from pyspark.sql import functions as F

from tidemark.catalog.base import EH_RULES, EH_SQL, GRID_SQL, RULES_SQL, eh, grid, query, rnd, rsql
from tidemark.catalog.table_queries import WINDOW_SQL
from tidemark.functions import scalar
from tidemark.operators import aggregates, joins, quality
from tidemark.operators.baseline import apply_profile, seasonal_profile
from tidemark.schema import KPI_RULE, SERIES

W = "(PARTITION BY kpi, dim_key ORDER BY ts)"


def newest_window(kpi):
    """The four-week analysis window attached to every row."""
    newest = kpi.agg(F.max("ts").alias("_newest"))
    return joins.with_scalar(kpi, newest), scalar.analysis_window(
        scalar.ts_to_epoch(F.col("_newest"))
    )


@query(
    "gap_profile",
    f"""WITH {EH_SQL}, g AS (SELECT kpi, dim_key,
         (epoch(ts) - lag(epoch(ts)) OVER {W}) / 3600.0 AS gap FROM eh)
    SELECT kpi, dim_key, CAST(count(gap) AS BIGINT) AS n_gaps,
           {rsql('max(gap)')} AS max_gap_hours, coalesce(max(gap) <= 2, true) AS dense
    FROM g GROUP BY 1, 2""",
)
def gap_profile(spark, d):
    out = quality.gap_profile(grid(spark, d))
    return out.select(*SERIES, "n_gaps", rnd("max_gap_hours").alias("max_gap_hours"), "dense")


def curve_sql(order):
    """Sorted value curve of each series, its chord rotation and the extreme row."""
    return f"""WITH {EH_SQL}, c AS (
      SELECT kpi, dim_key, CAST(row_number() OVER (PARTITION BY kpi, dim_key ORDER BY value, ts) AS INT)
             AS rank, value FROM eh),
    e AS (SELECT kpi, dim_key, min(rank) AS x0, max(rank) AS x1, min(value) AS y0, max(value) AS y1
          FROM c GROUP BY 1, 2),
    s AS (SELECT c.*, (rank - x0) / CAST(x1 - x0 AS DOUBLE) AS sx, (value - y0) / (y1 - y0) AS sy
          FROM c JOIN e ON c.kpi = e.kpi AND c.dim_key = e.dim_key),
    r AS (SELECT *, round(sy * cos(pi() / 4) - sx * sin(pi() / 4), 9) AS up FROM s)
    SELECT kpi, dim_key, rank, {rsql('value')} AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY kpi, dim_key ORDER BY up {order}, rank) AS rn FROM r)
    WHERE rn = 1"""


def curve_query(spark, d, knee):
    from tidemark.operators.windows import sort_curve

    curve = sort_curve(eh(spark, d), SERIES).select(*SERIES, "rank", "value")
    out = quality.elbow_point(curve, SERIES, "rank", "value", knee=knee)
    return out.select(*SERIES, "rank", rnd("value").alias("value"))


@query("elbow_point", curve_sql("ASC"))
def elbow_point(spark, d):
    return curve_query(spark, d, False)


@query("knee_point", curve_sql("DESC"))
def knee_point(spark, d):
    return curve_query(spark, d, True)


# A series with a long hole two days before its second-last week exercises the trim.
HOLE = "ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-09 00:00:00' AND dim_key = 'error'"


@query(
    "trim_gappy_edges",
    f"""WITH {EH_SQL}, k AS (SELECT * FROM eh WHERE NOT ({HOLE})),
    g AS (SELECT kpi, dim_key, ts, (lead(epoch(ts)) OVER {W} - epoch(ts)) / 3600.0 AS gap FROM k),
    s AS (SELECT kpi, dim_key, min(ts) AS a, max(ts) AS b, coalesce(max(gap) <= 2, true) AS dense
          FROM g GROUP BY 1, 2),
    m AS (SELECT kpi, dim_key, ts, epoch(ts) / 3600.0 AS x, (0.25 * lag(gap, 3) OVER {W}
            + 0.75 * lag(gap, 2) OVER {W} + 0.75 * lag(gap) OVER {W} + 0.25 * gap) / 2.0 AS y
          FROM g WHERE gap IS NOT NULL),
    q AS (SELECT * FROM m WHERE y IS NOT NULL),
    e AS (SELECT kpi, dim_key, min(x) AS x0, max(x) AS x1, min(y) AS ylo, min_by(y, x) AS y0,
                 max_by(y, x) AS y1 FROM q GROUP BY 1, 2),
    r AS (SELECT q.kpi, q.dim_key, ts, x, round((y - ylo) * cos(atan2(y1 - y0, x1 - x0))
                 - (x - x0) * sin(atan2(y1 - y0, x1 - x0)), 9) AS up
          FROM q JOIN e ON q.kpi = e.kpi AND q.dim_key = e.dim_key),
    c AS (SELECT kpi, dim_key, ts AS cut FROM (SELECT *, row_number() OVER
            (PARTITION BY kpi, dim_key ORDER BY up, x) AS rn FROM r) WHERE rn = 1),
    z AS (SELECT s.*, c.cut,
             NOT dense AND coalesce(b - cut > INTERVAL 14 DAY, false) AS cs,
             NOT dense AND NOT coalesce(b - cut > INTERVAL 14 DAY, false)
               AND coalesce(cut - a > INTERVAL 14 DAY, false) AS ce
          FROM s LEFT JOIN c ON s.kpi = c.kpi AND s.dim_key = c.dim_key)
    SELECT kpi, dim_key, (cs AND cut <> a) OR (ce AND cut <> b) AS changed,
           CASE WHEN cs THEN cut ELSE a END AS new_start, CASE WHEN ce THEN cut ELSE b END AS new_end
    FROM z""",
)
def trim_gappy_edges(spark, d):
    ts = F.col("ts")
    hole = (
        (ts >= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))
        & (ts < F.lit("2024-01-09 00:00:00").cast("timestamp_ntz"))
        & (F.col("dim_key") == "error")
    )
    return quality.trim_gappy_edges(eh(spark, d).filter(~hole))


RATIO_SQL = """ratio AS (SELECT kpi, dim_key,
  1 - count(value) FILTER (ts >= e - INTERVAL 28 DAY AND ts < e) / 672.0 AS r
  FROM eh, win GROUP BY 1, 2)"""


@query(
    "flag_bad_quality",
    f"""WITH {EH_SQL}, {WINDOW_SQL}, {RATIO_SQL}
    SELECT kpi, dim_key, r > 0.35 AS is_bad FROM ratio""",
)
def flag_bad_quality(spark, d):
    rows, window = newest_window(eh(spark, d))
    ratios = aggregates.missing_ratio(
        rows, window["window_start"], window["last_week_start"], window["window_end"]
    )
    return ratios.select(
        *SERIES, quality.flag_bad_quality(F.col("missing_data_ratio_all")).alias("is_bad")
    )


# value_sample is made to sit on its lower bound often enough to be constant for one key.
PINNED = "CASE WHEN kpi = 'value_sample' AND dim_key = 'view' THEN least(value, 1) - 1 ELSE value END"


@query(
    "flag_constant",
    f"""WITH {EH_SQL}, {RULES_SQL}, p AS (SELECT kpi, dim_key, {PINNED} AS value FROM eh),
    q AS (SELECT kpi, dim_key, quantile_cont(value, 0.49) AS a, quantile_cont(value, 0.51) AS b,
                 stddev_samp(value) AS s FROM p GROUP BY 1, 2)
    SELECT q.kpi, q.dim_key, b = upper OR a = lower OR coalesce(s < 1e-14, false) AS is_constant
    FROM q JOIN rules r ON q.kpi = r.kpi""",
)
def flag_constant(spark, d):
    rules = spark.createDataFrame(EH_RULES, KPI_RULE)
    pinned = F.when(
        (F.col("kpi") == "value_sample") & (F.col("dim_key") == "view"),
        F.least(F.col("value"), F.lit(1.0)) - 1,
    ).otherwise(F.col("value"))
    stats = (
        eh(spark, d)
        .withColumn("value", pinned)
        .groupBy(*SERIES)
        .agg(
            F.percentile("value", F.array(F.lit(0.49), F.lit(0.51))).alias("q"),
            F.stddev_samp("value").alias("std"),
        )
    )
    flag = quality.flag_constant(
        F.col("q")[0], F.col("q")[1], F.col("std"), F.col("lower"), F.col("upper")
    )
    return stats.join(F.broadcast(rules), "kpi").select(*SERIES, flag.alias("is_constant"))


KNOT_SQL = f"""kn AS (SELECT kpi, dim_key, ts, epoch(ts) / 3600.0 AS x, value AS y,
    (lead(epoch(ts)) OVER {W} - epoch(ts)) / 3600.0 AS h,
    (lead(value) OVER {W} - value) / ((lead(epoch(ts)) OVER {W} - epoch(ts)) / 3600.0) AS m
  FROM grid WHERE value IS NOT NULL)"""
EVAL_SQL = f"""dd AS (SELECT *, lead(d) OVER {W} AS d1 FROM sl)
SELECT g.kpi, g.dim_key, g.ts, {rsql('''CASE WHEN g.value IS NOT NULL THEN g.value ELSE
  k.y + s * (k.d + s * ((3 * k.m - 2 * k.d - k.d1) / k.h + s * ((k.d + k.d1 - 2 * k.m) / (k.h * k.h))))
  END''')} AS value
FROM (SELECT a.*, b.ts AS kts, epoch(a.ts) / 3600.0 - b.x AS s FROM grid a ASOF LEFT JOIN dd b
      ON a.kpi = b.kpi AND a.dim_key = b.dim_key AND a.ts >= b.ts) g
LEFT JOIN dd k ON g.kpi = k.kpi AND g.dim_key = k.dim_key AND g.kts = k.ts"""


def edge_sql(ha, ma, hb, mb):
    e = f"(((2 * {ha} + {hb}) * {ma} - {ha} * {mb}) / ({ha} + {hb}))"
    return f"""CASE WHEN {mb} IS NULL THEN {ma} WHEN sign({e}) <> sign({ma}) THEN 0
      WHEN sign({ma}) <> sign({mb}) AND abs({e}) > 3 * abs({ma}) THEN 3 * {ma} ELSE {e} END"""


@query(
    "interpolate_pchip",
    f"""WITH {GRID_SQL}, {KNOT_SQL},
    nb AS (SELECT *, lag(h) OVER {W} AS h0, lag(m) OVER {W} AS m0, lead(h) OVER {W} AS h2,
           lead(m) OVER {W} AS m2, lag(h, 2) OVER {W} AS hb, lag(m, 2) OVER {W} AS mb FROM kn),
    sl AS (SELECT *, CASE WHEN m0 IS NULL THEN {edge_sql('h', 'm', 'h2', 'm2')}
             WHEN m IS NULL THEN {edge_sql('h0', 'm0', 'hb', 'mb')}
             WHEN m0 * m <= 0 THEN 0
             ELSE (3 * h + 3 * h0) / ((2 * h + h0) / m0 + (h + 2 * h0) / m) END AS d FROM nb),
    {EVAL_SQL}""",
)
def interpolate_pchip(spark, d):
    out = quality.interpolate(grid(spark, d), "pchip")
    return out.select(*SERIES, "ts", rnd("value").alias("value"))


@query(
    "interpolate_akima",
    f"""WITH {GRID_SQL}, {KNOT_SQL},
    n1 AS (SELECT *, lag(m, 2) OVER {W} AS a0, lag(m) OVER {W} AS b0, lead(m) OVER {W} AS e0 FROM kn),
    n2 AS (SELECT *, coalesce(b0, 2 * m - e0) AS b FROM n1),
    n3 AS (SELECT *, coalesce(m, 2 * b - a0) AS c FROM n2),
    n4 AS (SELECT *, coalesce(a0, 2 * b - c) AS a, coalesce(e0, 2 * c - b) AS e FROM n3),
    n5 AS (SELECT *, abs(b - a) + abs(e - c) AS f FROM n4),
    sl AS (SELECT *, CASE WHEN f > 1e-9 * max(f) OVER (PARTITION BY kpi, dim_key)
             THEN (abs(e - c) * b + abs(b - a) * c) / f ELSE (b + c) / 2 END AS d FROM n5),
    {EVAL_SQL}""",
)
def interpolate_akima(spark, d):
    out = quality.interpolate(grid(spark, d), "akima")
    return out.select(*SERIES, "ts", rnd("value").alias("value"))


@query(
    "interpolate_linear",
    f"""WITH {GRID_SQL}, {KNOT_SQL}
    SELECT g.kpi, g.dim_key, g.ts,
           {rsql('coalesce(g.value, k.y + (epoch(g.ts) / 3600.0 - k.x) * k.m)')} AS value
    FROM grid g ASOF LEFT JOIN kn k
      ON g.kpi = k.kpi AND g.dim_key = k.dim_key AND g.ts >= k.ts""",
)
def interpolate_linear(spark, d):
    out = quality.interpolate(grid(spark, d), "linear")
    return out.select(*SERIES, "ts", rnd("value").alias("value"))


@query("super_smoother")
def super_smoother(spark, d):
    out = quality.super_smoother(eh(spark, d))
    return out.select(*SERIES, "ts", rnd("value").alias("value"), rnd("smooth").alias("smooth"))


@query(
    "iqr_outlier_replace",
    f"""WITH {EH_SQL}, p AS (SELECT kpi, dim_key, isodow(ts) AS dw, hour(ts) AS h, avg(value) AS sm
         FROM eh GROUP BY 1, 2, 3, 4),
    r AS (SELECT e.kpi, e.dim_key, e.ts, e.value, round(e.value - p.sm, 9) AS r FROM eh e JOIN p ON
      e.kpi = p.kpi AND e.dim_key = p.dim_key AND isodow(e.ts) = p.dw AND hour(e.ts) = p.h),
    q AS (SELECT kpi, dim_key, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3
          FROM r GROUP BY 1, 2)
    SELECT r.kpi, r.dim_key, r.ts AS ds, {rsql('r.value')} AS ytop,
           r < q1 - 3 * (q3 - q1) OR r > q3 + 3 * (q3 - q1) AS replaced
    FROM r JOIN q ON r.kpi = q.kpi AND r.dim_key = q.dim_key""",
)
def iqr_outlier_replace(spark, d):
    """Flags against the hour-of-week baseline; the refilled value is checked by tests."""
    kpi = eh(spark, d)
    smooth = apply_profile(kpi, seasonal_profile(kpi)).withColumn(
        "smooth", F.col("value") - F.round(F.col("value") - F.col("yhat"), 9)
    )
    flagged = quality.iqr_outlier_flag(smooth.select(*SERIES, "ts", "value", "smooth"))
    return flagged.select(
        *SERIES, F.col("ts").alias("ds"), rnd("value").alias("ytop"),
        F.col("is_outlier").alias("replaced"),
    )


@query(
    "extract_series",
    f"""WITH {GRID_SQL} SELECT kpi, dim_key, ts AS ds, {rsql('value')} AS y, {rsql('value')} AS ytop
    FROM grid WHERE value IS NOT NULL AND ts BETWEEN TIMESTAMP '2024-01-03 00:00:00'
      AND TIMESTAMP '2024-01-30 23:00:00'""",
)
def extract_series(spark, d):
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-03 00:00:00", "2024-01-30 23:00:00"))
    out = quality.extract_series(grid(spark, d), lo, hi, smoothing=False)
    return out.select(*SERIES, "ds", rnd("y").alias("y"), rnd("ytop").alias("ytop"))


@query("extract_series_smoothed")
def extract_series_smoothed(spark, d):
    out = quality.extract_series(eh(spark, d), smoothing=True)
    return out.select(*SERIES, "ds", rnd("y").alias("y"), rnd("ytop").alias("ytop"))


@query("series_profile")
def series_profile(spark, d):
    from tidemark.plans.profile import series_profile as profile

    return profile(eh(spark, d), spark.createDataFrame(EH_RULES, KPI_RULE), path="events")


@query(
    "series_profile_quality",
    f"""WITH {EH_SQL}, {WINDOW_SQL}, {RULES_SQL}, {RATIO_SQL}, q AS (
      SELECT kpi, dim_key, quantile_cont(value, 0.49) AS a, quantile_cont(value, 0.51) AS b,
             stddev_samp(value) AS s,
             1 - count(value) FILTER (ts >= e - INTERVAL 7 DAY AND ts < e) / 168.0 AS rw
      FROM eh, win WHERE ts >= e - INTERVAL 28 DAY AND ts < e GROUP BY 1, 2)
    SELECT q.kpi, q.dim_key, {rsql('r')} AS missing_data_ratio_all,
           {rsql('rw')} AS missing_data_ratio_last_week,
           CASE WHEN r > 0.35 THEN 'bad_quality_data'
                WHEN b = upper OR a = lower OR coalesce(s < 1e-14, false) THEN 'constant' END AS model_type
    FROM q JOIN ratio USING (kpi, dim_key) JOIN rules USING (kpi)""",
)
def series_profile_quality(spark, d):
    from tidemark.plans.profile import quality_columns

    out = quality_columns(eh(spark, d), spark.createDataFrame(EH_RULES, KPI_RULE))
    return out.select(
        *SERIES,
        rnd("missing_data_ratio_all").alias("missing_data_ratio_all"),
        rnd("missing_data_ratio_last_week").alias("missing_data_ratio_last_week"),
        "model_type",
    )


@query(
    "route_model",
    f"""WITH {EH_SQL}, f AS (SELECT kpi, dim_key, avg(value) > 60 AS bad, min(value) = 1 AS const,
         max(value) > 500 AS seas, stddev_samp(value) < 2 AS stat FROM eh GROUP BY 1, 2)
    SELECT kpi, dim_key, CASE WHEN bad THEN 'bad_quality_data' WHEN const THEN 'constant'
      WHEN seas THEN 'seasonal_prophet' WHEN stat THEN 'non_seasonal_dbscan'
      ELSE 'non_seasonal_trend' END AS model_type FROM f""",
)
def route_model(spark, d):
    flags = eh(spark, d).groupBy(*SERIES).agg(
        (F.avg("value") > 60).alias("bad"), (F.min("value") == 1).alias("const"),
        (F.max("value") > 500).alias("seas"), (F.stddev_samp("value") < 2).alias("stat"),
    )
    model = quality.route_model(*[F.col(c) for c in ("bad", "const", "seas", "stat")])
    return flags.select(*SERIES, model.alias("model_type"))
