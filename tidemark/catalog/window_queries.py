"""Window, sort and top-k queries along each series."""

from pyspark.sql import functions as F

from tidemark.catalog.base import EH_SQL, GRID_SQL, eh, grid, query, rnd, rsql
from tidemark.operators import windows
from tidemark.schema import SERIES

W = "(PARTITION BY kpi, dim_key ORDER BY ts)"
along = windows.along


def out(df, *cols):
    return df.select("kpi", "dim_key", "ts", *cols)


@query(
    "lag_diff",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, ts, {rsql('value - lag(value) OVER w')} AS diff,
       {rsql("(epoch(ts) - lag(epoch(ts)) OVER w) / 3600")} AS gap_hours
    FROM eh WINDOW w AS {W}""",
)
def lag_diff(spark, d):
    w = along()
    return out(
        eh(spark, d),
        rnd(windows.lag_diff(F.col("value"), w)).alias("diff"),
        rnd(windows.gap_hours(F.col("ts"), w)).alias("gap_hours"),
    )


@query(
    "lead_shift",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, ts, {rsql('lead(value, 3) OVER w')} AS value
    FROM eh WINDOW w AS {W}""",
)
def lead_shift(spark, d):
    return out(eh(spark, d), rnd(windows.lead_shift(F.col("value"), along())).alias("value"))


@query(
    "rolling_mean",
    f"""WITH {GRID_SQL} SELECT kpi, dim_key, ts,
       CASE WHEN count(value) OVER w = 7 THEN {rsql('avg(value) OVER w')} END AS value
    FROM grid WINDOW w AS (PARTITION BY kpi, dim_key ORDER BY ts
                           ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
)
def rolling_mean(spark, d):
    return out(grid(spark, d), rnd(windows.rolling_mean(F.col("value"), along())).alias("value"))


@query(
    "rolling_triangular_mean",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, ts, {rsql('''(0.25 * lag(value, 3) OVER w
       + 0.75 * lag(value, 2) OVER w + 0.75 * lag(value, 1) OVER w + 0.25 * value) / 2''', 12)} AS value
    FROM eh WINDOW w AS {W}""",
)
def rolling_triangular_mean(spark, d):
    smooth = windows.rolling_triangular_mean(F.col("value"), along())
    return out(eh(spark, d), rnd(smooth, 12).alias("value"))


QW = """(PARTITION BY kpi, dim_key ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 23 FOLLOWING)"""


@query(
    "rolling_quantile",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, ts,
       CASE WHEN count(value) OVER w = 48 THEN {rsql('quantile_cont(value, 0.4) OVER w')} END AS q40,
       CASE WHEN count(value) OVER w = 48 THEN {rsql('quantile_cont(value, 0.6) OVER w')} END AS q60
    FROM eh WINDOW w AS {QW}""",
)
def rolling_quantile(spark, d):
    w = along()
    return out(
        eh(spark, d),
        rnd(windows.rolling_quantile(F.col("value"), w, 0.4)).alias("q40"),
        rnd(windows.rolling_quantile(F.col("value"), w, 0.6)).alias("q60"),
    )


@query(
    "avg_rank",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, ts,
       {rsql('''rank() OVER (PARTITION BY kpi, dim_key ORDER BY value)
       + (count(*) OVER (PARTITION BY kpi, dim_key, value) - 1) / 2.0''')} AS avg_rank FROM eh""",
)
def avg_rank(spark, d):
    return out(eh(spark, d), rnd(windows.avg_rank("value")).alias("avg_rank"))


@query(
    "row_index",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, ts, CAST(row_number() OVER {W} - 1 AS INT) AS idx
    FROM eh""",
)
def row_index(spark, d):
    from tidemark.operators.reshape import row_index as index

    return out(eh(spark, d), index(SERIES).alias("idx"))


@query(
    "equal_slices",
    f"""WITH {EH_SQL}, r AS (SELECT kpi, dim_key, ts, row_number() OVER {W} - 1 AS i,
         count(*) OVER (PARTITION BY kpi, dim_key) AS n FROM eh)
    SELECT kpi, dim_key, ts, CAST((i >= n // 4)::INT + (i >= 2 * n // 4)::INT
           + (i >= 3 * n // 4)::INT AS INT) AS slice FROM r""",
)
def equal_slices(spark, d):
    return out(eh(spark, d), windows.equal_slices(4).alias("slice"))


POINT_SQL = """pt AS (SELECT kpi, dim_key, max(ts) FILTER (value + 5 > 20 AND value < 60
  AND ts >= TIMESTAMP '2024-01-08 00:00:00') AS last_point FROM eh GROUP BY 1, 2)"""


def last_points(spark, d):
    cond = (
        (F.col("value") + 5 > 20)
        & (F.col("value") < 60)
        & (F.col("ts") >= F.lit("2024-01-08 00:00:00").cast("timestamp_ntz"))
    )
    return windows.last_satisfying_point(eh(spark, d), SERIES, cond, "ts")


@query(
    "last_satisfying_point",
    f"WITH {EH_SQL}, {POINT_SQL} SELECT kpi, dim_key, last_point FROM pt",
)
def last_satisfying_point(spark, d):
    return last_points(spark, d)


@query(
    "freeze_after",
    f"""WITH {EH_SQL}, {POINT_SQL}, held AS (
      SELECT e.kpi, e.dim_key, p.last_point, e.value AS v FROM eh e JOIN pt p
      ON e.kpi = p.kpi AND e.dim_key = p.dim_key AND e.ts = p.last_point)
    SELECT e.kpi, e.dim_key, e.ts,
           {rsql('CASE WHEN e.ts > h.last_point THEN h.v ELSE e.value END')} AS value
    FROM eh e LEFT JOIN held h ON e.kpi = h.kpi AND e.dim_key = h.dim_key""",
)
def freeze_after(spark, d):
    frozen = windows.freeze_after(eh(spark, d), last_points(spark, d), SERIES, "value", "ts")
    return out(frozen, rnd("value").alias("value"))


@query(
    "sort_curve",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, ts, {rsql('value')} AS value,
       CAST(row_number() OVER (PARTITION BY kpi, dim_key ORDER BY value, ts) AS INT) AS rank
    FROM eh""",
)
def sort_curve(spark, d):
    return out(windows.sort_curve(eh(spark, d), SERIES), rnd("value").alias("value"), "rank")


@query(
    "top1_by_rank",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, ts, {rsql('value')} AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY kpi, dim_key ORDER BY value DESC, ts) AS rn FROM eh)
    WHERE rn = 1""",
)
def top1_by_rank(spark, d):
    best = windows.top1_by_rank(eh(spark, d).withColumn("_s", -F.col("value")), SERIES, "_s", "ts")
    return out(best, rnd("value").alias("value"))


@query(
    "order_series",
    f"WITH {EH_SQL} SELECT kpi, dim_key, ts, {rsql('value')} AS value FROM eh",
)
def order_series(spark, d):
    """Rows ordered inside each series; partition-local, no global sort."""
    ordered = eh(spark, d).repartition(*SERIES).sortWithinPartitions(*SERIES, "ts")
    return out(ordered, rnd("value").alias("value"))
