"""Projections, filters and scalar functions."""

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    EH_RULES,
    EH_SQL,
    GRID_SQL,
    RULES_SQL,
    eh,
    eh_wide,
    grid,
    query,
    rnd,
    rsql,
    table,
)
from tidemark.functions import geometry, scalar
from tidemark.operators import joins
from tidemark.schema import KPI_RULE, kpi_rules

LONG = f"SELECT kpi, dim_key, ts, {rsql('value')} AS value"


def long_out(df):
    return df.select("kpi", "dim_key", "ts", rnd("value").alias("value"))


@query(
    "epoch_to_ts",
    """SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS epoch_s,
       date_trunc('second', ts) AS ts FROM events""",
)
def epoch_to_ts(spark, d):
    seconds = scalar.ts_to_epoch(F.col("ts"))
    return table(spark, d, "events").select(
        "event_id", seconds.alias("epoch_s"), scalar.epoch_to_ts(seconds).alias("ts")
    )


@query(
    "parse_ts",
    """SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'),
       '%Y-%m-%d %H:%M:%S') AS ts FROM orders""",
)
def parse_ts(spark, d):
    text = scalar.format_ts(F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", scalar.parse_ts(text).alias("ts"))


@query(
    "dim_filter",
    f"WITH {EH_SQL} {LONG} FROM eh WHERE dim_key = 'error' AND kpi = 'value_sum'",
)
def dim_filter(spark, d):
    return long_out(scalar.dim_filter(eh(spark, d), {"dim_key": "error", "kpi": "value_sum"}))


@query("drop_null_kpi", f"WITH {GRID_SQL} {LONG} FROM grid WHERE value IS NOT NULL")
def drop_null_kpi(spark, d):
    return long_out(grid(spark, d).na.drop(subset=["value"]))


@query(
    "drop_null_key",
    f"""WITH {EH_SQL}, keyed AS (
      SELECT kpi, nullif(dim_key, 'error') AS dim_key, ts, value FROM eh)
    {LONG} FROM keyed WHERE dim_key IS NOT NULL""",
)
def drop_null_key(spark, d):
    keyed = eh(spark, d).withColumn("dim_key", F.nullif("dim_key", F.lit("error")))
    return long_out(keyed.filter(F.col("dim_key").isNotNull()))


@query(
    "time_range",
    f"""WITH {EH_SQL} {LONG} FROM eh
    WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-14 23:00:00'""",
)
def time_range(spark, d):
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-08 00:00:00", "2024-01-14 23:00:00"))
    return long_out(scalar.time_range(eh(spark, d), lo, hi))


@query(
    "route_filter",
    f"""WITH {EH_SQL}, meta AS (
      SELECT kpi, dim_key, '4weeks-' || kpi || '.csv' AS path,
             CASE WHEN stddev_samp(value) > avg(value) THEN 'non_seasonal_trend'
                  ELSE 'seasonal_prophet' END AS model_type
      FROM eh GROUP BY 1, 2)
    SELECT kpi, dim_key, model_type FROM meta
    WHERE model_type = 'seasonal_prophet' AND path = '4weeks-value_sum.csv'""",
)
def route_filter(spark, d):
    meta = eh(spark, d).groupBy("kpi", "dim_key").agg(
        F.when(F.stddev_samp("value") > F.avg("value"), "non_seasonal_trend")
        .otherwise("seasonal_prophet")
        .alias("model_type"),
        F.concat(F.lit("4weeks-"), F.first("kpi"), F.lit(".csv")).alias("path"),
    )
    return scalar.dim_filter(
        meta, {"model_type": "seasonal_prophet", "path": "4weeks-value_sum.csv"}
    ).select("kpi", "dim_key", "model_type")


@query(
    "prune_low_info",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, CAST(count(value) AS BIGINT) AS n,
       {rsql('stddev_samp(value)')} AS std
    FROM eh GROUP BY 1, 2 HAVING stddev_samp(value) <> 0 AND count(value) > 1""",
)
def prune_low_info(spark, d):
    return (
        eh(spark, d)
        .groupBy("kpi", "dim_key")
        .agg(F.count("value").alias("n"), F.stddev_samp("value").alias("std"))
        .filter("std <> 0 AND n > 1")
        .select("kpi", "dim_key", "n", rnd("std").alias("std"))
    )


@query(
    "trailing_window",
    f"""WITH {EH_SQL} {LONG} FROM eh
    WHERE ts >= (SELECT max(ts) FROM eh) - INTERVAL 7 DAY""",
)
def trailing_window(spark, d):
    return long_out(joins.trailing_window(eh(spark, d)))


@query(
    "fill_zero",
    f"""WITH {GRID_SQL} SELECT kpi, dim_key, ts, {rsql('coalesce(value, 0)')} AS value FROM grid""",
)
def fill_zero(spark, d):
    return grid(spark, d).select(
        "kpi", "dim_key", "ts", rnd(scalar.fill_zero(F.col("value"))).alias("value")
    )


@query(
    "clip_bounds",
    f"""WITH {EH_SQL}, {RULES_SQL}
    SELECT e.kpi, e.dim_key, e.ts,
           {rsql('greatest(least(e.value * 1.5 - 20, r.upper), r.lower)')} AS value
    FROM eh e JOIN rules r ON e.kpi = r.kpi""",
)
def clip_bounds(spark, d):
    rules = spark.createDataFrame(EH_RULES, KPI_RULE)
    shifted = F.col("value") * 1.5 - 20
    return (
        eh(spark, d)
        .join(F.broadcast(rules), "kpi")
        .select(
            "kpi", "dim_key", "ts",
            rnd(scalar.clip(shifted, F.col("lower"), F.col("upper"))).alias("value"),
        )
    )


@query(
    "is_weekday",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, ts, isodow(ts) < 6 AS weekday, isodow(ts) >= 6 AS weekend
    FROM eh""",
)
def is_weekday(spark, d):
    flag = scalar.is_weekday(F.col("ts"))
    return eh(spark, d).select("kpi", "dim_key", "ts", flag.alias("weekday"), (~flag).alias("weekend"))


@query(
    "calendar_parts",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, ts, CAST(hour(ts) AS INT) AS hour,
       CAST(dayofyear(ts) AS INT) AS doy FROM eh""",
)
def calendar_parts(spark, d):
    return eh(spark, d).select(
        "kpi", "dim_key", "ts", F.hour("ts").alias("hour"), F.dayofyear("ts").alias("doy")
    )


@query(
    "week_end_snap",
    """SELECT event_id, date_trunc('week', ts) + INTERVAL 7 DAY AS window_end,
       date_trunc('week', ts) - INTERVAL 21 DAY AS window_start,
       date_trunc('week', ts) AS last_week_start FROM events""",
)
def week_end_snap(spark, d):
    window = scalar.analysis_window(scalar.ts_to_epoch(F.col("ts")))
    return table(spark, d, "events").select(
        "event_id", *[c.alias(n) for n, c in window.items()]
    )


@query(
    "to_numeric",
    f"""SELECT event_id, TRY_CAST(props->>'k' AS DOUBLE) AS k,
       TRY_CAST(event_type AS DOUBLE) AS type_number FROM events""",
)
def to_numeric(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select(
        "event_id",
        scalar.to_numeric(k).alias("k"),
        scalar.to_numeric(F.col("event_type")).alias("type_number"),
    )


@query(
    "kpi_rules_lookup",
    f"""WITH {EH_SQL}, r(kpi, lower, upper, bad_direction) AS (VALUES
      ('rtt_net_wmean', CAST(0 AS DOUBLE), CAST('inf' AS DOUBLE), 'max'),
      ('rsrp_wmean', CAST(-140 AS DOUBLE), CAST(-43 AS DOUBLE), 'min'))
    SELECT n.kpi, n.dim_key, n.ts, {rsql('n.value')} AS value, r.lower, r.upper, r.bad_direction
    FROM (SELECT CASE kpi WHEN 'value_wmean' THEN 'rtt_net_wmean' WHEN 'value_sum' THEN 'rsrp_wmean'
                 ELSE kpi END AS kpi, dim_key, ts, value FROM eh) n JOIN r ON n.kpi = r.kpi""",
)
def kpi_rules_lookup(spark, d):
    """KPI names outside the rule table drop out of the inner join."""
    named = eh(spark, d).replace(
        {"value_wmean": "rtt_net_wmean", "value_sum": "rsrp_wmean"}, subset=["kpi"]
    )
    return named.join(F.broadcast(kpi_rules(spark)), "kpi").select(
        "kpi", "dim_key", "ts", rnd("value").alias("value"), "lower", "upper", "bad_direction"
    )


@query(
    "parse_dim",
    "SELECT event_id, props->>'k' AS k, CAST(1 AS INT) AS n_dims FROM events",
)
def parse_dim(spark, d):
    dim = scalar.parse_dim(F.col("props"))
    return table(spark, d, "events").select(
        "event_id", dim["k"].alias("k"), F.size(dim).alias("n_dims")
    )


@query(
    "dim_key",
    f"""WITH {EH_SQL} SELECT kpi, ts, 'event_type_weekday' AS dim_names,
       dim_key || '_' || CAST(isodow(ts) AS VARCHAR) AS dim_key FROM eh""",
)
def dim_key(spark, d):
    dim = F.create_map(
        F.lit("event_type"), F.col("dim_key"),
        F.lit("weekday"), (F.weekday("ts") + 1).cast("string"),
    )
    return eh(spark, d).select(
        "kpi", "ts", scalar.dim_names(dim).alias("dim_names"), scalar.dim_values(dim).alias("dim_key")
    )


@query(
    "format_ts",
    f"WITH {EH_SQL} SELECT kpi, dim_key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ds FROM eh",
)
def format_ts(spark, d):
    return eh(spark, d).select("kpi", "dim_key", scalar.format_ts(F.col("ts")).alias("ds"))


@query(
    "rename_columns",
    f"WITH {EH_SQL} SELECT kpi, dim_key, ts AS ds, {rsql('value')} AS kpivalue FROM eh",
)
def rename_columns(spark, d):
    return long_out(eh(spark, d)).withColumnsRenamed({"ts": "ds", "value": "kpivalue"})


HAV = """2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a))"""
POINTS = """p AS (SELECT dim_key, ts, hour(ts) * 7.5 AS lon1, value_wmean / 4 AS lat1,
         value_sample * 3.0 - 60 AS lon2, 45 - value_sample AS lat2 FROM ehw)"""


def lonlat(spark, d):
    return eh_wide(spark, d).select(
        "dim_key", "ts",
        (F.hour("ts") * 7.5).alias("lon1"), (F.col("value_wmean") / 4).alias("lat1"),
        (F.col("value_sample") * 3.0 - 60).alias("lon2"), (45 - F.col("value_sample")).alias("lat2"),
    )


@query(
    "haversine_distance",
    f"""WITH {EH_SQL}, {POINTS}, h AS (
      SELECT dim_key, ts, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1))
             * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2) AS a FROM p)
    SELECT dim_key, ts, {rsql(HAV, 3)} AS metres FROM h""",
)
def haversine_distance(spark, d):
    m = geometry.haversine_distance(*[F.col(c) for c in ("lon1", "lat1", "lon2", "lat2")])
    return lonlat(spark, d).select("dim_key", "ts", rnd(m, 3).alias("metres"))


BEARING = """degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)),
  cos(radians(lat1)) * sin(radians(lat2))
  - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) - 90"""


@query(
    "bearing",
    f"""WITH {EH_SQL}, {POINTS}, b AS (SELECT dim_key, ts, {BEARING} AS h FROM p)
    SELECT dim_key, ts, {rsql('h - 360 * floor(h / 360)')} AS heading FROM b""",
)
def bearing(spark, d):
    h = geometry.bearing(*[F.col(c) for c in ("lon1", "lat1", "lon2", "lat2")], F.lit(90.0))
    return lonlat(spark, d).select("dim_key", "ts", rnd(h).alias("heading"))


@query(
    "rotate_2d",
    f"""WITH {EH_SQL}
    SELECT dim_key, ts, {rsql('value_sum * cos(pi() / 4) + value_wmean * sin(pi() / 4)')} AS x,
           {rsql('value_wmean * cos(pi() / 4) - value_sum * sin(pi() / 4)')} AS y FROM ehw""",
)
def rotate_2d(spark, d):
    x, y = geometry.rotate_2d(F.col("value_sum"), F.col("value_wmean"), F.pi() / 4)
    return eh_wide(spark, d).select("dim_key", "ts", rnd(x).alias("x"), rnd(y).alias("y"))


@query(
    "min_max_scale",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, ts, {rsql('''(value - min(value) OVER w)
       / (max(value) OVER w - min(value) OVER w)''')} AS value
    FROM eh WINDOW w AS (PARTITION BY kpi, dim_key)""",
)
def min_max_scale(spark, d):
    span = eh(spark, d)
    low_high = span.groupBy("kpi", "dim_key").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi")
    )
    scaled = F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return span.join(low_high, ["kpi", "dim_key"]).select(
        "kpi", "dim_key", "ts", rnd(scaled).alias("value")
    )
