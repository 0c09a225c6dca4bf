"""Streaming queries: each drains its source with availableNow and returns what was written."""

from pyspark.sql import functions as F

from tidemark.catalog.anomaly_queries import AD_SQL
from tidemark.catalog.base import EH_SQL, eh, query, rnd, rsql, table
from tidemark.operators.anomaly import zscore_fit
from tidemark.operators.baseline import apply_profile, seasonal_profile
from tidemark.operators.joins import residual_join
from tidemark.schema import SERIES
from tidemark.session import cut, scratch_path
from tidemark.streaming import online

CUT = "2024-01-16 00:00:00"


@query(
    "stream_hourly_kpi",
    f"""SELECT event_type AS dim_key, date_trunc('hour', ts) AS ts, {rsql('sum(value)')} AS value_sum,
      {rsql('avg(value)')} AS value_wmean, CAST(count(*) AS DOUBLE) AS value_sample FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
    GROUP BY 1, 2""",
)
def stream_hourly_kpi(spark, d):
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    out, state = scratch_path(spark, "hourly"), scratch_path(spark, "state")
    online.run_available(online.stream_hourly_kpi(events, "event_type"), out, state)
    return spark.read.parquet(out).select(
        "dim_key", "ts", rnd("value_sum").alias("value_sum"),
        rnd("value_wmean").alias("value_wmean"), "value_sample",
    )


def arrivals(kpi, path, part):
    """One arrival of rows; each series sits in one file, so its time order is kept."""
    before = F.col("ts") < F.lit(CUT).cast("timestamp_ntz")
    rows = kpi.filter(before if part == 0 else ~before)
    rows.repartition(*SERIES).write.mode("append").parquet(path)


def static_model(kpi):
    profile = seasonal_profile(kpi)
    forecast = apply_profile(kpi.select(*SERIES, "ts"), profile)
    params = zscore_fit(residual_join(kpi, forecast, [*SERIES, "ts"], y="value"))
    return cut(forecast), cut(params)


STREAM_AD = AD_SQL.replace("(value - mean) / std AS v", "value AS v")


@query(
    "stream_score_ad",
    f"""WITH {STREAM_AD} SELECT kpi, dim_key, ts, {rsql('value')} AS value, {rsql('z')} AS z
    FROM zs WHERE abs(z) > 3""",
)
def stream_score_ad(spark, d):
    kpi = cut(eh(spark, d))
    forecast, params = static_model(kpi)
    source = scratch_path(spark, "arrivals")
    arrivals(kpi, source, 0)
    arrivals(kpi, source, 1)
    out, state = scratch_path(spark, "scored"), scratch_path(spark, "state")
    stream = online.read_stream(spark, source)
    online.run_available(online.stream_score_ad(stream, forecast, params), out, state)
    return spark.read.parquet(out).select(*SERIES, "ts", rnd("value").alias("value"), rnd("z").alias("z"))


@query("stream_spot")
def stream_spot(spark, d):
    """Two arrivals drained in one run; equals the batch operator (see tests)."""
    kpi = cut(eh(spark, d))
    source = scratch_path(spark, "arrivals")
    arrivals(kpi, source, 0)
    arrivals(kpi, source, 1)
    out, state = scratch_path(spark, "spot"), scratch_path(spark, "state")
    stream = online.read_stream(spark, source)
    online.run_available(online.stream_spot(stream, 168, 1e-3, 0.9), out, state)
    return spark.read.parquet(out).select(
        *SERIES, "ts", rnd("value").alias("value"), rnd("threshold", 4).alias("threshold"), "alarm"
    )


@query(
    "stream_live_threshold",
    f"""WITH {STREAM_AD} SELECT kpi, dim_key, ts, {rsql('z')} AS z,
      CASE WHEN ts < TIMESTAMP '{CUT}' THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS threshold
    FROM zs WHERE abs(z) > CASE WHEN ts < TIMESTAMP '{CUT}' THEN 3 ELSE 2 END""",
)
def stream_live_threshold(spark, d):
    """The control table changes from 3 to 2 between two arrivals of the same stream."""
    kpi = cut(eh(spark, d))
    forecast, params = static_model(kpi)
    source, control = scratch_path(spark, "arrivals"), scratch_path(spark, "control")
    out, state = scratch_path(spark, "scored"), scratch_path(spark, "state")
    kpis = kpi.select("kpi").distinct()
    for part, limit in enumerate((3.0, 2.0)):
        kpis.withColumn("threshold", F.lit(limit)).write.mode("overwrite").parquet(control)
        arrivals(kpi, source, part)
        online.score_with_live_threshold(
            online.read_stream(spark, source), forecast, params,
            lambda s: s.read.parquet(control), out, state,
        )
    return spark.read.parquet(out).select(*SERIES, "ts", rnd("z").alias("z"), "threshold")


@query(
    "stream_append_fit",
    f"""WITH {EH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY kpi, dim_key ORDER BY ts) AS rn FROM eh)
    SELECT kpi, dim_key, ts, {rsql('value')} AS value FROM r WHERE rn > 168""",
)
def stream_append_fit(spark, d):
    """A second run on the same checkpoint goes on after the calibration of the first."""
    kpi = cut(eh(spark, d))
    source = scratch_path(spark, "arrivals")
    out, state = scratch_path(spark, "spot"), scratch_path(spark, "state")
    for part in (0, 1):
        arrivals(kpi, source, part)
        stream = online.read_stream(spark, source)
        online.run_available(online.stream_spot(stream, 168, 1e-3, 0.9), out, state)
    return spark.read.parquet(out).select(*SERIES, "ts", rnd("value").alias("value"))
