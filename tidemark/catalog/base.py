"""Query registry and the shared inputs the queries and their SQL checks start from."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import hourly_wide, to_long
from tidemark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = [
    "base_slice",
    "source_queries",
    "scalar_queries",
    "table_queries",
    "window_queries",
    "quality_queries",
    "stat_queries",
    "forecast_queries",
    "anomaly_queries",
    "cluster_queries",
    "learning_queries",
    "stream_queries",
]


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the DuckDB statement it must agree with."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"tidemark.catalog.{module}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nudge(digits: int) -> float:
    """Far below the last kept digit: moves exact decimal halves off the rounding boundary,
    where two engines that sum in different orders may fall on different sides."""
    return float(f"3.7e-{digits + 4}")


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Round for comparison; adding 0.0 turns a negative zero into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(nudge(digits)), digits) + F.lit(0.0)


def rsql(expr: str, digits: int = 6) -> str:
    shifted = f"CAST({expr} AS DOUBLE) + CAST('{nudge(digits)!r}' AS DOUBLE)"
    return f"(round({shifted}, {digits}) + CAST(0 AS DOUBLE))"


KPIS = ["value_wmean", "value_sum", "value_sample"]

# Rules of the three KPIs derived from the events table.
EH_RULES = [
    ("value_wmean", 0.0, 100.0, "max"),
    ("value_sum", 0.0, float("inf"), "max"),
    ("value_sample", 0.0, 6.0, "min"),
]
RULES_SQL = """rules(kpi, lower, upper, bad_direction) AS (VALUES
  ('value_wmean', CAST(0 AS DOUBLE), CAST(100 AS DOUBLE), 'max'),
  ('value_sum', CAST(0 AS DOUBLE), CAST('inf' AS DOUBLE), 'max'),
  ('value_sample', CAST(0 AS DOUBLE), CAST(6 AS DOUBLE), 'min'))"""


def eh_wide(spark: SparkSession, d: str) -> DataFrame:
    return hourly_wide(table(spark, d, "events").select("event_type", "ts", "value"), "event_type")


def eh(spark: SparkSession, d: str) -> DataFrame:
    """Hourly KPI table derived from the events."""
    return to_long(eh_wide(spark, d), KPIS)


EHW_SQL = """ehw AS (
  SELECT event_type AS dim_key, date_trunc('hour', ts) AS ts,
         round(avg(value), 9) AS value_wmean, round(sum(value), 9) AS value_sum,
         CAST(count(*) AS DOUBLE) AS value_sample
  FROM events GROUP BY 1, 2)"""
EH_SQL = (
    EHW_SQL
    + """,
eh AS (
  SELECT 'value_wmean' AS kpi, dim_key, ts, value_wmean AS value FROM ehw
  UNION ALL SELECT 'value_sum', dim_key, ts, value_sum FROM ehw
  UNION ALL SELECT 'value_sample', dim_key, ts, value_sample FROM ehw)"""
)
# Hourly spine per series from its first to its last row.
GRID_SQL = (
    EH_SQL
    + """,
span AS (SELECT kpi, dim_key, min(ts) AS lo, max(ts) AS hi FROM eh GROUP BY 1, 2),
spine AS (
  SELECT kpi, dim_key, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span),
grid AS (
  SELECT s.kpi, s.dim_key, s.ts, e.value
  FROM spine s LEFT JOIN eh e ON s.kpi = e.kpi AND s.dim_key = e.dim_key AND s.ts = e.ts)"""
)


def grid(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.reshape import hourly_grid

    return hourly_grid(eh(spark, d))
