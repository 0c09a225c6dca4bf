"""Queries against their SQL checks on the smallest data set."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, canonical

# One per operator family; `python check.py` compares all of them.
NAMES = [
    "flagship_anomalies", "scan_kpi_csv", "path_pattern_filter", "sink_parquet", "sample_series",
    "kpi_rules_lookup", "week_end_snap", "bearing", "hourly_grid", "hour_by_day_pivot",
    "dedupe_keep_last", "residual_join", "missing_ratio", "describe_numeric", "tie_correction",
    "rolling_quantile", "equal_slices", "freeze_after", "trim_gappy_edges", "interpolate_pchip",
    "interpolate_akima", "welch_seasonality", "ks_two_sample", "acf_max_diff", "trend_features",
    "cv_cutoffs", "forecast_metrics", "repair_trend", "pot_init", "save_load_pipeline", "score_ad",
    "knn_join", "dbscan_eps", "one_sided_outliers", "auc", "association_rules",
    "stream_hourly_kpi", "stream_live_threshold",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf, con, name):
    got = canonical(queries()[name](spark, sf).toPandas())
    want = canonical(con.execute(oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want)


def test_entry(spark):
    assert entry(spark).columns == ["kpi", "dim_key", "ts", "value", "yhat", "z"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
