"""Stateful SPOT over several runs of one checkpoint."""

import datetime as dt

import numpy as np
import pandas as pd

from tidemark.operators import anomaly
from tidemark.streaming import online

START = dt.datetime(2024, 1, 1)
BY = ["kpi", "dim_key", "ts"]


def arrive(spark, path, dim, values, hour):
    rows = [("k", dim, START + dt.timedelta(hours=hour + i), float(v)) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "kpi string, dim_key string, ts timestamp_ntz, value double").write.mode("append").parquet(path)


def drain(spark, tmp, **more):
    stream = online.read_stream(spark, f"{tmp}/in")
    online.run_available(online.stream_spot(stream, n_init=50, q=1e-2, level=0.9, **more), f"{tmp}/out", f"{tmp}/state")
    return spark.read.parquet(f"{tmp}/out").toPandas().sort_values(BY).reset_index(drop=True)


def test_runs_on_one_checkpoint_equal_the_batch_operator(spark, tmp_path):
    values = np.random.default_rng(3).gumbel(0, 1, 260)
    values[200] = 60.0
    hour = 0
    for size in (30, 60, 1, 169):  # the first run ends inside the calibration
        arrive(spark, f"{tmp_path}/in", "d", values[hour : hour + size], hour)
        hour += size
        got = drain(spark, tmp_path)
    whole = spark.read.parquet(f"{tmp_path}/in")
    want = anomaly.spot_run(whole, 50, 1e-2, 0.9).toPandas().sort_values(BY).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)
    assert len(got) == 210 and got.alarm.any() and got.threshold.nunique() > 3


def test_idle_series_lose_their_state(spark, tmp_path):
    rng = np.random.default_rng(4)
    for dim in "ab":
        arrive(spark, f"{tmp_path}/in", dim, rng.normal(0, 1, 60), 0)
    assert drain(spark, tmp_path, idle_hours=100, delay="1 hour").groupby("dim_key").size().to_dict() == {"a": 10, "b": 10}
    arrive(spark, f"{tmp_path}/in", "b", rng.normal(0, 1, 140), 60)
    assert drain(spark, tmp_path, idle_hours=100, delay="1 hour").groupby("dim_key").size().to_dict() == {"a": 10, "b": 150}
    for dim in "ab":
        arrive(spark, f"{tmp_path}/in", dim, rng.normal(0, 1, 55), 200)
    assert drain(spark, tmp_path, idle_hours=100, delay="1 hour").groupby("dim_key").size().to_dict() == {"a": 15, "b": 205}
