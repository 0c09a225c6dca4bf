"""The forecaster's fit and cross-validation against plain computation."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast as fc
from tidemark.plans import forecasting

START = dt.datetime(2023, 1, 1)


def history(spark, values, dim="d", start=START):
    rows = [("value_wmean", dim, start + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "kpi string, dim_key string, ds timestamp_ntz, y double")


@pytest.mark.parametrize("seed", range(6))
def test_sparse_mode_meets_the_optimality_conditions(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (60, 20)) @ rng.normal(0, 1, (20, 20))
    y = x[:, :4] @ [3.0, -2, 1, 0.5] + rng.normal(0, 1, 60)
    a, b = x.T @ x + 1e-8 * np.eye(20), x.T @ y
    weight = np.where(np.arange(20) < 3, 0.0, [1.0, 40, 200, 900, 5, 60][seed])
    c = fc.sparse_mode(a, b, weight, np.zeros(20))
    slope, scale = a @ c - b, np.abs(b).max()
    assert np.abs((slope + weight * np.sign(c))[(c != 0) | (weight == 0)]).max() < 1e-6 * scale
    assert (np.abs(slope) <= weight + 1e-6 * scale)[c == 0].all()
    again = fc.sparse_mode(a, b, weight, rng.normal(0, 1, 20))  # from elsewhere
    assert np.allclose(c, again, atol=1e-6)


def test_season_matrices_equal_the_columns(spark):
    rows = [(START + dt.timedelta(hours=31 * i),) for i in range(1200)]
    got = fc.with_season(spark.createDataFrame(rows, "ds timestamp_ntz")).toPandas()
    made = fc.season_matrices(got["ds"])
    for weekend, column in ((False, "_plain"), (True, "_split")):
        assert np.allclose(made[weekend], np.stack(got[column]), atol=1e-9)


def test_one_bend_leaves_few_changes(spark):
    """Of 25 possible changes a tight prior leaves those around the bend; a wide one leaves more."""
    bend, rng = 24 * 14, np.random.default_rng(1)
    values = [100 + 0.02 * i + (0.2 * (i - bend) if i > bend else 0) + float(rng.normal(0, 2)) for i in range(24 * 28)]
    h = history(spark, values)
    models = fc.fit_forecaster(h, forecasting.TREND_FIT_GRID).cache()
    zeros = {}
    for m in models.collect():
        deltas, cps = np.array(m.deltas), np.array(m.cps) * m.span
        prior = float(m.p_id.split(" ")[0][4:])
        zeros.setdefault(prior, []).append((deltas == 0).sum())
        if prior == 0.01:
            assert deltas.sum() == pytest.approx(0.2 * 24 * m.span, rel=0.1)
            assert deltas @ cps / deltas.sum() == pytest.approx(14, abs=0.5)
    assert min(zeros[0.01]) >= 20 > min(zeros[0.1]) >= 12 > max(zeros[1.0]) > 0
    last = forecasting.changepoint_of(models, h, ["kpi", "dim_key"], ["p_id"]).toPandas()
    assert len(last) == 9
    tight = last[last.p_id.str.startswith("cps=0.01")].last_changepoint
    assert ((tight - START).dt.total_seconds() / 86400).sub(14).abs().max() <= 1.2


def test_chosen_sets_are_the_ones_of_the_grid(spark):
    h = history(spark, [10 + math.sin(i / 4) + i / 100 for i in range(400)])
    p_id = forecasting.SEASONAL_GRID[5]["p_id"]
    chosen = spark.createDataFrame([("value_wmean", "d", p_id)], "kpi string, dim_key string, p_id string")
    one = fc.fit_forecaster(h, forecasting.SEASONAL_GRID, chosen=chosen).collect()
    assert one == fc.fit_forecaster(h, forecasting.SEASONAL_GRID).filter(F.col("p_id") == p_id).collect()


@pytest.mark.parametrize("grid", [forecasting.TREND_FIT_GRID[:2], forecasting.SEASONAL_GRID[20:22]])
def test_cross_validation_equals_fits_on_cut_histories(spark, grid):
    rng = np.random.default_rng(2)
    values = [50 + 5 * math.sin(i / 3.8) + 0.01 * i + rng.normal() for i in range(24 * 20)]
    values[100] = None
    h = history(spark, values)
    cuts = [(START + dt.timedelta(days=x), 24) for x in (15, 17, 40)]
    cutoffs = spark.createDataFrame([("value_wmean", "d", *c) for c in cuts], "kpi string, dim_key string, cutoff timestamp_ntz, horizon int")
    got = fc.cross_validate(h, cutoffs, grid).toPandas()
    assert got.cutoff.nunique() == 2  # nothing lies behind the last
    for cutoff, hours in cuts[:2]:
        models = fc.fit_forecaster(h.filter(F.col("ds") <= F.lit(cutoff)), grid)
        ahead = h.filter((F.col("ds") > F.lit(cutoff)) & (F.col("ds") <= F.lit(cutoff + dt.timedelta(hours=hours))))
        want = fc.predict_forecaster(ahead, models).toPandas().sort_values(["p_id", "ds"])
        have = got[got.cutoff == pd.Timestamp(cutoff)].sort_values(["p_id", "ds"])
        assert len(have) == 48 and np.allclose(have.yhat, want.yhat, atol=1e-6) and list(have.ds) == list(want.ds)


def test_saved_pipeline_carries_its_forecaster(spark, tmp_path):
    from tidemark.plans import pipelines

    h = history(spark, [10 + math.sin(i / 4) + i / 100 for i in range(300)])
    trained = pipelines.build_pipeline({"step": "Prophet", "params": {"changepoint_prior_scale": "0.1"}}).fit(h)
    want = trained.transform(h).select("ds", "yhat").orderBy("ds").collect()
    pipelines.save_pipeline(trained, f"{tmp_path}/saved")
    source = trained.stages[0].getOrDefault("modelPath")
    loaded = pipelines.load_pipeline(f"{tmp_path}/saved", trained=True)
    assert loaded.stages[0].getOrDefault("modelPath") != source and loaded.stages[0].uid == trained.stages[0].uid
    trained.stages[0]._set(modelPath=f"{tmp_path}/gone")
    assert loaded.transform(h).select("ds", "yhat").orderBy("ds").collect() == want
    with pytest.raises(ValueError):
        loaded.stages[0].write().overwrite().save(loaded.stages[0].getOrDefault("modelPath").removesuffix("/coefficients"))
