"""Closed-form values, brute-force comparisons and invariants."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import special
from tidemark.operators import anomaly, cluster, neighbors, quality, ranking, reshape, stattests
from tidemark.operators import forecast as fc
from tidemark.operators.learning import fp_growth
from tidemark.plans import forecasting, pipelines
from tidemark.schema import SERIES, kpi_rule_rows

START = dt.datetime(2024, 1, 1)


def series(spark, values, kpi="k", dim="d"):
    rows = [
        (kpi, dim, START + dt.timedelta(hours=i), None if v is None else float(v))
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "kpi string, dim_key string, ts timestamp_ntz, value double")


def test_rule_table_sizes():
    rows = kpi_rule_rows()
    assert sum(r[1] is not None for r in rows) == 205
    assert sum(r[3] is not None for r in rows) == 203
    assert len({r[0] for r in rows}) == len(rows)


def test_zscore_closed_form(spark):
    fit = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 7.0)], "k string, residual double")
    p = anomaly.zscore_fit(fit, ["k"])
    mu, sigma = p.select("mu", "sigma").first()
    assert (mu, sigma) == (pytest.approx(11 / 3), pytest.approx(2.4944, abs=1e-4))
    new = spark.createDataFrame([("a", 2.0), ("a", 25.0)], "k string, residual double")
    flags = lambda t: sorted(
        (r.residual, r.is_anomaly) for r in anomaly.zscore_predict(new, p, ["k"], threshold=t).collect()
    )
    assert flags(9.0) == [(2.0, False), (25.0, False)]
    assert flags(3.0) == [(2.0, False), (25.0, True)]


def test_scaler_closed_form(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, 1), (2, 7, 3), (3, 9, 7)], "id long, test long, value long")
    steps = [{"step": "StandardScaler", "column": c, "params": [{"key": "copy", "value": "True"}]}
             for c in ("test", "value")]
    pipe = pipelines.build_pipeline({"steps": steps})
    pipelines.save_pipeline(pipe, str(tmp_path / "p"))
    model = pipelines.load_pipeline(str(tmp_path / "p"), trained=False).fit(df)
    pipelines.save_pipeline(model, str(tmp_path / "m"))
    out = pipelines.load_pipeline(str(tmp_path / "m"), trained=True).transform(df)
    assert out.columns[-1] == "id"
    got = {r.id: (r.test, r.value) for r in out.collect()}
    assert got[1] == (pytest.approx(-1.2247, abs=1e-4), pytest.approx(-1.0690, abs=1e-4))
    assert got[3] == (pytest.approx(1.2247, abs=1e-4), pytest.approx(1.3363, abs=1e-4))


def test_elbow_and_knee(spark):
    up = [(float(i), float(2 ** max(0, i - 8))) for i in range(14)]
    df = spark.createDataFrame([("c", x, y) for x, y in up], "k string, x double, y double")
    assert abs(quality.elbow_point(df, ["k"], "x", "y").first().x - 11) <= 1
    down = [(float(i), 100.0 - 3.0 ** max(0, i - 7) / 7.3) for i in range(13)]
    df = spark.createDataFrame([("c", x, y) for x, y in down], "k string, x double, y double")
    assert quality.elbow_point(df, ["k"], "x", "y", knee=True).first().x >= 6


def test_interpolation_keeps_known_points_and_stays_monotone(spark):
    values = [1, 2, None, None, 4, 9, None, 9.5, None, 20, 21]
    for method in ("pchip", "akima", "linear"):
        out = [r.value for r in quality.interpolate(series(spark, values), method).orderBy("ts").collect()]
        assert all(o == v for o, v in zip(out, values, strict=True) if v is not None)
        assert all(o is not None for o in out)
        if method != "akima":
            assert all(b >= a for a, b in zip(out, out[1:], strict=False))


def test_outlier_is_replaced_and_raw_kept(spark):
    y = [10 + math.sin(i / 3) for i in range(200)]
    y[100] = 500.0
    out = {r.ds: r for r in quality.extract_series(series(spark, y)).collect()}
    hit = out[START + dt.timedelta(hours=100)]
    assert hit.ytop == 500.0 and abs(hit.y - 10) < 20
    other = out[START + dt.timedelta(hours=20)]
    assert other.y == pytest.approx(other.ytop)


def test_smoother_reproduces_a_line():
    y = 3 + 0.5 * np.arange(300)
    assert np.allclose(quality.smooth_values(y), y)


def test_tail_probabilities():
    assert special.beta_inc(2.0, 3.0, 0.4) == pytest.approx(0.5248)
    assert special.gamma_upper(1.0, 2.0) == pytest.approx(math.exp(-2))
    assert special.gamma_upper(11.5, 35.172 / 2) == pytest.approx(0.05, abs=1e-4)
    # two samples of 3 and 3 fully apart: 2 of the C(6,3) = 20 orders are as extreme
    assert special.ks_probability(1.0, 3, 3) == pytest.approx(0.1)


def test_exact_quantiles_sliced(spark):
    rng = np.random.default_rng(0)
    v = np.round(rng.lognormal(0, 2, 5000), 2)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 1.0)] * 7, "k string, v double")
    probs = {"q1": 0.1, "q5": 0.5, "q975": 0.975}
    for slice_rows in (100, 10**9):
        got = {r.k: r for r in ranking.exact_quantiles(df, ["k"], "v", probs, slice_rows).collect()}
        for n, p in probs.items():
            assert got["a"][n] == pytest.approx(np.quantile(v, p))
            assert got["b"][n] == 1.0


def brute_knn(q, p, k, metric):
    out = {}
    for qi, qx, qy in q:
        d = [
            (abs(qx - x) + abs(qy - y) if metric == "manhattan" else math.sqrt((qx - x) ** 2 + (qy - y) ** 2), i)
            for i, x, y in p
        ]
        out[qi] = sorted(d)[:k]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("tile", [1024, 8])
def test_knn_matches_brute_force(spark, monkeypatch, metric, tile):
    """Small tiles force the strip, run and box search; a third of the points coincide."""
    monkeypatch.setattr(neighbors, "TILE", tile)
    rng = np.random.default_rng(1)
    xy = np.round(rng.normal(0, 1, (300, 2)), 2)
    xy[:100] = (0.5, 0.5)
    xy[100:150, 1] = 0.0
    p = [(f"p{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(xy)]
    q = [(f"q{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 2, (60, 2)))] + p[::7]
    schema = "kpi string, id string, x double, y double"
    pts = spark.createDataFrame([("k", *r) for r in p], schema)
    qs = spark.createDataFrame([("k", *r) for r in q], schema)
    got = {}
    for r in neighbors.knn_join(qs, pts, ["kpi"], 5, metric).collect():
        got.setdefault(r.id, []).append((r["rank"], r.distance, r.neighbor))
    for qi, best in brute_knn(q, p, 5, metric).items():
        mine = sorted(got[qi])
        assert [m[2] for m in mine] == [b[1] for b in best]
        assert [m[1] for m in mine] == pytest.approx([b[0] for b in best])


def brute_dbscan(p, eps, m):
    near = {i: [j for j, x, y in p if math.hypot(x - a, y - b) <= eps] for i, a, b in p}
    core = {i for i in near if len(near[i]) >= m}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if label.get(j) is None:
                label[j] = i
                stack += [c for c in near[j] if c in core and c not in label]
    return core, label


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_dbscan_matches_brute_force(spark, partitions):
    rng = np.random.default_rng(2)
    xy = np.vstack([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (2, 2), (0, 3))] + [rng.uniform(-3, 6, (30, 2))])
    p = [(f"p{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(xy)]
    pts = spark.createDataFrame([("k", *r) for r in p], "kpi string, id string, x double, y double")
    eps = spark.createDataFrame([("k", 0.35)], "kpi string, eps double")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.id: r.label for r in cluster.dbscan(pts, eps).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    core, label = brute_dbscan(p, 0.35, 5)
    at = {i: (x, y) for i, x, y in p}
    for i, *_ in p:
        if i in core:
            assert got[i] == label[i]
        else:
            reach = [(math.dist(at[i], at[c]), c) for c in core if math.dist(at[i], at[c]) <= 0.35]
            assert got[i] == (label[min(reach)[1]] if reach else "-1")


def test_connected_components_of_a_long_path(spark):
    n = 200
    order = np.random.default_rng(3).permutation(n)
    edges = [("k", f"n{a:03d}", f"n{b:03d}") for a, b in zip(order, order[1:], strict=False)]
    e = spark.createDataFrame(edges, "kpi string, u string, v string")
    nodes = spark.createDataFrame([("k", f"n{i:03d}") for i in range(n)] + [("k", "z")], "kpi string, node string")
    roots = {r.node: r.root for r in neighbors.connected_components(nodes, e, ["kpi"]).collect()}
    assert {roots[f"n{i:03d}"] for i in range(n)} == {"n000"} and roots["z"] == "z"


@pytest.mark.parametrize("tile", [8, 1024])
def test_hull_boundary_is_the_rim(spark, monkeypatch, tile):
    """Rings of points: the outer ring is the boundary, whatever the tiles."""
    monkeypatch.setattr(neighbors, "TILE", tile)
    turns = np.linspace(0, 2 * math.pi, 24, endpoint=False)
    rows = [("k", "c", f"r{r}-{i:02d}", r * math.cos(a + r), r * math.sin(a + r)) for r in range(1, 6) for i, a in enumerate(turns)]
    rows += [("k", "c", "r1-00b", *rows[0][3:]), ("k", "two", "a", 0.0, 0.0), ("k", "two", "b", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "kpi string, label string, id string, x double, y double")
    out = cluster.hull_boundary(df).toPandas()
    assert {f"r5-{i:02d}" for i in range(24)} <= set(out.id) and set(out.label) == {"c"}
    assert not {i for i in out.id if i[:2] in ("r2", "r3")}


def test_days_of_two_years_stay_apart(spark):
    ts = [dt.datetime(y, 3, d, h) for y in (2023, 2024) for d in (1, 2) for h in range(24)]
    df = spark.createDataFrame([("k", "s", t, float(i % 29)) for i, t in enumerate(ts)], "kpi string, dim_key string, ts timestamp_ntz, value double")
    assert reshape.hour_by_day_pivot(df).count() == 4
    assert stattests.friedman_test(df).first().n_days == 4


def test_smote_reaches_the_ratio(spark):
    rng = np.random.default_rng(6)
    rows = [("k", f"a{i:03d}", *map(float, rng.normal(0, 1, 2)), 1) for i in range(100)]
    rows += [("k", f"b{i:03d}", *map(float, rng.normal(5, 0.1, 2)), 0) for i in range(13)]
    df = spark.createDataFrame(rows, "kpi string, id string, x double, y double, merged int")
    out = cluster.smote(df, 0.6).toPandas()
    few = out[out.merged == 0]
    assert len(few) == 60 and few.id.is_unique
    assert few.x.between(4, 6).all() and few.y.between(4, 6).all()


def test_gpd_recovers_the_tail():
    u = (np.arange(1, 4001) - 0.5) / 4000
    gamma, sigma = 0.3, 2.0
    g, s = anomaly.grimshaw(sigma / gamma * ((1 - u) ** -gamma - 1))
    assert (g, s) == (pytest.approx(gamma, abs=0.05), pytest.approx(sigma, abs=0.1))
    g, s = anomaly.grimshaw(-np.log(1 - u) * 3)
    assert abs(g) < 0.05 and s == pytest.approx(3, abs=0.1)


def test_spot_guards_and_alarm(spark):
    assert anomaly.extreme_quantile(1.0, np.array([]), 10, 1e-3) == np.inf
    assert anomaly.grimshaw(np.array([2.0, 2.0]))[0] == 0.0
    rng = np.random.default_rng(7)
    v = rng.normal(0, 1, 600)
    v[400] = 40.0
    out = anomaly.spot_run(series(spark, v), n_init=200, q=1e-3, level=0.95).toPandas()
    assert len(out) == 400
    assert out.loc[out.alarm, "value"].tolist().count(40.0) == 1
    assert (out.threshold > np.sort(v[:200])[190]).all()


def test_stream_spot_equals_batch(spark, sf):
    from tidemark.catalog import QUERIES

    a = QUERIES["stream_spot"](spark, sf).toPandas()
    b = QUERIES["spot_run"](spark, sf).toPandas()
    by = ["kpi", "dim_key", "ts"]
    a, b = (x.sort_values(by).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)


def test_forecaster_recovers_trend_and_season(spark):
    h = 24 * 28
    y = [50 + 0.02 * i + 10 * math.sin(2 * math.pi * i / 24) for i in range(h)]
    hist = series(spark, y).withColumnsRenamed({"ts": "ds", "value": "y"})
    grid = [{"p_id": "x", "changepoint_prior_scale": 0.05}]
    out = fc.predict_forecaster(fc.make_future(hist), fc.fit_forecaster(hist, grid)).toPandas()
    out = out.sort_values("ds").reset_index(drop=True)
    assert len(out) == h + 168
    i = np.arange(len(out))
    truth = 50 + 0.02 * i + 10 * np.sin(2 * np.pi * i / 24)
    assert np.abs(out.yhat - truth).max() < 1.0


def test_trend_plan_stays_inside_bounds(spark):
    y = [20 - 0.03 * i for i in range(24 * 28)]
    hist = series(spark, y, kpi="value_wmean").withColumnsRenamed({"ts": "ds", "value": "y"})
    rules = spark.createDataFrame([("value_wmean", 0.0, 100.0, "max")], "kpi string, lower double, upper double, bad_direction string")
    metrics = forecasting.tune(hist, forecasting.TREND_FIT_GRID)
    out = forecasting.forecast_trend(hist, metrics, rules).toPandas()
    assert out.pred.between(0, 100).all() and len(out) == 24 * 28 + 168


def test_fp_growth_counts(spark):
    df = spark.createDataFrame([(0, [1, 2, 5]), (1, [1, 2, 3, 5]), (2, [1, 2])], "id int, items array<int>")
    model = fp_growth(df, 0.5, 0.6)
    got = {tuple(sorted(r["items"])): r.freq for r in model.freqItemsets.collect()}
    assert got == {(1,): 3, (2,): 3, (5,): 2, (1, 2): 3, (1, 5): 2, (2, 5): 2, (1, 2, 5): 2}
    assert model.associationRules.count() == 9


def test_series_key_is_kept(spark):
    out = pipelines.apply_per_series(
        series(spark, [1, 2, 3]), lambda p: p.assign(n=len(p))[["kpi", "dim_key", "n"]].head(1),
        "kpi string, dim_key string, n long",
    )
    assert out.select(*SERIES, "n").first() == ("k", "d", 3)
    assert out.filter(F.col("n") == 3).count() == 1
