"""Kernel classifier and rule prediction against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernel
from tidemark.operators.learning import fp_growth, rule_predict


def blobs(n, seed):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 1, (n, 2))
    sign = np.where(np.hypot(*at.T) + rng.normal(0, 0.2, n) > 1.1, 1.0, -1.0)
    return at, sign


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dual_solution_is_optimal(seed):
    """The primal and the dual value meet, so no better classifier exists."""
    at, y = blobs(150, seed)
    k = np.exp(-2.0 * np.square(at[:, None] - at[None]).sum(axis=2))
    limit = np.where(y > 0, 0.7, 3.0)
    alpha, bias = kernel.solve_dual(k, y, limit, tol=1e-6)
    assert (alpha >= 0).all() and (alpha <= limit).all() and abs(alpha @ y) < 1e-9
    w = alpha * y
    norm = w @ k @ w
    primal = norm / 2 + limit @ np.maximum(0, 1 - y * (k @ w + bias))
    assert primal - (alpha.sum() - norm / 2) < 1e-3 * primal


def test_dual_matches_a_grid_of_feasible_points():
    at, y = np.array([[0.0, 0], [1, 0], [0, 1]]), np.array([1.0, -1, -1])
    k = np.exp(-np.square(at[:, None] - at[None]).sum(axis=2))
    limit = np.array([1.0, 0.6, 0.9])
    alpha, _ = kernel.solve_dual(k, y, limit, tol=1e-9)
    value = lambda a: sum(a) - (np.array(a) * y) @ k @ (np.array(a) * y) / 2
    steps = np.linspace(0, 1, 61)
    best = max(value((b * limit[1] + c * limit[2], b * limit[1], c * limit[2])) for b, c in itertools.product(steps, steps) if b * limit[1] + c * limit[2] <= limit[0])
    assert value(alpha) >= best - 1e-6


def points(spark, kpi, n, seed, dims=6):
    at, sign = blobs(n, seed)
    rows = [(kpi, f"d{i % dims}", f"{kpi}/{i}", float(a), float(b), int(s > 0)) for i, ((a, b), s) in enumerate(zip(at, sign))]
    return spark.createDataFrame(rows, "kpi string, dim_key string, id string, x double, y double, merged int")


def test_grid_refit_and_prediction_of_all_kpis(spark, monkeypatch):
    odd = spark.createDataFrame(
        [("a", "d0", "nan", float("nan"), 0.0, 1), ("a", "d0", "null", None, 0.0, 1)],
        "kpi string, dim_key string, id string, x double, y double, merged int",
    )
    few, one = points(spark, "few", 40, 5, dims=2), points(spark, "one", 40, 6).withColumn("merged", F.lit(1))
    pts = points(spark, "a", 400, 3).union(points(spark, "b", 300, 4)).union(odd).union(few).union(one)
    grid = kernel.rbf_svm_grid(pts, gammas=[0.5, 2.0, 300.0], max_rows=350).cache()
    rows = grid.drop("vx", "vy", "weight").toPandas()
    assert sorted(rows.kpi.unique()) == ["a", "b"] and rows.groupby("kpi").chosen.sum().eq(1).all()
    assert rows[rows.kpi == "b"].n.eq(300).all() and rows[rows.kpi == "a"].n.between(280, 400).all()
    best = rows[rows.chosen].set_index("kpi")
    assert (best.accuracy > 0.8).all() and (best.gamma < 300).all()
    assert (rows.sort_values("accuracy").groupby("kpi").accuracy.last() == best.accuracy.sort_index()).all()
    monkeypatch.setattr(kernel, "CHUNK_ROWS", 50)
    fresh = points(spark, "a", 500, 9).select("kpi", "id", "x", "y", "merged")
    out = kernel.rbf_svm_predict(fresh, grid).join(fresh.select("id", "merged"), "id").toPandas()
    assert len(out) == 500 and (out.prediction == out.merged).mean() > 0.8
    m = grid.filter("chosen AND kpi = 'a'").first()
    for r in out.head(20).itertuples():
        x, y = (r.x - m.mx) / m.sx, (r.y - m.my) / m.sy
        value = sum(w * np.exp(-m.gamma * ((x - u) ** 2 + (y - v) ** 2)) for w, u, v in zip(m.weight, m.vx, m.vy)) + m.bias
        assert r.value == pytest.approx(value)


def test_rule_predict_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, sorted({rng.choice("aaaabbbccdef") for _ in range(rng.randrange(1, 6))})) for i in range(200)]
    df = spark.createDataFrame([*rows, (900, []), (901, None)], "id int, items array<string>")
    rules = fp_growth(df.filter("items IS NOT NULL"), 0.02, 0.3).associationRules
    known = [(set(r.antecedent), set(r.consequent)) for r in rules.collect()]
    assert max(len(a) for a, _ in known) > 1
    got = {r.id: r.prediction for r in rule_predict(df, rules, "id").collect()}
    want = {i: sorted(set().union(*[c for a, c in known if a <= set(x) and not c & set(x)])) for i, x in rows}
    assert got == {**want, 900: [], 901: []}
