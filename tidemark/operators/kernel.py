"""RBF support vector classifier per KPI: grid search, refit and prediction.

The exact dual is solved in one grouped map per KPI over a bounded, hashed sample of its labelled
points (``MAX_ROWS``, a parameter): all folds and gammas come from one pair of squared-difference
matrices of the task. Scoring covers every row: rows of a KPI are cut into chunks of bounded size,
and each chunk meets the KPI's one model row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread

MAX_ROWS = 2000
GAMMAS = (15.0, 25.0, 30.0, 40.0)
CHUNK_ROWS = 50_000
MODEL = (
    "gamma double, mx double, my double, sx double, sy double, bias double, "
    "vx array<double>, vy array<double>, weight array<double>"
)


def solve_dual(kernel: np.ndarray, y: np.ndarray, limit: np.ndarray, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """(alpha, bias) of the soft-margin classifier with labels -1 and 1 and upper bounds ``limit``.

    Pairwise ascent: the row that violates the optimality conditions most, and the partner with the
    largest gain to second order, until no pair violates them by more than ``tol``."""
    alpha = np.zeros(y.size)
    miss = y.astype(float)  # label minus the decision value without bias
    grow, shrink = y > 0, y < 0  # rows whose signed weight may still rise or fall
    diagonal = kernel.diagonal()
    while True:
        i = int(np.argmax(np.where(grow, miss, -np.inf)))
        gain = miss[i] - miss
        if not grow[i] or not shrink.any() or gain[shrink].max() < tol:
            break
        curve = np.maximum(diagonal[i] + diagonal - 2 * kernel[i], 1e-12)
        j = int(np.argmax(np.where(shrink & (gain > 0), gain * gain / curve, -np.inf)))
        step = gain[j] / curve[j]
        for k, room in ((i, limit[i] - alpha[i] if y[i] > 0 else alpha[i]), (j, alpha[j] if y[j] > 0 else limit[j] - alpha[j])):
            step = min(step, room)
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        for k in (i, j):
            if abs(alpha[k]) < 1e-12 * limit[k]:
                alpha[k] = 0.0
            elif abs(alpha[k] - limit[k]) < 1e-12 * limit[k]:
                alpha[k] = limit[k]
            below, above = alpha[k] < limit[k], alpha[k] > 0
            grow[k], shrink[k] = (below, above) if y[k] > 0 else (above, below)
        miss -= step * (kernel[i] - kernel[j])
    edges = [f(miss[s]) for f, s in ((np.max, grow), (np.min, shrink)) if s.any()]
    return alpha, float(np.mean(edges))


class _Points:
    """Labelled points of one KPI with their squared differences per axis."""

    def __init__(self, x: np.ndarray, y: np.ndarray, label: np.ndarray):
        self.at, self.sign = np.column_stack((x, y)), np.where(label == 1, 1.0, -1.0)
        self.square = [np.square(v[:, None] - v[None, :]) for v in (x, y)]

    def fit(self, rows: np.ndarray, gammas: list[float], c: float, on: np.ndarray | None = None) -> list[dict]:
        """One model per gamma from ``rows``, with its hits among the rows ``on``."""
        mean, scale = self.at[rows].mean(axis=0), self.at[rows].std(axis=0)
        scale[scale == 0] = 1.0
        sign = self.sign[rows]
        share = {s: rows.size / (2.0 * max((sign == s).sum(), 1)) for s in (-1.0, 1.0)}
        limit = c * np.where(sign > 0, share[1.0], share[-1.0])
        cross = lambda a: sum(q[np.ix_(a, rows)] / v**2 for q, v in zip(self.square, scale))
        gaps, to = cross(rows), None if on is None else cross(on)
        out = []
        for gamma in gammas:
            alpha, bias = solve_dual(np.exp(-gamma * gaps), sign, limit)
            used = np.flatnonzero(alpha)
            weight = (alpha * sign)[used]
            hits = 0
            if on is not None:
                value = np.exp(-gamma * to[:, used]) @ weight + bias
                hits = int(((value > 0) == (self.sign[on] > 0)).sum())
            vectors = (self.at[rows][used] - mean) / scale
            out.append({
                "gamma": gamma, "mx": mean[0], "my": mean[1], "sx": scale[0], "sy": scale[1], "bias": bias,
                "vx": vectors[:, 0], "vy": vectors[:, 1], "weight": weight, "hits": hits,
            })
        return out


def rbf_svm_grid(
    points: DataFrame,
    gammas: list[float] = GAMMAS,
    folds: int = 5,
    c: float = 1.0,
    min_series: int = 6,
    max_rows: int = MAX_ROWS,
    seed: int = 0,
) -> DataFrame:
    """Per KPI and gamma: kpi, gamma, accuracy over the folds, n, chosen, and on the chosen row the
    model refitted on all sampled rows (other rows hold nulls).

    ``points``: kpi, dim_key, id, x, y, merged (0 or 1). Classes weigh alike, coordinates are
    standardised on the training folds, folds come from a hash of the id, ties go to the smaller
    gamma. Above ``max_rows`` points, about that many of a KPI are drawn by a hash. KPIs of less than
    ``min_series`` series, or of one class, yield no row; points without coordinates are left out."""
    points = points.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND merged IN (0, 1)")
    enough = points.groupBy("kpi").agg(
        F.count("*").alias("_n"), F.countDistinct("dim_key").alias("_series")
    ).filter(F.col("_series") >= min_series)
    draw = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    drawn = (
        points.join(enough, "kpi")
        .filter(draw * F.col("_n") < max_rows)
        .select("kpi", "id", "x", "y", "merged", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(folds)).alias("fold"))
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        data, fold = _Points(*(pdf[name].to_numpy(float) for name in ("x", "y", "merged"))), pdf["fold"].to_numpy()
        both = lambda rows: np.unique(data.sign[rows]).size == 2
        everything = np.arange(len(pdf))
        if not both(everything):
            return pd.DataFrame(columns=names)
        hits, n = np.zeros(len(gammas), np.int64), 0
        for k in range(folds):
            rows, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if held.size and both(rows):
                hits += [m["hits"] for m in data.fit(rows, list(gammas), c, held)]
                n += held.size
        best = min(range(len(gammas)), key=lambda g: (-hits[g], gammas[g]))
        out = [{"gamma": g, "accuracy": h / n if n else None, "n": n, "chosen": False} for g, h in zip(gammas, hits)]
        out[best] |= {"chosen": True} | {k: v for k, v in data.fit(everything, [gammas[best]], c)[0].items() if k != "hits"}
        return pd.DataFrame([{k: None for k in names} | {"kpi": pdf["kpi"].iloc[0]} | r for r in out], columns=names)

    schema = "kpi string, gamma double, accuracy double, n long, chosen boolean, " + MODEL.split(", ", 1)[1]
    names = [f.split(" ")[0] for f in schema.split(", ")]
    return spread(drawn, ["kpi"]).groupBy("kpi").applyInPandas(search, schema)


def rbf_svm_predict(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """``rows`` (kpi, id, x, y) with the decision value and prediction of their KPI's chosen model."""
    models = grid.filter("chosen").select("kpi", *[f.split(" ")[0] for f in MODEL.split(", ")])
    chunks = rows.groupBy("kpi").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("_chunks"))
    dealt = rows.select("kpi", "id", "x", "y").join(chunks, "kpi")
    dealt = dealt.withColumn("chunk", F.expr("pmod(xxhash64(id), _chunks)")).drop("_chunks")
    copies = models.join(chunks, "kpi").withColumn("chunk", F.explode(F.expr("sequence(0L, _chunks - 1)"))).drop("_chunks")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["kpi", "id", "x", "y", "value", "prediction"])
        m = right.iloc[0]
        x, y = (left["x"].to_numpy(float) - m.mx) / m.sx, (left["y"].to_numpy(float) - m.my) / m.sy
        value, step = np.empty(len(left)), max(1, (1 << 22) // max(len(m.weight), 1))
        for lo in range(0, len(left), step):
            part = slice(lo, lo + step)
            gap = np.square(x[part, None] - m.vx) + np.square(y[part, None] - m.vy)
            value[part] = np.exp(-m.gamma * gap) @ m.weight + m.bias
        return left[["kpi", "id", "x", "y"]].assign(value=value, prediction=(value > 0).astype(int))

    kinds = dict(rows.dtypes)
    schema = f"kpi string, id {kinds['id']}, x double, y double, value double, prediction int"
    return dealt.groupBy("kpi", "chunk").cogroup(copies.groupBy("kpi", "chunk")).applyInPandas(score, schema)
