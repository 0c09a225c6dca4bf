"""Operator 7: toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: words and word beginnings. The machine adds a weight per term and, for every pair
of terms, the product of their factor vectors, so a pair such as an insult and a group name can
count for more than both alone. It is trained in numpy on a bounded sample of labelled rows
(``PER_CLASS`` rows and ``PER_CLASS_BYTES`` of text of each label); its penalties are those of ``GRID``
with the least loss on folds of learnable rows, fixed once or chosen again for other labels
(``choose``). Terms are counted in Spark, so only those of ``MIN_DOCS``
sampled documents reach the driver; scoring reads every term of every text.

Edge cases: a null or empty text has no terms and gets the score of the bias; without labels, or
with one label value only, the score is that value's share (0 without labels); labels of a
doc_id that disagree count as toxic if any is; repeated rows get equal results.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import per_text
from tidemark.llm.labelled import hash_bucket, sample_per_class
from tidemark.llm.spaced_seeds import plain_words
from tidemark.llm.words import Texts, mix
from tidemark.session import cut

FACTORS = 4
BEGINNINGS = (4, 5, 6, 7)  # bytes: words that share a stem share these terms
TERM_BITS = 40  # terms are hashed into 2^40 places
MIN_DOCS = 5  # sampled documents a term must be in, whatever its labels
PER_CLASS = 3000
PER_CLASS_BYTES = 32 << 20  # text of the sample of one label
EPOCHS, BATCH, STEPS = 30, 256, 360  # epochs, or as many as make so many steps
ALPHA, BETA, L2 = 0.2, 1.0, 0.01
CLEAR_Z = 4.0  # a term whose own share differs less between the labels has ``dim`` times the penalty
FACTOR_START, FACTOR_RATE, FACTOR_L2 = 0.05, 0.05, 1e-3
MODULUS, HELD_OUT = 5, 0
FOLDS = 3


class Penalties(NamedTuple):
    """L1 of the weights, its multiple for terms without a clear difference, L1 of the factors."""

    l1: float
    dim: float
    factor_l1: float


GRID = tuple(Penalties(a, d, f) for a in (0.4, 0.8, 1.6) for d in (5.0, 20.0, 80.0) for f in (0.4, 1.2, 2.4))
# least loss of the grid on three folds of learnable rows (``fold_losses``); held-out rows had no part
PENALTIES = Penalties(0.8, 20.0, 2.4)


def terms(texts: Texts, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of the distinct hashed terms of every text: words and word beginnings.

    ``known`` holds the sorted places of a model; other terms are then left out early."""
    hasher, words = plain_words(texts)
    gate = None
    if known is not None:
        gate = np.zeros(1 << 20, bool)
        gate[known & ((1 << 20) - 1)] = True
    places, docs = [], []
    for size in (0, *BEGINNINGS):
        start, end, doc = words.start, words.end, words.doc
        if size:
            longer = end - start > size
            start, doc = start[longer], doc[longer]
            end = start + size
        place = (mix(hasher.of(start, end) + np.uint64(size)) >> np.uint64(64 - TERM_BITS)).view(np.int64)
        if gate is not None:
            maybe = np.flatnonzero(gate[place & ((1 << 20) - 1)])
            place, doc = place[maybe], doc[maybe]
        places.append(place)
        docs.append(doc)
    place, doc = np.concatenate(places), np.concatenate(docs)
    _, once = np.unique(place.view(np.uint64) ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
    once = once[np.argsort(doc[once], kind="stable")]
    return place[once], doc[once]


class FactorizationMachine:
    """Logistic factorization machine on binary sparse rows.

    Weights follow per-coordinate proximal steps with an L1 penalty, so most terms get none;
    factors are learned by adaptive gradient steps for all terms from the first epoch."""

    def __init__(self, size: int, factors: int = FACTORS, seed: int = 5):
        self.bias = 0.0
        self.w = np.zeros(size)
        self.v = np.random.default_rng(seed).standard_normal((size, factors)) * FACTOR_START

    def margin(self, flat: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Score of every row before the logistic; ``flat`` are feature numbers, ``row`` theirs."""
        score = self.bias + np.bincount(row, self.w[flat], rows)
        for f in range(self.v.shape[1]):
            x = self.v[flat, f]
            score += 0.5 * (np.bincount(row, x, rows) ** 2 - np.bincount(row, x * x, rows))
        return score

    def fit(
        self,
        flat: np.ndarray,
        first: np.ndarray,
        y: np.ndarray,
        dim: np.ndarray,
        penalties: Penalties,
        epochs: int = EPOCHS,
    ) -> FactorizationMachine:
        rng = np.random.default_rng(13)
        size = self.w.size
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        seen = np.full(self.v.shape, 1e-2)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        least = np.append(np.where(dim, penalties.dim * penalties.l1, penalties.l1), 0.0)
        start = self.bias = float(np.log(share / (1 - share)))
        batches = max(1, y.size // BATCH)
        epochs = max(epochs, STEPS // batches)
        for epoch in range(epochs):
            for pick in np.array_split(rng.permutation(y.size), batches):
                sizes = first[pick + 1] - first[pick]
                row = np.repeat(np.arange(pick.size), sizes)
                at = np.arange(row.size) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[pick], sizes)
                f = flat[at]
                error = 1 / (1 + np.exp(-np.clip(self.margin(f, row, pick.size), -30, 30))) - y[pick]
                # weights and bias: proximal steps with an L1 penalty
                mark = np.zeros(size, bool)
                mark[f] = True
                used = np.flatnonzero(mark)
                g = np.append(np.bincount(f, error[row], size)[used], error.sum()) / BATCH * 16
                slot = np.append(used, size)
                old = np.append(self.w[used], self.bias - start)
                step = (np.sqrt(n[slot] + g * g) - np.sqrt(n[slot])) / ALPHA
                z[slot] += g - step * old
                n[slot] += g * g
                new = -np.sign(z[slot]) * np.maximum(np.abs(z[slot]) - least[slot], 0) / ((BETA + np.sqrt(n[slot])) / ALPHA + L2)
                self.w[used], self.bias = new[:-1], start + float(new[-1])
                for k in range(self.v.shape[1]):
                    x = self.v[f, k]
                    total = np.bincount(row, x, pick.size)
                    g = np.bincount(f, error[row] * (total[row] - x), size)[used] / BATCH * 16
                    g += FACTOR_L2 * self.v[used, k]
                    seen[used, k] += g * g
                    self.v[used, k] -= FACTOR_RATE * g / np.sqrt(seen[used, k])
                # factors that the errors do not call for shrink to nothing, more so every epoch
                long = np.sqrt((self.v[used] ** 2).sum(1))
                less = FACTOR_RATE * penalties.factor_l1 * epoch / epochs / np.sqrt(seen[used].mean(1))
                self.v[used] *= np.maximum(1 - less / np.maximum(long, 1e-12), 0)[:, None]
        return self


class ToxicityModel:
    """The machine with the sorted places of the terms it knows."""

    def __init__(self, places: np.ndarray, machine: FactorizationMachine):
        keep = (machine.w != 0) | machine.v.any(1)
        self.places = places[keep]
        self.machine = FactorizationMachine(0)
        self.machine.bias, self.machine.w, self.machine.v = machine.bias, machine.w[keep], machine.v[keep]

    def score(self, texts: Texts) -> np.ndarray:
        return self.score_terms(*terms(texts, self.places), len(texts.bounds) - 1)

    def score_terms(self, place: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
        at = np.searchsorted(self.places, place)
        at[at == self.places.size] = 0
        known = self.places[at] == place if self.places.size else np.zeros(place.size, bool)
        margin = self.machine.margin(at[known], doc[known], rows)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit_rows(
    rows: list[np.ndarray], y: np.ndarray, penalties: Penalties = PENALTIES
) -> ToxicityModel | float:
    """Model of rows of term places; the constant share if there is one label value only."""
    if not y.size or y.min() == y.max():
        return float(y.mean()) if y.size else 0.0
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    first = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    places, number = np.unique(flat, return_inverse=True)
    positive = np.bincount(number, np.repeat(y, np.diff(first)), places.size)
    count = np.bincount(number, minlength=places.size)
    share = np.clip(count / y.size, 1e-9, 1 - 1e-9)
    spread = np.sqrt(share * (1 - share) * (1 / y.sum() + 1 / (y.size - y.sum())))
    z = np.abs(positive / y.sum() - (count - positive) / (y.size - y.sum())) / spread
    often = count >= least_docs(y.size)
    dim = z < min(CLEAR_Z, np.sqrt(y.size) / 4)
    keep = often[number]
    kept = np.concatenate(([0], np.cumsum(keep)))[first]
    compact = np.cumsum(often) - 1
    machine = FactorizationMachine(int(often.sum())).fit(compact[number[keep]], kept, y, dim[often], penalties)
    return ToxicityModel(places[often], machine)


def least_docs(rows: int) -> float:
    """Documents of a sample of so many that a term must be in."""
    return min(MIN_DOCS, rows / 4)


def fold_losses(rows: list[np.ndarray], y: np.ndarray, grid: tuple[Penalties, ...] = GRID) -> list[float]:
    """Mean log loss of every member of the grid on rows left out in turn, both labels equally heavy.

    Equal rows share a fold, so that copies do not judge themselves."""
    key = np.array([int(mix(np.add.reduce(mix(r.view(np.uint64)), keepdims=True))[0] >> np.uint64(1)) for r in rows])
    fold = key % FOLDS
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(y.size - y.sum(), 1))
    losses = []
    for penalties in grid:
        loss = 0.0
        for k in range(FOLDS):
            out = np.flatnonzero(fold == k)
            if not out.size:
                continue
            learn = np.flatnonzero(fold != k)
            model = fit_rows([rows[i] for i in learn], y[learn], penalties)
            if isinstance(model, float):
                p = np.full(out.size, model)
            else:
                doc = np.repeat(np.arange(out.size), [len(rows[i]) for i in out])
                p = model.score_terms(np.concatenate([rows[i] for i in out]), doc, out.size)
            p = np.clip(p, 1e-6, 1 - 1e-6)
            loss -= float((weight[out] * np.where(y[out] > 0, np.log(p), np.log(1 - p))).sum())
        losses.append(loss)
    return losses


def fit_chosen(rows: list[np.ndarray], y: np.ndarray, grid: tuple[Penalties, ...] = GRID) -> ToxicityModel | float:
    """Model of all rows with the penalties of the least loss on folds (ties: the first)."""
    if not y.size or y.min() == y.max():
        return fit_rows(rows, y)
    return fit_rows(rows, y, grid[int(np.argmin(fold_losses(rows, y, grid)))])


def labelled_terms(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS
) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of term places of the bounded sample of learnable documents, and their labels."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(
        hash_bucket("doc_id", MODULUS) != HELD_OUT
    )
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("_bytes"))
    known = cut(known.join(sizes, "doc_id"))
    known = sample_per_class(known, "toxic", per_class, 2, "_bytes", PER_CLASS_BYTES).select("doc_id", "toxic")
    # at most about 2 * per_class rows of two numbers, whatever the corpus
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def work(texts: Texts) -> dict:
        place, doc = terms(texts)
        first = np.searchsorted(doc, np.arange(len(texts.bounds)))
        return {"terms": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(place))}

    found = per_text(rows, ["doc_id", "toxic"], "text", [("terms", pa.list_(pa.int64()))], lambda: work)
    found = cut(found.withColumn("_row", F.monotonically_increasing_id()))
    each = found.select("_row", F.explode("terms").alias("_place"))
    often = each.groupBy("_place").count().filter(F.col("count") >= least_docs(found.count())).select("_place")
    kept = each.join(often, "_place").groupBy("_row").agg(F.sort_array(F.collect_list("_place")).alias("_kept"))
    got = found.select("_row", "doc_id", "toxic").join(kept, "_row", "left").toArrow()
    order = np.lexsort((got["_row"].to_numpy(), got["doc_id"].to_numpy()))
    lists, y = got["_kept"], got["toxic"].to_numpy().astype(float)[order]
    none = np.empty(0, np.int64)
    return [lists[int(i)].values.to_numpy() if lists[int(i)].is_valid else none for i in order], y


def train(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, choose: bool = False
) -> ToxicityModel | float:
    """Model of the labelled rows outside the held-out fifth; only term hashes of the bounded
    sample reach the driver. ``choose`` takes the penalties from folds of this sample, which takes
    as many fits as ``GRID`` times ``FOLDS``."""
    fit = fit_chosen if choose else fit_rows
    return fit(*labelled_terms(docs, labels, per_class))


def score(docs: DataFrame, model: ToxicityModel | float) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        found = shared.value

        def work(texts: Texts) -> dict:
            n = len(texts.bounds) - 1
            return {"score": np.full(n, found) if isinstance(found, float) else found.score(texts)}

        return work

    out = per_text(docs, ["doc_id"], "text", [("score", pa.float64())], make)
    return out.select(
        "doc_id",
        F.coalesce(hash_bucket("doc_id", MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
