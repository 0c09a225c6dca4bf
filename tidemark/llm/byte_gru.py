"""Operator 6: language of a text by a bidirectional gated recurrent network over its bytes.

The network reads windows of bytes forwards and backwards and gives every position a
distribution over the languages; a document's score is the mean over all its positions. It is
trained in numpy by backpropagation through time on a bounded sample of labelled documents
(``PER_LANGUAGE``, ``MAX_LANGUAGES``); scoring reads every byte of every text.

Edge cases: a null text or one without any letter is ``und`` with score 0; without labelled rows
everything is ``und``; repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import per_text
from tidemark.llm.labelled import hash_bucket, sample_per_class
from tidemark.llm.words import Texts

HIDDEN = 12
WINDOW = 128  # bytes read in one run; the state starts at zero in each window
PER_LANGUAGE, MAX_LANGUAGES = 400, 64
CUTS = 4  # training windows per sampled document
STEPS, BATCH, RATE = 300, 256, 0.02
MODULUS, HELD_OUT = 3, 1
SLICE = 1 << 19
ROWS = 2048  # windows scored at once
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGRU:
    """Two recurrent directions, one linear layer on both states, softmax per position."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        k, n = hidden, len(classes)
        self.classes = classes
        small = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        # per direction: input table (one row per byte; gates z, r and candidate) and recurrence
        self.w = {f"{p}{d}": small(*s) for d in "fb" for p, s in (("x", (256, 3 * k)), ("h", (k, 3 * k)))}
        self.w["o"] = small(2 * k, n)
        self.w["c"] = np.zeros(n, np.float32)

    def _run(self, data: np.ndarray, live: np.ndarray, direction: str, trace: bool):
        """States (steps x rows x hidden) of one direction; padding leaves the state as it was."""
        table, back = self.w["x" + direction], self.w["h" + direction]
        steps, rows = data.shape
        k = back.shape[0]
        states = np.zeros((steps, rows, k), np.float32)
        kept = [None] * steps
        h = np.zeros((rows, k), np.float32)
        for t in range(steps) if direction == "f" else range(steps - 1, -1, -1):
            x, a = table[data[t]], h @ back
            gates = _sigmoid(x[:, : 2 * k] + a[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            new = np.tanh(x[:, 2 * k :] + r * a[:, 2 * k :])
            after = new + z * (h - new)
            if not live[t].all():
                after = np.where(live[t][:, None], after, h)
            if trace:
                kept[t] = (h, z, r, new, a[:, 2 * k :])
            h = states[t] = after
        return states, kept

    def positions(self, data: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Probabilities (steps x rows x classes) of every position."""
        both = np.concatenate([self._run(data, live, d, False)[0] for d in "fb"], axis=2)
        score = both @ self.w["o"] + self.w["c"]
        score -= score.max(axis=2, keepdims=True)
        np.exp(score, out=score)
        return score / score.sum(axis=2, keepdims=True)

    def gradients(self, data: np.ndarray, live: np.ndarray, label: np.ndarray):
        """Mean cross-entropy over live positions and its gradients."""
        runs = {d: self._run(data, live, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        score = both @ self.w["o"] + self.w["c"]
        score -= score.max(axis=2, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=2, keepdims=True)
        rows = np.arange(label.size)
        count = max(int(live.sum()), 1)
        loss = -(np.log(np.maximum(p[:, rows, label], 1e-12)) * live).sum() / count
        d_score = p
        d_score[:, rows, label] -= 1
        d_score *= (live / count)[:, :, None].astype(np.float32)
        grad = {"o": np.einsum("tsk,tsc->kc", both, d_score, optimize=True), "c": d_score.sum(axis=(0, 1))}
        d_both = d_score @ self.w["o"].T
        steps, k = data.shape[0], self.w["hf"].shape[0]
        for i, d in enumerate("fb"):
            table = np.zeros_like(self.w["x" + d])
            back_t, g_back = self.w["h" + d].T, np.zeros_like(self.w["h" + d])
            d_h = np.zeros((data.shape[1], k), np.float32)
            inputs = np.empty((steps, data.shape[1], 3 * k), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, z, r, new, a = runs[d][1][t]
                d_h = d_h + d_both[t][:, i * k : (i + 1) * k]
                on = live[t][:, None]
                d_new = d_h * (1 - z) * (1 - new * new)
                d_z = d_h * (h - new) * z * (1 - z)
                d_r = d_new * a * r * (1 - r)
                pre = np.concatenate((d_z, d_r, d_new), axis=1) * on
                inputs[t] = pre
                rec = pre.copy()
                rec[:, 2 * k :] *= r
                g_back += h.T @ rec
                d_h = np.where(on, d_h * z + rec @ back_t, d_h)
            np.add.at(table, data.ravel(), inputs.reshape(-1, 3 * k))
            grad["x" + d], grad["h" + d] = table, g_back
        return loss, grad

    def fit(self, data: np.ndarray, live: np.ndarray, label: np.ndarray, steps=STEPS, batch=BATCH, rate=RATE):
        """Adam over random batches of windows (rows x bytes)."""
        rng = np.random.default_rng(11)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, label.size, batch)
            _, grad = self.gradients(data[pick].T, live[pick].T, label[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            now = rate * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                g = g * scale
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                m, s = mean[k] / (1 - 0.9**step), square[k] / (1 - 0.99**step)
                self.w[k] -= (now * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
        return self

    def _half_gates(self, direction: str) -> tuple[np.ndarray, np.ndarray]:
        """Input table and recurrence with features as rows; gates halved, as sigmoid(x) = (tanh(x/2) + 1) / 2."""
        k = self.w["hf"].shape[0]
        half = np.where(np.arange(3 * k) < 2 * k, 0.5, 1.0).astype(np.float32)[:, None]
        return tuple(np.ascontiguousarray(self.w[m + direction].T * half) for m in "xh")

    def summed(self, data: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Sum of the position probabilities of every window (classes x windows).

        ``data`` (steps x windows) holds windows by falling length, ``live[t]`` of which reach step t, so
        padding is never computed. Features are rows, every operation runs in place over the windows,
        and a position's scores are closed as soon as the backward run has passed it."""
        steps, rows = data.shape
        k, n = self.w["hf"].shape[0], len(self.classes)
        x, a, new = (np.empty((m, rows), np.float32) for m in (3 * k, 3 * k, k))
        score, out = np.empty((steps, n, rows), np.float32), np.zeros((n, rows), np.float32)
        for i, d in enumerate("fb"):
            (table, back), top = self._half_gates(d), np.ascontiguousarray(self.w["o"][i * k : (i + 1) * k].T)
            h = np.zeros((k, rows), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                m = int(live[t])
                xt, at, nt, ht = x[:, :m], a[:, :m], new[:, :m], h[:, :m]
                if m == rows:
                    np.take(table, data[t], axis=1, out=x, mode="clip")
                else:
                    xt[:] = table[:, data[t, :m]]
                np.matmul(back, ht, out=at)
                gates = at[: 2 * k]
                gates += xt[: 2 * k]
                np.tanh(gates, out=gates)
                gates += 1.0
                gates *= 0.5
                np.multiply(at[k : 2 * k], at[2 * k :], out=nt)
                nt += xt[2 * k :]
                np.tanh(nt, out=nt)
                ht -= nt
                ht *= at[:k]
                ht += nt
                if d == "f":
                    np.matmul(top, ht, out=score[t, :, :m])
                else:
                    s = score[t, :, :m]
                    s += top @ ht
                    s += self.w["c"][:, None]
                    s -= s.max(axis=0)
                    np.exp(s, out=s)
                    s /= s.sum(axis=0)
                    out[:, :m] += s
        return out

    def pool(self, texts: Texts) -> np.ndarray:
        """Mean position probabilities of every text (rows of zeros for empty texts)."""
        sizes = np.diff(texts.bounds)
        per_text = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(sizes.size), per_text)
        nth = np.arange(doc.size) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        start = texts.bounds[:-1][doc] + nth * WINDOW
        size = np.minimum(WINDOW, texts.bounds[1:][doc] - start)
        longest = np.argsort(-size, kind="stable")
        total = np.zeros((sizes.size, len(self.classes)))
        for lo in range(0, doc.size, ROWS):
            pick = longest[lo : lo + ROWS]
            steps = np.arange(int(size[pick[0]]))[:, None]
            data = texts.data[np.minimum(start[pick] + steps, texts.data.size - 1)]
            p = self.summed(data, (steps < size[pick]).sum(axis=1))
            for c, row in enumerate(p):
                total[:, c] += np.bincount(doc[pick], weights=row, minlength=sizes.size)
        return total / np.maximum(sizes, 1)[:, None]


def training_windows(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.zeros((len(texts), width), np.uint8)
    size = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        raw = t.encode()[:width]
        data[i, : len(raw)] = np.frombuffer(raw, np.uint8)
        size[i] = len(raw)
    return data, np.arange(width)[None, :] < size[:, None]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteGRU | None:
    """Network fitted on labelled rows outside the held-out third; None without such rows."""
    rows = docs.select("doc_id", "text", "lang").filter(
        (hash_bucket("doc_id", MODULUS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    sample = sample_per_class(rows, "lang", per_language, MAX_LANGUAGES)
    # windows from places all over the text, cut in Spark so that only they reach the driver
    place = F.pmod(F.xxhash64("doc_id", "cut"), F.greatest(F.length("text") - WINDOW, F.lit(1)))
    cuts = sample.withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(CUTS)))).select(
        "lang", F.substring("text", (place + 1).cast("int"), F.lit(WINDOW)).alias("t")
    )
    got = cuts.orderBy("lang", "t").toArrow().to_pydict()
    if not got["lang"]:
        return None
    classes = sorted(set(got["lang"]))
    number = {c: i for i, c in enumerate(classes)}
    label = np.array([number[c] for c in got["lang"]])
    # every language is drawn equally often
    rng = np.random.default_rng(3)
    most = np.bincount(label).max()
    even = np.concatenate([rng.choice(np.flatnonzero(label == i), most) for i in range(len(classes))])
    data, live = training_windows(got["t"], WINDOW)
    return ByteGRU(classes).fit(data[even], live[even], label[even])


def predict(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        net = shared.value

        def work(texts: Texts) -> dict:
            n = len(texts.bounds) - 1
            if net is None:
                return {"lang_pred": [UNKNOWN] * n, "score": np.zeros(n)}
            p = net.pool(texts)
            best = p.argmax(axis=1)
            word = [_LETTER.search(texts.text(i).decode("utf-8", "replace")) is not None for i in range(n)]
            return {
                "lang_pred": [net.classes[b] if w else UNKNOWN for b, w in zip(best.tolist(), word)],
                "score": np.where(word, np.clip(p[np.arange(n), best], 0, 1), 0.0),
            }

        return work

    out = per_text(docs, ["doc_id"], "text", [("lang_pred", pa.string()), ("score", pa.float64())], make, SLICE)
    return out.select(
        "doc_id", F.coalesce(hash_bucket("doc_id", MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
