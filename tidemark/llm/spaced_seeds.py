"""Operator 3: benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words at the positions a fixed mask marks; positions the mask leaves
out may differ, so a passage with substituted words still shares seeds. Training seeds that
cannot be in the benchmark are dropped by a Bloom filter of the benchmark's seeds (its size
follows the benchmark and is bounded); the rest is joined to the benchmark seeds, and around each
hit the aligned words are compared.

Words are compared lower-cased (A-Z) and without trailing ASCII punctuation. An item in which one
substituted word could hide every seed of the masks gets the ``SHORT_MASKS`` as well. An item
shorter than the shortest mask but of at least ``MIN_WORDS`` words must match whole and is
searched as one run; shorter items are never found.

Edge cases: null and empty texts share nothing; null item ids or doc_ids are carried; repeated
rows give one result row per (doc_id, item_id); empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import lean
from tidemark.llm.words import Hasher, Texts, Words, mix, slices, split
from tidemark.session import cut

MASKS = ("11111111", "110101100111", "111001101011", "1010110011011")
SHORT_MASKS = ("100011111", "111110001", "111101111")  # with the run of 8: for items of 9 words or more
MIN_WORDS = 5
CONTEXT = 64  # words kept on both sides of a hit for the comparison
MATCHED_WORDS = 8  # a shorter item must match whole
MISMATCH_COST = 2.0  # so at least two thirds of the aligned words agree
BITS_PER_SEED, MIN_BITS, MAX_BITS = 32, 1 << 20, 1 << 30
PROBES = (0, 17, 34)  # first bits of the three addresses in a hash

_PUNCT = np.zeros(256, bool)
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def plain_words(texts: Texts) -> tuple[Hasher, Words]:
    """Words without the punctuation behind them, and a hasher that ignores case; words of
    punctuation only are left out."""
    words = split(texts)
    end = words.end.copy()
    while True:
        cut_off = _PUNCT[texts.data[end - 1]] & (end > words.start) if end.size else np.zeros(0, bool)
        if not cut_off.any():
            break
        end -= cut_off
    some = end > words.start
    first = np.searchsorted(np.flatnonzero(some), words.first)
    kept = Words(words.start[some], end[some], words.doc[some], first)
    return Hasher(texts.data, True), kept


def word_hashes(texts: Texts) -> tuple[np.ndarray, Words]:
    hasher, words = plain_words(texts)
    return hasher.of(words.start, words.end), words


def seeds(hashes: np.ndarray, doc: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(seed, position of its first word) for every place of the mask inside a text."""
    n = hashes.size - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.full(n, np.uint64(int(mask, 2) * 2 + len(mask)))
    factor = 0x9E3779B97F4A7C15
    for j, used in enumerate(mask):
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
        if used == "1":
            total += hashes[j : j + n] * np.uint64(factor)
    at = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :])
    return mix(total[at]), at


def _survives(masks: list[str], n: int) -> bool:
    """Whether any one substituted word of n leaves a seed of the masks."""
    left = [{at + j for j, c in enumerate(m) if c == "1"} for m in masks for at in range(n - len(m) + 1)]
    return all(any(p not in used for used in left) for p in range(n))


def masks_for(n: int) -> list[str]:
    """Masks that search an item of n words."""
    if n < MIN_WORDS:
        return []
    masks = [m for m in MASKS if len(m) <= n] or ["1" * n]
    for m in SHORT_MASKS:
        if len(m) <= n and not _survives(masks, n):
            masks.append(m)
    return masks


def _list(values: np.ndarray, bounds) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """One row per item with its words, and one per seed: (item_id, n, at, seed, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, texts in slices(batch.column(1)):
                hashes, words = word_hashes(texts)
                sizes = np.diff(words.first)
                rows = {"item": [], "at": [], "seed": []}
                for n in np.unique(sizes):
                    items = np.flatnonzero(sizes == n)
                    member = np.isin(words.doc, items)
                    where = np.flatnonzero(member)
                    for mask in masks_for(int(n)):
                        seed, at = seeds(hashes[member], words.doc[member], mask)
                        rows["seed"].append(seed)
                        rows["item"].append(words.doc[where[at]])
                        rows["at"].append(where[at] - words.first[words.doc[where[at]]])
                count = len(sizes)
                item = np.concatenate((np.arange(count), *rows["item"])).astype(np.int64)
                total = item.size
                bounds = np.concatenate((words.first, np.full(total - count, words.first[-1])))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(item + lo)),
                        pa.array(sizes[item], pa.int64()),
                        pa.array(np.concatenate((np.zeros(count), *rows["at"])).astype(np.int64)),
                        pa.array([None] * count + np.concatenate((np.empty(0, np.uint64), *rows["seed"])).view(np.int64).tolist(), pa.int64()),
                        _list(hashes, bounds),
                    ],
                    ["item_id", "n", "at", "seed", "words"],
                )

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(
        run, f"item_id {kind}, n bigint, at bigint, seed bigint, words array<bigint>"
    )


class Bloom:
    """Bit array of hashes; its size is fixed by the number of hashes and ``MAX_BITS``."""

    def __init__(self, bits: int, words: np.ndarray):
        self.mask, self.words = np.uint64(bits - 1), words

    @staticmethod
    def _probe(i: int, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(PROBES[i])

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """Positions of hashes that may be in the set."""
        left = np.arange(h.size)
        for i in range(len(PROBES)):
            at = self._probe(i, h[left]) & self.mask
            hit = self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
            left = left[hit.view(np.int64) == 1]
        return left

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Bloom:
        """Built by Spark: bits are set per 64-bit word in an aggregate; the driver receives at
        most ``MAX_BITS / 64`` words."""
        n = df.count()
        bits = min(max(MIN_BITS, 1 << (BITS_PER_SEED * max(n, 1) - 1).bit_length()), MAX_BITS)
        probes = F.array(*[
            F.shiftrightunsigned(column, p).bitwiseAND(F.lit(bits - 1)) for p in PROBES
        ])
        at = df.select(F.explode(probes).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("b")
        )
        got = words.toArrow()
        table = np.zeros(bits >> 6, np.uint64)
        if got.num_rows:
            table[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
        return cls(bits, table)


def candidate_regions(docs: DataFrame, bloom: Bloom, masks: list[str]) -> DataFrame:
    """Seeds of the documents that may be in the benchmark, and the words around them.

    Hits of a text closer than ``CONTEXT`` share a region. One row per region carries its words;
    one row per hit carries the seed and its place in the region."""
    shared = docs.sparkSession.sparkContext.broadcast((int(bloom.mask) + 1, bloom.words))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Bloom(*shared.value)
        for batch in batches:
            for lo, _, texts in slices(batch.column(1)):
                hashes, words = word_hashes(texts)
                seed, at = [], []
                for mask in masks:
                    s, a = seeds(hashes, words.doc, mask)
                    hit = held.may_hold(s)
                    seed.append(s[hit])
                    at.append(a[hit])
                seed, at = np.concatenate(seed), np.concatenate(at)
                if not seed.size:
                    continue
                order = np.argsort(at, kind="stable")
                seed, at = seed[order], at[order]
                doc = words.doc[at]
                new = np.append(True, (np.diff(at) > CONTEXT) | (np.diff(doc) != 0))
                region = np.cumsum(new) - 1
                first = np.flatnonzero(new)
                last = np.append(first[1:], at.size) - 1
                lows = np.maximum(at[first] - CONTEXT, words.first[doc[first]])
                highs = np.minimum(at[last] + 2 * CONTEXT, words.first[doc[first] + 1])
                cuts = np.concatenate(([0], np.cumsum(highs - lows)))
                inside = np.concatenate([hashes[a:b] for a, b in zip(lows, highs)])
                prints = np.add.reduceat(inside * (np.arange(inside.size, dtype=np.uint64) - np.repeat(cuts[:-1], highs - lows).astype(np.uint64) + np.uint64(1)), cuts[:-1])
                key = mix(prints).view(np.int64)
                count = first.size
                owner = np.concatenate((np.arange(count), region))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[owner]),
                        batch.column(0).take(pa.array(doc[first][owner] + lo)),
                        pa.array(np.concatenate((lows - words.first[doc[first]], at - lows[region]))),
                        pa.array([None] * count + seed.view(np.int64).tolist(), pa.int64()),
                        _list(inside, np.concatenate((cuts, np.full(seed.size, cuts[-1])))),
                    ],
                    ["region", "doc_id", "place", "seed", "words"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        lean(run), f"region bigint, doc_id {kind}, place bigint, seed bigint, words array<bigint>"
    )


def align(region: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(matched words, aligned words, first aligned word of the item) where ``region[i + shift]`` is
    compared with ``item[i]``: of the whole item, if it lies there and at least two thirds of its words
    and ``MATCHED_WORDS`` agree; else of the best stretch, of equal ones the longest."""
    lo, hi = max(0, -shift), min(item.size, region.size - shift)
    if hi <= lo:
        return 0, 0, lo
    same = region[lo + shift : hi + shift] == item[lo:hi]
    matched = int(same.sum())
    if same.size == item.size and matched >= MATCHED_WORDS and matched >= MISMATCH_COST * (same.size - matched):
        return matched, same.size, lo
    run = np.concatenate(([0.0], np.cumsum(np.where(same, 1.0, -MISMATCH_COST))))
    low = np.minimum.accumulate(run)
    fresh = np.append(True, run[1:] < low[:-1])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(run.size), 0))
    ends = np.flatnonzero(run - low == (run - low).max())
    end = int(ends[np.argmax(ends - begin[ends])])
    start = int(begin[end])
    return int(same[start:end].sum()), end - start, lo + start


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps, the best per pair: (doc_id, item_id, matched, aligned, item_words,
    doc_word); ``doc_word`` is the place of the overlap among the document's compared words."""
    items = cut(benchmark_seeds(benchmark))
    seed = items.filter("seed IS NOT NULL").select("seed", "item_id", "at")
    # longer items need no masks but MASKS: a run of 8 survives any one substitution
    sizes = items.filter(F.col("seed").isNull() & F.col("n").between(MIN_WORDS, 2 * len(MASKS[0])))
    extra = {m for r in sizes.select("n").distinct().collect() for m in masks_for(r.n)}
    masks = [*MASKS, *sorted(extra - set(MASKS))]
    found = cut(candidate_regions(docs, Bloom.of(seed, "seed"), masks))
    hits = found.filter("seed IS NOT NULL").select("region", "place", "seed")
    lines = (
        hits.join(seed, "seed")
        .select("region", "item_id", (F.col("place") - F.col("at")).alias("shift"))
        .distinct()
    )
    regions = found.filter("seed IS NULL").select("region", "words").dropDuplicates(["region"])
    whole = items.filter("seed IS NULL").select("item_id", "n", F.col("words").alias("item"))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    compared = (
        lines.join(regions, "region")
        .join(whole, lines["item_id"].eqNullSafe(whole["item_id"]))
        .select("region", lines["item_id"], "shift", "words", "item")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, item = batch.column(3), batch.column(4)
            got = [
                (*align(words[i].values.to_numpy(), item[i].values.to_numpy(), s), len(item[i]), s)
                for i, s in enumerate(batch.column(2).to_pylist())
            ]
            keep = [i for i, g in enumerate(got) if g[0] >= min(MATCHED_WORDS, g[3])]
            column = lambda f: pa.array([f(got[i]) for i in keep], pa.int64())
            pick = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick), column(lambda g: g[0]),
                 column(lambda g: g[1]), column(lambda g: g[3]), column(lambda g: g[2] + g[4])],
                ["region", "item_id", "matched", "aligned", "item_words", "inside"],
            )

    checked = compared.mapInArrow(
        verify, f"region bigint, item_id {kind}, matched bigint, aligned bigint, item_words bigint, inside bigint"
    )
    owners = found.filter("seed IS NULL").select("region", "doc_id", F.col("place").alias("base")).distinct()
    best = F.max(F.struct("matched", (-F.col("aligned")).alias("a"), (-F.col("base") - F.col("inside")).alias("p"), "item_words"))
    return (
        checked.join(owners, "region")
        .groupBy("doc_id", "item_id")
        .agg(best.alias("b"))
        .select(
            "doc_id", "item_id", F.col("b.matched").alias("matched"), (-F.col("b.a")).alias("aligned"),
            F.col("b.item_words").alias("item_words"), (-F.col("b.p")).alias("doc_word"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any verified overlap, columns unchanged."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
