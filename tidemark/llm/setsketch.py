"""Operator 5: near-duplicate documents by SetSketch registers.

A document is the set of its distinct 5-word shingles. Register i keeps the truncated, exponentially
spaced minimum of the i-th hash of the set: ``floor(1 - log_b(min / a))`` of exponential variates.
Sketches merge by the element-wise maximum. Bands of register values give candidates; the joint
likelihood of two sketches estimates their similarity; pairs that may reach the threshold are
confirmed on the full sets.

Rows that could grow with a group of copies are kept linear: equal sets are one class before any
comparison, and a bucket first only links its members to one leader. Buckets that then still
hold several components are compared further in blocks of bounded size: sketches tell which
members may be linked to another component, full sets decide, and a block returns only links
that join components.

Edge cases: null and empty texts (or texts without words) have no shingles and are linked with
nothing; 1 to 4 words make one shingle; repeated rows fall in one component; an empty table gives
an empty result; a null doc_id takes the component of its class but is never the kept one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import per_text
from tidemark.llm.words import Hasher, Texts, mix, nonempty_rows, split, windows
from tidemark.operators.neighbors import connected_components
from tidemark.session import cut

SHINGLE = 5
PERCENT = 75
REGISTERS = 120
BAND = 5
DEALS = 3  # the registers are dealt into bands so many times, in different orders
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
# 4.5 standard deviations of the estimate (at the threshold) below it
ESTIMATE_FROM = PERCENT / 100 - 4.5 * (PERCENT * (100 - PERCENT) / 1e4 / REGISTERS) ** 0.5
BLOCK = 1024  # sketches compared in one block (two blocks meet in a group)
BLOCK_SHINGLES = 1 << 17  # shingles of the sets compared in one block
BAND_BITS = 7  # the low bits of a band key are the number of its band

_SEED = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = (_SEED[:REGISTERS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (_SEED[REGISTERS:] >> np.uint64(32)).astype(np.uint32)
BANDS = np.concatenate(
    [
        np.argsort(mix(np.arange(REGISTERS, dtype=np.uint64) + np.uint64(1000 * (d + 1)))).reshape(-1, BAND)
        for d in range(DEALS)
    ]
)


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, text) of all shingles of a slice, grouped by text, repeats included."""
    words = split(texts)
    hashes = Hasher(texts.data, True).of(words.start, words.end)
    found, at = windows(hashes, words, SHINGLE)
    sizes = np.diff(words.first)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    whole = sizes[short].astype(np.uint64)
    for j in range(SHINGLE - 1):
        has = sizes[short] > j
        whole[has] = mix(whole[has] * np.uint64(0x9E3779B97F4A7C15) + hashes[words.first[short[has]] + j])
    values = np.concatenate((found, whole))
    doc = np.concatenate((words.doc[at], short))
    order = np.argsort(doc, kind="stable")
    return values[order], doc[order]


def registers(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers (rows x REGISTERS) of the sets ``values[first[i]:first[i + 1]]``, none empty."""
    h = (values >> np.uint64(32)).astype(np.uint32)
    lows = np.empty((REGISTERS, first.size - 1), np.uint32)
    room = np.empty_like(h)
    for i in range(REGISTERS):
        np.multiply(h, _FACTOR[i], out=room)
        np.add(room, _SHIFT[i], out=room)
        lows[i] = np.minimum.reduceat(room, first[:-1])
    uniform = (lows.astype(np.float64) + 0.5) / 2.0**32
    exponential = -np.log1p(-uniform) / RATE
    level = np.floor(1 - np.log(exponential) / np.log(BASE))
    return np.clip(level, 0, TOP + 1).astype(np.uint16).T


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketched sets (row by row) of known sizes that maximises the joint
    likelihood of how many registers are larger, smaller and equal."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = most * np.linspace(0, 1, 129)[None, :-1]
    chance = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    up, down = chance(u - v * j), chance(v - u * j)
    tiny = 1e-300
    value = (
        larger[:, None] * np.log(np.maximum(up, tiny))
        + smaller[:, None] * np.log(np.maximum(down, tiny))
        + equal[:, None] * np.log(np.maximum(1 - up - down, tiny))
    )
    best = j[np.arange(len(j)), value.argmax(axis=1)]
    return np.where(equal == a.shape[1], 1.0, best)


def set_fingerprint(distinct: np.ndarray) -> int:
    """Fingerprint of one set of distinct shingles."""
    return int(mix(np.add.reduce(_spread(distinct), keepdims=True)).view(np.int64)[0])


def _spread(shingle: np.ndarray) -> np.ndarray:
    return mix(shingle ^ np.uint64(0x5851F42D4C957F2D))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (fingerprint of the set, null if empty) and registers."""

    def work(texts: Texts) -> dict:
        n = len(texts.bounds) - 1
        values, doc = shingles(texts)
        _, once = np.unique(values ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
        once.sort()
        sizes = np.bincount(doc[once], minlength=n)
        first = np.concatenate(([0], np.cumsum(sizes)))
        some = nonempty_rows(first)
        ids, sketches = [None] * n, [None] * n
        if some.size:
            distinct = values[once]
            starts = first[:-1][some]
            sums = np.add.reduceat(_spread(distinct), starts)
            rows = registers(distinct, np.append(starts, distinct.size))
            for i, s, r in zip(some.tolist(), mix(sums).view(np.int64).tolist(), rows):
                ids[i], sketches[i] = s, r.tobytes()
        return {"n_shingles": sizes, "set_id": ids, "registers": sketches}

    fields = [("n_shingles", pa.int64()), ("set_id", pa.int64()), ("registers", pa.binary())]
    return per_text(docs, ["doc_id"], "text", fields, lambda: work)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def band_keys(classes: DataFrame) -> DataFrame:
    """(band key, set_id): one row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                regs = _matrix(part.column(1)).astype(np.uint64)
                keys = np.empty((len(BANDS), len(regs)), np.uint64)
                for i, band in enumerate(BANDS):
                    key = np.full(len(regs), np.uint64(i + 1))
                    for r in band:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, r])
                    keys[i] = key >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | np.uint64(i)
                sets = np.tile(part.column(0).to_numpy(), len(BANDS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(sets)], ["key", "set_id"]
                )

    return classes.select("set_id", "registers").mapInArrow(run, "key bigint, set_id bigint")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow the threshold."""
    side = lambda n: classes.select(
        F.col("set_id").alias(n), F.col("n_shingles").alias(f"n_{n}"), F.col("registers").alias(f"r_{n}")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                n_a, n_b = (part.column(c).to_numpy() for c in (2, 4))
                j = similarity(_matrix(part.column(3)), _matrix(part.column(5)), n_a, n_b)
                keep = (j >= ESTIMATE_FROM) & (100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b))
                yield part.select([0, 1]).filter(pa.array(keep))

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "n_a", "r_a", "n_b", "r_b").mapInArrow(run, "a bigint, b bigint")


def shingle_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(set_id, shingles) of the wanted set_ids, from the texts of their representatives."""
    owner = classes.join(wanted, "set_id").select(F.col("rep").alias("_rep")).distinct()
    texts = docs.select("doc_id", "text").join(owner, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")

    def work(texts: Texts) -> dict:
        n = len(texts.bounds) - 1
        values, doc = shingles(texts)
        cuts = np.searchsorted(doc, np.arange(n + 1))
        sets = [np.unique(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        return {"set_id": [set_fingerprint(s) if s.size else None for s in sets], "shingles": [s.view(np.int64) for s in sets]}

    fields = [("set_id", pa.int64()), ("shingles", pa.list_(pa.int64()))]
    full = per_text(texts, [], "text", fields, lambda: work).join(wanted, "set_id", "left_semi")
    return cut(full.dropDuplicates(["set_id"]))


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets reach the threshold."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    full = shingle_sets(wanted, docs, classes)
    side = lambda n: full.select(F.col("set_id").alias(n), F.col("shingles").alias(f"s_{n}"))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    enough = 100 * shared >= PERCENT * (F.size("s_a") + F.size("s_b") - shared)
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(enough).select("a", "b")


def _in_blocks(members: DataFrame, blocks) -> DataFrame:
    """Deal the members of every bucket into blocks and pair each block with each: ``group`` is
    one pair of blocks; rows whose ``mine`` and ``other`` agree meet inside their own block."""
    sizes = members.groupBy("key").agg(F.greatest(F.ceil(blocks), F.lit(1)).cast("int").alias("_n"))
    mine = F.pmod(F.xxhash64("set_id"), F.col("_n")).cast("int")
    dealt = members.join(sizes, "key").withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    pair = (F.col("key"), F.least("mine", "other"), F.greatest("mine", "other"))
    return dealt.withColumn("group", F.xxhash64(*pair)).drop("_n")


def _joined_once(members: DataFrame, other: DataFrame) -> DataFrame:
    """(key, set_id, root) with the columns of ``other``, looked up once per class and not per
    bucket; a class is in at most one bucket of a band, so its list of keys is short."""
    mine = members.groupBy("set_id").agg(F.first("root").alias("root"), F.collect_list("key").alias("_keys"))
    return mine.join(other, "set_id").withColumn("key", F.explode("_keys")).drop("_keys")


def live_members(members: DataFrame) -> DataFrame:
    """(key, set_id, root) of the members that may be linked to another component of their
    bucket, by their sketches. A pair counts in the first band it shares only."""

    def run(table: pa.Table) -> pa.Table:
        regs = _matrix(table["registers"])
        root, n, key = (table[c].to_numpy() for c in ("root", "n_shingles", "key"))
        mine, other = table["mine"].to_numpy(), table["other"].to_numpy()
        live = np.zeros(len(root), bool)
        for i in range(len(root) - 1):
            rest = slice(i + 1, None)
            y = (root[rest] != root[i]) & ((mine[rest] != mine[i]) | (mine[i] == other[i]))
            y &= 100 * np.minimum(n[rest], n[i]) >= PERCENT * np.maximum(n[rest], n[i])
            y = np.flatnonzero(y) + i + 1
            equal = regs[y] == regs[i]
            likely = equal.sum(axis=1) >= REGISTERS * ESTIMATE_FROM
            y, equal = y[likely], equal[likely]
            if y.size:
                band = int(key[i]) & ((1 << BAND_BITS) - 1)
                y = y[~equal[:, BANDS[:band]].all(axis=2).any(axis=1)]
                live[y] = True
                live[i] |= bool(y.size)
        return table.filter(pa.array(live)).select(["key", "set_id", "root"])

    placed = _in_blocks(members, F.count("*") / BLOCK)
    return placed.groupBy("group").applyInArrow(run, "key bigint, set_id bigint, root bigint").distinct()


def joining_links(members: DataFrame) -> DataFrame:
    """(a, b): exact links between components of a bucket, in each block at most one less than
    it has components."""

    def run(table: pa.Table) -> pa.Table:
        ids, root, mine, other = (table[c].to_numpy() for c in ("set_id", "root", "mine", "other"))
        lists = table["shingles"].combine_chunks()
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        _, number = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        size = np.diff(cuts)
        part = np.unique(root, return_inverse=True)[1]
        mark = np.zeros(number.size + 1, np.int64)
        a, b = [], []
        for i in np.argsort(np.bincount(part)[part], kind="stable").tolist():  # small components first
            if not ((part != part[i]) & ((mine != mine[i]) | (mine[i] == other[i]))).any():
                continue
            own = number[cuts[i] : cuts[i + 1]]
            mark[own] = 1
            shared = np.add.reduceat(mark[number], cuts[:-1])
            mark[own] = 0
            near = 100 * shared >= PERCENT * (size + size[i] - shared)
            near &= (mine != mine[i]) | (mine[i] == other[i])
            for k in np.flatnonzero(near & (part != part[i])).tolist():
                if part[k] != part[i]:
                    a.append(min(ids[i], ids[k]))
                    b.append(max(ids[i], ids[k]))
                    part[part == part[k]] = part[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    placed = _in_blocks(members, F.sum(F.size("shingles")) / BLOCK_SHINGLES)
    return placed.groupBy("group").applyInArrow(run, "a bigint, b bigint").distinct()


def _components(links: DataFrame) -> DataFrame:
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    return cut(connected_components(nodes, edges, []).select(F.col("node").alias("set_id"), "root"))


def linked_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(set_id, root) of every class that has a link; root is the smallest set_id reachable."""
    keys = band_keys(classes)
    full = keys.groupBy("key").agg(F.min("set_id").alias("leader"), F.max("set_id").alias("_last"))
    full = full.filter("leader < _last").select("key", "leader")
    buckets = cut(keys.join(full, "key").filter("set_id > leader").select("key", "leader", "set_id"))
    stars = buckets.select(F.col("leader").alias("a"), F.col("set_id").alias("b")).distinct()
    links = cut(confirm(cut(likely(stars, classes)), docs, classes))
    roots = _components(links)
    # the leader has been compared with all; other members count where components differ
    members = buckets.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    mixed = members.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"))
    members = members.join(mixed.filter("_lo < _hi").select("key"), "key", "left_semi")
    live = cut(live_members(_joined_once(members, classes.select("set_id", "n_shingles", "registers"))))
    sets = shingle_sets(live.select("set_id").distinct(), docs, classes)
    more = cut(joining_links(_joined_once(live, sets)))
    return roots if more.isEmpty() else _components(links.unionByName(more))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept."""
    sketches = cut(sketch(docs))
    classes = cut(
        sketches.filter("set_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    )
    roots = linked_classes(docs, classes)
    named = classes.select("set_id", "rep").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = cut(named.join(smallest, "root").select("set_id", "component_id"))
    component = F.coalesce("component_id", "doc_id")
    return sketches.join(named, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, columns unchanged. Of rows with equal doc_id one stays."""
    kept = near_duplicates(docs.select("doc_id", "text")).filter("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
