"""Exact ranks and quantiles over groups of any size.

A plain window sorts each group in one task, which breaks once a single key holds a large
share of the data. Here a group is first reduced to distinct values with counts, then cut
into value ranges by an evenly hashed sample, so every sort handles a bounded slice and
only one small row per slice is needed to stitch the slices together. The sample depends on
the values alone, so a recomputed task after an executor loss sees the same slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

SLICE_ROWS = 250_000  # shapes the work only: values ranked in one task
SAMPLES_PER_SLICE = 16


def position(edges: Column, value: Column) -> Column:
    """Number of sorted ``edges`` at or below ``value``."""
    return F.size(F.filter(edges, lambda e: e <= value))


def even_sample(key_values: list[Column], wanted: Column, total: Column) -> Column:
    """Predicate keeping about ``wanted`` of ``total`` distinct values, by their hash."""
    return F.pmod(F.xxhash64(*key_values), F.greatest(total, F.lit(1))) < wanted


def pick_edges(sample: Column, slices: Column) -> Column:
    """Every (n / slices)-th element of a sorted sample: the slice boundaries."""
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.greatest(slices - 1, F.lit(1)).cast("int")),
            lambda i: F.try_element_at(
                sample, (F.floor(i * F.size(sample) / slices) + 1).cast("int")
            ),
        )
    )


def cumulative(
    df: DataFrame,
    keys: list[str],
    value: str,
    weights: list[str],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Running totals of ``weights`` over distinct ``value`` in each key group.

    Adds ``<w>_below`` (total over smaller values) and ``<w>_total`` for each weight, and
    ``distinct_below``. ``df`` must hold one row per (keys, value).

    The input is written once, since several branches read it. Every group is cut into
    slices of about ``slice_rows`` values; a small group is one slice.
    """
    keys = list(keys)
    df = cut(df if keys else df.withColumn("_all", F.lit(1)))
    by = keys or ["_all"]
    sizes = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(w).alias(f"{w}_total") for w in weights],
    )
    slices = F.floor(F.col("_n") / F.lit(slice_rows)) + 1
    sizes = sizes.withColumn("_slices", slices)
    edges = (
        df.join(sizes.filter("_slices > 1").select(*by, "_n", "_slices"), by)
        .filter(
            even_sample(
                [F.col(value)], F.col("_slices") * SAMPLES_PER_SLICE, F.col("_n")
            )
        )
        .groupBy(*by)
        .agg(
            F.sort_array(F.collect_list(value)).alias("_sample"),
            F.first("_slices").alias("_k"),
        )
        .select(*by, pick_edges(F.col("_sample"), F.col("_k")).alias("_edges"))
    )
    placed = df.join(sizes.drop("_n", "_slices"), by).join(edges, by, "left")
    placed = placed.withColumn(
        "_slice",
        F.when(F.col("_edges").isNull(), F.lit(0)).otherwise(
            position(F.col("_edges"), F.col(value))
        ),
    ).drop("_edges")

    per_slice = placed.groupBy(*by, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(w).alias(f"_s_{w}") for w in weights]
    )
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = per_slice.select(
        *by,
        "_slice",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_o_rows"),
        *[F.coalesce(F.sum(f"_s_{w}").over(before), F.lit(0)).alias(f"_o_{w}") for w in weights],
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1
    )
    out = placed.join(offsets, [*by, "_slice"]).select(
        *[c for c in placed.columns if c not in ("_slice",)],
        (F.col("_o_rows") + F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0))).alias(
            "distinct_below"
        ),
        *[
            (F.col(f"_o_{w}") + F.coalesce(F.sum(w).over(inside), F.lit(0))).alias(f"{w}_below")
            for w in weights
        ],
    )
    return out if keys else out.drop("_all")


def value_ranks(
    df: DataFrame, keys: list[str], value: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """One row per (keys, distinct value): ``cnt``, ``cnt_below`` and ``cnt_total``."""
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return cumulative(counts, keys, value, ["cnt"], slice_rows)


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value`` per key, one column per name."""
    ranks = value_ranks(df, keys, value, slice_rows)
    aggs, outs = [], []
    last = F.col("cnt_total") - 1
    for name, p in probs.items():
        pos = last * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("cnt_below") <= at) & (at < F.col("cnt_below") + F.col("cnt"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        frac = (F.col("_n") - 1) * F.lit(float(p)) - F.floor((F.col("_n") - 1) * F.lit(float(p)))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * frac).alias(name))
    return (
        ranks.groupBy(*keys)
        .agg(F.max("cnt_total").alias("_n"), *aggs)
        .select(*keys, *outs)
    )
