"""Generated inputs and series sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import SERIES


def unit_uniform(*parts: Column) -> Column:
    """Uniform number in (0, 1) that depends on its inputs only, not on partitioning."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def unit_normal(*parts: Column) -> Column:
    """Standard normal from two hashed uniforms (Box-Muller)."""
    u, v = unit_uniform(*parts, F.lit("u")), unit_uniform(*parts, F.lit("v"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def make_blobs(
    ids: DataFrame, centres: DataFrame, id_col: str = "id", std: float = 2.0, seed: int = 0
) -> DataFrame:
    """One Gaussian point per id around its centre.

    ``centres`` has ``label`` (0..k-1) and ``centre`` (array of doubles); the ids cycle
    through the labels. Recomputed tasks yield the same points.
    """
    labelled = ids.crossJoin(centres.agg(F.count(F.lit(1)).alias("_k"))).withColumn(
        "label", F.pmod(F.col(id_col), F.col("_k")).cast("int")
    )
    point = F.transform(
        "centre",
        lambda c, j: c + F.lit(float(std)) * unit_normal(F.col(id_col), j, F.lit(seed)),
    )
    return labelled.join(centres, "label").select(id_col, "label", point.alias("features"))


def sample_series(
    df: DataFrame, n: int, seed: str = "0", keys: list[str] = SERIES
) -> DataFrame:
    """All rows of ``n`` series drawn without replacement, in the order of a salted hash.

    The hash is evaluated once per distinct key and the draw is a top-n, not a full sort.
    """
    salted = F.md5(F.concat_ws("|", *keys, F.lit(seed)).cast("binary"))
    chosen = df.select(*keys).distinct().orderBy(salted, *keys).limit(n)
    return df.join(chosen, keys, "left_semi")
