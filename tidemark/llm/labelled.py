"""Bounded, reproducible samples of labelled rows for fitting small models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_bucket(doc_id: str, modulus: int):
    """crc32 of the decimal doc_id modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def sample_per_class(
    rows: DataFrame, label: str, per_class: int, max_classes: int, size: str | None = None, total: int = 0
) -> DataFrame:
    """At most about ``per_class`` rows of each label value, chosen by a hash of doc_id; with a
    column ``size`` also at most about ``total`` of it per label value.

    Classes are counted first; then every row is kept with the probability that leaves
    ``per_class`` expected rows (a class below the bound is kept whole). No sort, no group in one
    task. Of more than ``max_classes`` label values the most frequent are used; both bounds are
    parameters of the fit, not of the scoring.
    """
    weight = F.coalesce(F.sum(size), F.lit(0)) if size else F.lit(0)
    counts = rows.groupBy(label).agg(F.count("*").alias("count"), weight.alias("weight"))
    counts = counts.orderBy(F.desc("count"), label).limit(max_classes).collect()
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, per_class / r[1], total / r[2] if r[2] else 1.0))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return rows.filter(draw < F.coalesce(share[F.col(label)], F.lit(0.0)))
