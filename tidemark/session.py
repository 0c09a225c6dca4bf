"""Session helpers: time zone, scratch folders and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on; safe to call repeatedly.

    Timestamps are wall-clock (``TIMESTAMP_NTZ``), so the session zone is pinned to UTC
    to keep functions that go through ``TIMESTAMP`` free of daylight-saving jumps.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can see: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local session without that setting (tests, a laptop) gets a private temporary
    folder; on a cluster executors would not see it, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if base is None:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(sc, "_tidemark_dir", None)
        if base is None:
            base = tempfile.mkdtemp(prefix="tidemark-")
            sc._tidemark_dir = base
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; never reused between calls."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash the rows on their key over all cores before per-key Python or search work.

    An explicit partition count keeps adaptive execution from merging small partitions: here
    the work per byte is high, and few bytes would end up on one core.
    """
    spark = df.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, spark.sparkContext.defaultParallelism), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back.

    Used between the rounds of iterative operators and where one intermediate feeds many
    branches of a plan. A written table is computed once (a checkpoint computes its input
    twice), survives the loss of executors, keeps columnar pruning for its readers and gives
    the optimizer real sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
