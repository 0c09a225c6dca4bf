"""CSV and Parquet sources and sinks for KPI tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOUR_WEEK_FILES = r"(^|/)4weeks-[^/\s]*\.csv(/|$)"


def wide_csv_schema(dim: str, kpis: list[str]) -> T.StructType:
    """Declared schema of a wide KPI file: dimension, epoch seconds, one double per KPI."""
    return T.StructType(
        [T.StructField(dim, T.StringType()), T.StructField("ts", T.LongType())]
        + [T.StructField(k, T.DoubleType()) for k in kpis]
    )


def scan_kpi_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Headered wide KPI CSV; the schema is declared, so there is no inference pass."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def scan_kpi_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)


def path_pattern_filter(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str = FOUR_WEEK_FILES
) -> DataFrame:
    """Rows of the files under ``path`` whose path matches the pattern.

    ``_metadata.file_path`` is a constant per file, so other files are pruned from the scan
    by the file listing instead of being read and filtered.
    """
    return (
        spark.read.option("header", True)
        .option("recursiveFileLookup", True)
        .schema(schema)
        .csv(path)
        .filter(F.col("_metadata.file_path").rlike(pattern))
    )


def file_epoch(name: Column) -> Column:
    """Run epoch carried in the last ten digits before the file's extension."""
    return F.regexp_extract(name, r"(\d{10})\.\w+$", 1).try_cast("long")


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
    ).csv(path)


def sink_parquet(df: DataFrame, path: str, partition_by: list[str] = ("kpi",)) -> None:
    """Long table laid out for partition pruning.

    Rows are hashed on the partition columns plus a salt first: each KPI directory gets a
    handful of files, and a KPI holding most rows is still written by many tasks.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    (
        df.repartition(*partition_by, salt)
        .write.partitionBy(*partition_by)
        .parquet(path)
    )


def sql_view(df: DataFrame, view: str, text: str) -> DataFrame:
    """Register a view and run SQL text over it."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(text)
