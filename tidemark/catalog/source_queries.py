"""Sources, sinks and generated inputs. Files are derived from the events table."""

from pyspark.sql import functions as F

from tidemark.catalog.base import EH_SQL, EHW_SQL, KPIS, eh, eh_wide, query, rnd, rsql, table
from tidemark.functions.scalar import epoch_to_ts, ts_to_epoch
from tidemark.session import scratch_path
from tidemark.sources import files, generate

WIDE_OUT = f"""
WITH {EHW_SQL}
SELECT dim_key, ts, {rsql('value_wmean')} AS value_wmean, {rsql('value_sum')} AS value_sum,
       {rsql('value_sample')} AS value_sample FROM ehw"""
SCHEMA = files.wide_csv_schema("dim_key", KPIS)


def epoch_wide(spark, d):
    return eh_wide(spark, d).withColumn("ts", ts_to_epoch(F.col("ts")))


def shown(wide):
    return wide.select(
        "dim_key", epoch_to_ts(F.col("ts")).alias("ts"), *[rnd(k).alias(k) for k in KPIS]
    )


@query("scan_kpi_csv", WIDE_OUT)
def scan_kpi_csv(spark, d):
    path = scratch_path(spark, "wide") + "/4weeks-event_type-1706572800.csv"
    files.sink_csv(epoch_wide(spark, d), path)
    return shown(files.scan_kpi_csv(spark, path, SCHEMA))


@query(
    "scan_kpi_parquet",
    f"SELECT event_id, ts, event_type, {rsql('value')} AS value FROM events",
)
def scan_kpi_parquet(spark, d):
    df = files.scan_kpi_parquet(spark, f"{d}/events.parquet")
    return df.select("event_id", "ts", "event_type", rnd("value").alias("value"))


@query("scan_multi_file", WIDE_OUT)
def scan_multi_file(spark, d):
    """One directory per event type, read back as a single table."""
    path = scratch_path(spark, "multi")
    epoch_wide(spark, d).withColumn("part", F.col("dim_key")).write.partitionBy("part").option(
        "header", True
    ).csv(path)
    return shown(files.scan_kpi_csv(spark, f"{path}/*", SCHEMA))


@query("path_pattern_filter", WIDE_OUT)
def path_pattern_filter(spark, d):
    """Two file sets under one root; only the one with the four-week name is read."""
    root = scratch_path(spark, "named")
    wide = epoch_wide(spark, d)
    files.sink_csv(wide, f"{root}/4weeks-event_type-1706572800.csv")
    files.sink_csv(wide, f"{root}/1week-event_type-1706572800.csv")
    return shown(files.path_pattern_filter(spark, root, SCHEMA))


@query(
    "file_epoch_extract",
    f"""WITH {EHW_SQL}
    SELECT dim_key, CAST(count(*) AS BIGINT) AS n_rows, CAST(1706572800 AS BIGINT) AS run_epoch
    FROM ehw GROUP BY 1""",
)
def file_epoch_extract(spark, d):
    path = scratch_path(spark, "epoch") + "/4weeks-event_type-1706572800.csv"
    files.sink_csv(epoch_wide(spark, d), path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return (
        files.scan_kpi_csv(spark, path, SCHEMA)
        .select("dim_key", files.file_epoch(folder).alias("run_epoch"))
        .groupBy("dim_key", "run_epoch")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


LONG_OUT = f"WITH {EH_SQL} SELECT kpi, dim_key, ts, {rsql('value')} AS value FROM eh"


@query("sink_csv", LONG_OUT)
def sink_csv(spark, d):
    path = scratch_path(spark, "csv")
    files.sink_csv(eh(spark, d), path)
    back = (
        spark.read.option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .schema("kpi string, dim_key string, ts timestamp_ntz, value double")
        .csv(path)
    )
    return back.select("kpi", "dim_key", "ts", rnd("value").alias("value"))


@query("sink_parquet", LONG_OUT)
def sink_parquet(spark, d):
    path = scratch_path(spark, "long")
    files.sink_parquet(eh(spark, d), path)
    back = files.scan_kpi_parquet(spark, path)
    return back.select("kpi", "dim_key", "ts", rnd("value").alias("value"))


@query(
    "sql_view",
    f"""WITH {EH_SQL} SELECT kpi AS variable, dim_key, ts AS dt, {rsql('sum(value)')} AS value
    FROM eh GROUP BY 1, 2, 3""",
)
def sql_view(spark, d):
    out = files.sql_view(
        eh(spark, d),
        "kpi_long",
        """SELECT kpi AS variable, dim_key, ts AS dt, sum(value) AS value
           FROM kpi_long GROUP BY kpi, dim_key, ts ORDER BY variable, dim_key, dt""",
    )
    return out.withColumn("value", rnd("value"))


@query("make_blobs")
def make_blobs(spark, d):
    """Blobs around the class centres of the embeddings, one point per embedding."""
    vectors = table(spark, d, "embeddings")
    dims = [F.avg(F.col("embedding")[j].cast("double")).alias(f"c{j}") for j in range(15)]
    centres = vectors.groupBy("label").agg(*dims).select(
        "label", F.array(*[f"c{j}" for j in range(15)]).alias("centre")
    )
    blobs = generate.make_blobs(vectors.select("vec_id"), centres, "vec_id", std=2.0, seed=1)
    return blobs.select(
        "vec_id", "label", *[F.col("features")[j].alias(f"feature_{j + 1}") for j in range(15)]
    )


@query(
    "sample_series",
    f"""WITH {EH_SQL},
    chosen AS (SELECT kpi, dim_key FROM (SELECT DISTINCT kpi, dim_key FROM eh)
               ORDER BY md5(kpi || '|' || dim_key || '|0'), kpi, dim_key LIMIT 5)
    SELECT e.kpi, e.dim_key, e.ts, {rsql('e.value')} AS value
    FROM eh e JOIN chosen c ON e.kpi = c.kpi AND e.dim_key = c.dim_key""",
)
def sample_series(spark, d):
    return generate.sample_series(eh(spark, d), 5).select(
        "kpi", "dim_key", "ts", rnd("value").alias("value")
    )
