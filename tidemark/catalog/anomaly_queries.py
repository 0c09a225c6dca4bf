"""Scaling, threshold, SPOT, pipeline and train/score queries."""


from pyspark.sql import functions as F

from tidemark.catalog.base import EH_SQL, eh, query, rnd, rsql, table
from tidemark.operators import anomaly
from tidemark.plans import detect, pipelines
from tidemark.schema import SERIES
from tidemark.session import scratch_path

W = "(PARTITION BY kpi, dim_key ORDER BY ts)"


@query(
    "standard_scale",
    f"""SELECT c_custkey, {rsql('(c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ()')}
      AS c_acctbal, {rsql('''(c_nationkey - avg(c_nationkey) OVER ())
      / stddev_pop(c_nationkey) OVER ()''')} AS c_nationkey FROM customer""",
)
def standard_scale(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    out = anomaly.standard_scale(rows, ["c_acctbal", "c_nationkey"])
    return out.select(
        rnd("c_acctbal").alias("c_acctbal"), rnd("c_nationkey").alias("c_nationkey"), "c_custkey"
    )


@query(
    "standard_scale_keyed",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, ts, {rsql('''(value - avg(value) OVER w)
      / stddev_pop(value) OVER w''')} AS value FROM eh WINDOW w AS (PARTITION BY kpi, dim_key)""",
)
def standard_scale_keyed(spark, d):
    out = anomaly.standard_scale(eh(spark, d), ["value"], SERIES)
    return out.select(*SERIES, "ts", rnd("value").alias("value"))


SCALER = {
    "steps": [
        {"step": "StandardScaler", "column": "value",
         "params": [{"key": "copy", "value": "True"}, {"key": "with_mean", "value": "True"}]},
        {"step": "ZscoreEstimator", "column": "value", "params": [{"key": "threshold", "value": "3"}]},
    ]
}
PIPE_SQL = f"""WITH {EH_SQL}, s AS (SELECT kpi, dim_key, ts,
    (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS value FROM eh)
  SELECT kpi, dim_key, ts, {rsql('value')} AS value, {rsql('value')} AS z, abs(value) > 3 AS is_anomaly FROM s"""


def pipe_out(df):
    return df.select(*SERIES, "ts", rnd("value").alias("value"), rnd("z").alias("z"), "is_anomaly")


@query("build_pipeline", PIPE_SQL)
def build_pipeline(spark, d):
    rows = eh(spark, d)
    return pipe_out(pipelines.build_pipeline(SCALER).fit(rows).transform(rows))


@query("save_load_pipeline", PIPE_SQL)
def save_load_pipeline(spark, d):
    """Both the untrained and the trained pipeline go through storage."""
    rows = eh(spark, d)
    path = scratch_path(spark, "pipelines")
    pipelines.save_pipeline(pipelines.build_pipeline(SCALER), f"{path}/untrained")
    trained = pipelines.load_pipeline(f"{path}/untrained", trained=False).fit(rows)
    pipelines.save_pipeline(trained, f"{path}/trained")
    return pipe_out(pipelines.load_pipeline(f"{path}/trained", trained=True).transform(rows))


@query(
    "zscore_fit",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, {rsql('avg(value)')} AS mu,
      {rsql('stddev_pop(value)')} AS sigma FROM eh GROUP BY 1, 2""",
)
def zscore_fit(spark, d):
    out = anomaly.zscore_fit(eh(spark, d), value="value")
    return out.select(*SERIES, rnd("mu").alias("mu"), rnd("sigma").alias("sigma"))


@query(
    "zscore_predict",
    f"""WITH {EH_SQL}, p AS (SELECT kpi, dim_key, avg(value) AS mu, stddev_pop(value) AS sg
         FROM eh GROUP BY 1, 2)
    SELECT e.kpi, e.dim_key, e.ts, {rsql('(value - mu) / sg')} AS z, abs((value - mu) / sg) > 3 AS is_anomaly
    FROM eh e JOIN p ON e.kpi = p.kpi AND e.dim_key = p.dim_key""",
)
def zscore_predict(spark, d):
    kpi = eh(spark, d)
    out = anomaly.zscore_predict(kpi, anomaly.zscore_fit(kpi, value="value"), value="value")
    return out.select(*SERIES, "ts", rnd("z").alias("z"), "is_anomaly")


INIT_SQL = f"""ini AS (SELECT * FROM (SELECT *, row_number() OVER {W} AS rn FROM eh) WHERE rn <= 168),
  lv AS (SELECT kpi, dim_key, value, row_number() OVER (PARTITION BY kpi, dim_key ORDER BY value) - 1 AS i,
         count(*) OVER (PARTITION BY kpi, dim_key) AS n FROM ini),
  th AS (SELECT kpi, dim_key, max(value) FILTER (i = CAST(floor(0.9 * n) AS BIGINT)) AS t,
         max(n) AS n FROM lv GROUP BY 1, 2),
  pk AS (SELECT l.kpi, l.dim_key, t, th.n, l.value - t AS peak FROM lv l JOIN th ON l.kpi = th.kpi
         AND l.dim_key = th.dim_key)"""


def calibration(spark, d):
    return anomaly.split_calibration(eh(spark, d), 168).filter("is_init").drop("is_init")


@query(
    "pot_init",
    f"""WITH {EH_SQL}, {INIT_SQL} SELECT kpi, dim_key, {rsql('max(t)')} AS init_threshold,
      CAST(max(n) AS BIGINT) AS n, CAST(count(*) FILTER (peak > 0) AS BIGINT) AS n_peaks
    FROM pk GROUP BY 1, 2""",
)
def pot_init(spark, d):
    out = anomaly.pot_init(calibration(spark, d), level=0.9)
    return out.select(*SERIES, rnd("init_threshold").alias("init_threshold"), "n", "n_peaks")


def peaks(spark, d):
    rows = calibration(spark, d)
    limits = anomaly.pot_init(rows, level=0.9)
    excess = rows.join(limits, SERIES).withColumn("peak", F.col("value") - F.col("init_threshold"))
    return excess.filter("peak > 0"), limits


@query("gpd_fit")
def gpd_fit(spark, d):
    out = anomaly.gpd_fit(peaks(spark, d)[0])
    return out.select(*SERIES, rnd("gamma", 4).alias("gamma"), rnd("sigma", 4).alias("sigma"), "n_peaks")


@query(
    "pot_quantile",
    f"""WITH {EH_SQL}, {INIT_SQL}, m AS (SELECT kpi, dim_key, max(t) AS t, max(n) AS n,
         count(*) FILTER (peak > 0) AS nt, avg(peak) FILTER (peak > 0) AS s FROM pk GROUP BY 1, 2)
    SELECT kpi, dim_key, {rsql('t - s * ln(n * 1e-4 / nt)', 4)} AS z_exponential,
      {rsql('t + s / 0.1 * (pow(n * 1e-4 / nt, -0.1) - 1)', 4)} AS z_pareto FROM m WHERE nt > 0""",
)
def pot_quantile(spark, d):
    """Quantiles for given tails: exponential, and Pareto with gamma 0.1, sigma = mean peak."""
    excess, limits = peaks(spark, d)
    scale = excess.groupBy(*SERIES).agg(F.avg("peak").alias("sigma"))
    rows = limits.join(scale, SERIES)
    args = (F.col("sigma"), F.col("n"), F.col("n_peaks"), 1e-4)
    zero = anomaly.pot_quantile(F.col("init_threshold"), F.lit(0.0), *args)
    heavy = anomaly.pot_quantile(F.col("init_threshold"), F.lit(0.1), *args)
    return rows.select(
        *SERIES, rnd(zero, 4).alias("z_exponential"), rnd(heavy, 4).alias("z_pareto")
    )


@query("spot_run")
def spot_run(spark, d):
    out = anomaly.spot_run(eh(spark, d), n_init=168, q=1e-3, level=0.9)
    return out.select(
        *SERIES, "ts", rnd("value").alias("value"), rnd("threshold", 4).alias("threshold"), "alarm"
    )


@query(
    "spot_input",
    f"""WITH {EH_SQL}, r AS (SELECT *, row_number() OVER {W} AS rn,
         count(*) OVER (PARTITION BY kpi, dim_key) AS n FROM eh)
    SELECT kpi, dim_key, ts, rn <= 168 AS first_n, rn <= floor(n * 0.25) AS first_share FROM r""",
)
def spot_input(spark, d):
    rows = anomaly.split_calibration(eh(spark, d), 168).withColumnRenamed("is_init", "first_n")
    out = anomaly.split_calibration(rows, 0.25).withColumnRenamed("is_init", "first_share")
    return out.select(*SERIES, "ts", "first_n", "first_share")


AD_SQL = (
    EH_SQL
    + """, p AS (SELECT kpi, dim_key, avg(value) AS mean, stddev_pop(value) AS std FROM eh GROUP BY 1, 2),
  sc AS (SELECT e.kpi, e.dim_key, e.ts, e.value, (value - mean) / std AS v FROM eh e JOIN p
         ON e.kpi = p.kpi AND e.dim_key = p.dim_key),
  pf AS (SELECT kpi, dim_key, isodow(ts) AS dw, hour(ts) AS h, avg(v) AS yhat FROM sc GROUP BY 1, 2, 3, 4),
  rs AS (SELECT sc.*, v - yhat AS r FROM sc JOIN pf ON sc.kpi = pf.kpi AND sc.dim_key = pf.dim_key
         AND isodow(sc.ts) = pf.dw AND hour(sc.ts) = pf.h),
  zp AS (SELECT kpi, dim_key, avg(r) AS mu, stddev_pop(r) AS sg FROM rs GROUP BY 1, 2),
  zs AS (SELECT rs.kpi, rs.dim_key, ts, value, (r - mu) / sg AS z FROM rs JOIN zp
         ON rs.kpi = zp.kpi AND rs.dim_key = zp.dim_key)"""
)


@query(
    "train_ad",
    f"""WITH {AD_SQL} SELECT p.kpi, p.dim_key, {rsql('mean')} AS mean, {rsql('std')} AS std,
      {rsql('sg')} AS sigma FROM p JOIN zp ON p.kpi = zp.kpi AND p.dim_key = zp.dim_key""",
)
def train_ad(spark, d):
    model = detect.train_ad(eh(spark, d))
    out = model["scaler"].join(model["zparams"], SERIES)
    return out.select(
        *SERIES, rnd("mean").alias("mean"), rnd("std").alias("std"), rnd("sigma").alias("sigma")
    )


@query(
    "score_ad",
    f"""WITH {AD_SQL} SELECT kpi, dim_key, ts, {rsql('value')} AS value, {rsql('z')} AS z
    FROM zs WHERE abs(z) > 3""",
)
def score_ad(spark, d):
    kpi = eh(spark, d)
    out = detect.score_ad(kpi, detect.train_ad(kpi))
    return out.select(*SERIES, "ts", rnd("value").alias("value"), rnd("z").alias("z"))


@query(
    "live_threshold",
    f"""WITH {AD_SQL}, t(kpi, threshold) AS (VALUES ('value_wmean', 3.0::DOUBLE), ('value_sum', 2.5::DOUBLE),
      ('value_sample', 2.0::DOUBLE))
    SELECT zs.kpi, dim_key, ts, {rsql('value')} AS value, {rsql('z')} AS z FROM zs JOIN t ON zs.kpi = t.kpi
    WHERE abs(z) > threshold""",
)
def live_threshold(spark, d):
    """Thresholds come from a control table; one row per KPI."""
    control = spark.createDataFrame(
        [("value_wmean", 3.0), ("value_sum", 2.5), ("value_sample", 2.0)],
        "kpi string, threshold double",
    )
    kpi = eh(spark, d)
    incoming = kpi.join(F.broadcast(control), "kpi")
    out = detect.score_ad(incoming, detect.train_ad(kpi), threshold=F.col("threshold"))
    return out.select(*SERIES, "ts", rnd("value").alias("value"), rnd("z").alias("z"))


@query(
    "grouped_map_udf",
    f"""WITH {EH_SQL} SELECT kpi, dim_key, ts, {rsql('max(value) OVER w')} AS peak_so_far FROM eh
    WINDOW w AS (PARTITION BY kpi, dim_key ORDER BY ts)""",
)
def grouped_map_udf(spark, d):
    """A user function per series: the running maximum."""

    def running_max(pdf):
        pdf = pdf.sort_values("ts")
        return pdf[["kpi", "dim_key", "ts"]].assign(peak_so_far=pdf["value"].cummax())

    out = pipelines.apply_per_series(
        eh(spark, d), running_max, "kpi string, dim_key string, ts timestamp_ntz, peak_so_far double"
    )
    return out.withColumn("peak_so_far", rnd("peak_so_far"))


