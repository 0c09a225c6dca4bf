"""Statistical test queries."""

from pyspark.sql import functions as F

from tidemark.catalog.base import EH_SQL, eh, grid, query, rnd, rsql
from tidemark.operators import quality, stattests
from tidemark.operators.windows import equal_slices
from tidemark.schema import SERIES

W = "(PARTITION BY kpi, dim_key ORDER BY ts)"


@query(
    "welch_seasonality",
    f"""WITH {EH_SQL}, g AS (SELECT kpi, dim_key, hour(ts) AS h, count(*) AS n, avg(value) AS m,
         count(*) / var_samp(value) AS w FROM eh GROUP BY 1, 2, 3),
    t AS (SELECT kpi, dim_key, sum(w) AS ws, sum(w * m) / sum(w) AS c FROM g GROUP BY 1, 2),
    s AS (SELECT g.kpi, g.dim_key, sum(w * pow(m - c, 2)) / 23 AS b, sum(pow(1 - w / ws, 2) / (n - 1)) AS s
          FROM g JOIN t ON g.kpi = t.kpi AND g.dim_key = t.dim_key GROUP BY 1, 2)
    SELECT kpi, dim_key, {rsql('b / (1 + 2.0 * 26 / 575 * s)')} AS f, {rsql('575 / (3 * s)')} AS df2
    FROM s""",
)
def welch_seasonality(spark, d):
    out = stattests.welch_seasonality(eh(spark, d))
    return out.select(*SERIES, rnd("f").alias("f"), rnd("df2").alias("df2"))


@query(
    "friedman_test",
    f"""WITH {EH_SQL}, f AS (SELECT *, CAST(ts AS DATE) AS doy, hour(ts) AS h, count(*) OVER
         (PARTITION BY kpi, dim_key, CAST(ts AS DATE)) AS dn FROM eh),
    r AS (SELECT kpi, dim_key, doy, h,
            rank() OVER (PARTITION BY kpi, dim_key, doy ORDER BY value)
            + (count(*) OVER (PARTITION BY kpi, dim_key, doy, value) - 1) / 2.0 AS r,
            count(*) OVER (PARTITION BY kpi, dim_key, doy, value) AS t FROM f WHERE dn = 24),
    s AS (SELECT kpi, dim_key, h, sum(r) AS rs, count(*) AS n, sum(t * t - 1) AS tie
          FROM r GROUP BY 1, 2, 3)
    SELECT kpi, dim_key, {rsql('''(12.0 / (max(n) * 24 * 25) * sum(rs * rs) - 3.0 * max(n) * 25)
             / (1 - sum(tie) / (max(n) * 24.0 * 575))''')} AS chi2, CAST(max(n) AS BIGINT) AS n_days
    FROM s GROUP BY 1, 2""",
)
def friedman_test(spark, d):
    return stattests.friedman_test(eh(spark, d)).select(*SERIES, rnd("chi2").alias("chi2"), "n_days")


@query(
    "kruskal_wallis",
    f"""WITH {EH_SQL}, r AS (SELECT kpi, dim_key, hour(ts) AS h,
         rank() OVER (PARTITION BY kpi, dim_key ORDER BY value)
         + (count(*) OVER (PARTITION BY kpi, dim_key, value) - 1) / 2.0 AS r,
         count(*) OVER (PARTITION BY kpi, dim_key, value) AS t FROM eh),
    s AS (SELECT kpi, dim_key, h, CAST(sum(r) AS DOUBLE) AS rs, CAST(count(*) AS DOUBLE) AS n,
                 CAST(sum(t * t - 1) AS DOUBLE) AS tie FROM r GROUP BY 1, 2, 3)
    SELECT kpi, dim_key, {rsql('''(12 / (sum(n) * (sum(n) + 1)) * sum(rs * rs / n) - 3 * (sum(n) + 1))
             / (1 - sum(tie) / (pow(sum(n), 3) - sum(n)))''')} AS h FROM s GROUP BY 1, 2""",
)
def kruskal_wallis(spark, d):
    return stattests.kruskal_wallis(eh(spark, d)).select(*SERIES, rnd("h").alias("h"))


@query(
    "ar_residual",
    f"""WITH {EH_SQL}, l AS (SELECT *, lag(value) OVER {W} AS y1 FROM eh),
    c AS (SELECT kpi, dim_key, regr_slope(value, y1) AS b, regr_intercept(value, y1) AS a
          FROM l WHERE y1 IS NOT NULL GROUP BY 1, 2)
    SELECT l.kpi, l.dim_key, l.ts, {rsql('value - a - b * y1', 5)} AS residual
    FROM l JOIN c ON l.kpi = c.kpi AND l.dim_key = c.dim_key WHERE y1 IS NOT NULL""",
)
def ar_residual(spark, d):
    out = stattests.ar_residual(eh(spark, d), max_p=1)
    return out.select(*SERIES, "ts", rnd("residual", 5).alias("residual"))


@query("ar_residual_aic")
def ar_residual_aic(spark, d):
    out = stattests.ar_residual(eh(spark, d), max_p=3)
    return out.select(*SERIES, "ts", rnd("residual", 5).alias("residual"))


@query("seasonality_vote")
def seasonality_vote(spark, d):
    return stattests.seasonality_vote(quality.interpolate(grid(spark, d), "pchip"))


SLICE_SQL = f"""sl AS (SELECT kpi, dim_key, value, (i >= n // 4)::INT + (i >= 2 * n // 4)::INT
    + (i >= 3 * n // 4)::INT AS s FROM (SELECT *, row_number() OVER {W} - 1 AS i,
    count(*) OVER (PARTITION BY kpi, dim_key) AS n FROM eh))"""


@query(
    "ks_two_sample",
    f"""WITH {EH_SQL}, {SLICE_SQL},
    p AS (SELECT a.i, b.j FROM range(4) a(i), range(4) b(j) WHERE a.i < b.j),
    v AS (SELECT kpi, dim_key, i, j, value, count(*) FILTER (s = i) AS ca, count(*) FILTER (s = j) AS cb
          FROM sl JOIN p ON s = i OR s = j GROUP BY 1, 2, 3, 4, 5),
    e AS (SELECT kpi, dim_key, i, j, abs(sum(ca) OVER w / sum(ca) OVER t
            - sum(cb) OVER w / sum(cb) OVER t) AS g, sum(ca) OVER t AS n1, sum(cb) OVER t AS n2 FROM v
          WINDOW w AS (PARTITION BY kpi, dim_key, i, j ORDER BY value),
                 t AS (PARTITION BY kpi, dim_key, i, j))
    SELECT kpi, dim_key, CAST(i AS INT) AS i, CAST(j AS INT) AS j, {rsql('max(g)')} AS d,
           CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2 FROM e GROUP BY 1, 2, 3, 4""",
)
def ks_two_sample(spark, d):
    sliced = eh(spark, d).withColumn("slice", equal_slices(4))
    out = stattests.ks_two_sample(sliced, SERIES)
    return out.select(*SERIES, "i", "j", rnd("d").alias("d"), "n1", "n2")


@query("stationarity")
def stationarity(spark, d):
    return stattests.stationarity(eh(spark, d), "both")


ACF = ", ".join(f"sum(c * k{k}) / sum(c * c)" for k in range(10, 25))
LAGS = ", ".join(f"lag(c, {k}) OVER {W} AS k{k}" for k in range(10, 25))


@query(
    "acf_max_diff",
    f"""WITH {EH_SQL}, m AS (SELECT kpi, dim_key, ts,
         value - avg(value) OVER (PARTITION BY kpi, dim_key) AS c FROM eh),
    l AS (SELECT *, {LAGS} FROM m)
    SELECT kpi, dim_key, {rsql(f'greatest({ACF}) - least({ACF})')} AS acf_max_diff
    FROM l GROUP BY 1, 2""",
)
def acf_max_diff(spark, d):
    out = stattests.acf_max_diff(eh(spark, d))
    return out.select(*SERIES, rnd("acf_max_diff").alias("acf_max_diff"))


@query(
    "levene_test",
    f"""WITH {EH_SQL}, x AS (SELECT kpi, dim_key, dayofyear(ts) AS doy, value FROM eh),
    m AS (SELECT kpi, dim_key, doy, quantile_cont(value, 0.5) AS mid FROM x GROUP BY 1, 2, 3),
    z AS (SELECT x.kpi, x.dim_key, x.doy, abs(value - mid) AS z FROM x JOIN m
          ON x.kpi = m.kpi AND x.dim_key = m.dim_key AND x.doy = m.doy),
    g AS (SELECT kpi, dim_key, doy, CAST(count(*) AS DOUBLE) AS n, avg(z) AS m,
                 var_pop(z) * count(*) AS s FROM z GROUP BY 1, 2, 3),
    p AS (SELECT a.kpi, a.dim_key, a.doy, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.s AS s1, b.s AS s2,
                 (a.n * a.m + b.n * b.m) / (a.n + b.n) AS mm
          FROM g a JOIN g b ON a.kpi = b.kpi AND a.dim_key = b.dim_key AND b.doy = 30 AND a.doy < 30)
    SELECT kpi, dim_key, CAST(doy AS INT) AS doy,
           {rsql('(n1 + n2 - 2) * (n1 * pow(m1 - mm, 2) + n2 * pow(m2 - mm, 2)) / nullif(s1 + s2, 0)')} AS w
    FROM p""",
)
def levene_test(spark, d):
    days = eh(spark, d).select(*SERIES, F.dayofyear("ts").alias("doy"), "value")
    out = stattests.levene_test(days.filter("doy < 30"), days.filter("doy = 30"), SERIES, "doy")
    return out.select(*SERIES, "doy", rnd("w").alias("w"))
