"""Flagship query: the minimum end-to-end slice."""

from tidemark.catalog.base import EH_SQL, eh, query, rnd, rsql
from tidemark.plans.detect import residual_anomalies


@query(
    "flagship_anomalies",
    f"""
WITH {EH_SQL},
prof AS (
  SELECT kpi, dim_key, isodow(ts) AS dow, hour(ts) AS h, avg(value) AS yhat
  FROM eh GROUP BY 1, 2, 3, 4),
res AS (
  SELECT e.kpi, e.dim_key, e.ts, e.value, p.yhat, e.value - p.yhat AS residual
  FROM eh e JOIN prof p
    ON e.kpi = p.kpi AND e.dim_key = p.dim_key AND isodow(e.ts) = p.dow AND hour(e.ts) = p.h),
par AS (SELECT kpi, dim_key, avg(residual) AS mu, stddev_pop(residual) AS sigma
        FROM res GROUP BY 1, 2)
SELECT r.kpi, r.dim_key, r.ts, {rsql('r.value')} AS value, {rsql('r.yhat')} AS yhat,
       {rsql('(r.residual - p.mu) / p.sigma')} AS z
FROM res r JOIN par p ON r.kpi = p.kpi AND r.dim_key = p.dim_key
WHERE abs((r.residual - p.mu) / p.sigma) > 3
""",
)
def flagship_anomalies(spark, d):
    """Anomalous hours of every KPI series against its hour-of-week baseline."""
    scored = residual_anomalies(eh(spark, d))
    return scored.filter("is_anomaly").select(
        "kpi", "dim_key", "ts", rnd("value").alias("value"), rnd("yhat").alias("yhat"),
        rnd("z").alias("z"),
    )
