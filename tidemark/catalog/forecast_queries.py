"""Forecasting queries. Histories are the hourly KPI series as (ds, y)."""

import math

from pyspark.sql import functions as F

from tidemark.catalog.base import (
    EH_RULES,
    EH_SQL,
    GRID_SQL,
    RULES_SQL,
    eh,
    grid,
    query,
    rnd,
    rsql,
    table,
)
from tidemark.functions import calendar
from tidemark.operators import forecast as fc
from tidemark.operators import joins
from tidemark.operators.baseline import apply_profile, seasonal_profile
from tidemark.plans import forecasting as plans
from tidemark.schema import KPI_RULE, SERIES

HIST_SQL = EH_SQL + ", hist AS (SELECT kpi, dim_key, ts AS ds, value AS y FROM eh)"
W = "(PARTITION BY kpi, dim_key ORDER BY ds)"


def history(spark, d):
    return eh(spark, d).select(*SERIES, F.col("ts").alias("ds"), F.col("value").alias("y"))


def rules(spark):
    return spark.createDataFrame(EH_RULES, KPI_RULE)


@query(
    "trend_features",
    f"""WITH {HIST_SQL}, r AS (SELECT kpi, dim_key, ds, row_number() OVER {W} - 1 AS i,
         count(*) OVER (PARTITION BY kpi, dim_key) AS n FROM hist),
    c AS (SELECT r.kpi, r.dim_key, j, ds FROM r, range(1, 6) x(j)
          WHERE i = CAST(round_even(j * (floor(n * 0.8) - 1) / 5.0, 0) AS BIGINT)),
    s AS (SELECT kpi, dim_key, epoch(min(ds)) AS a, epoch(max(ds)) AS b FROM hist GROUP BY 1, 2),
    p AS (SELECT kpi, dim_key, {', '.join(f"max(epoch(ds)) FILTER (j = {j}) AS c{j}" for j in range(1, 6))}
          FROM c GROUP BY 1, 2)
    SELECT h.kpi, h.dim_key, h.ds, {rsql('(epoch(ds) - a) / (b - a)')} AS t,
      {', '.join(f"{rsql(f'greatest(0, (epoch(ds) - c{j}) / (b - a))')} AS h{j}" for j in range(1, 6))}
    FROM hist h JOIN s ON h.kpi = s.kpi AND h.dim_key = s.dim_key
    JOIN p ON h.kpi = p.kpi AND h.dim_key = p.dim_key""",
)
def trend_features(spark, d):
    out = fc.trend_features(history(spark, d), n=5, share=0.8)
    hinges = [rnd(F.col("hinges")[j - 1]).alias(f"h{j}") for j in range(1, 6)]
    return out.select(*SERIES, "ds", rnd("t").alias("t"), *hinges)


def fourier_sql(period, order, name, mask=""):
    terms = []
    for n in range(1, order + 1):
        angle = f"({2.0 * math.pi * n / period!r} * (epoch(ds) / 86400.0))"
        terms.append(f"{rsql(f'sin{angle}{mask}')} AS {name}_s{n}")
        terms.append(f"{rsql(f'cos{angle}{mask}')} AS {name}_c{n}")
    return ", ".join(terms)


def fourier_names(order, name):
    return [f"{name}_{f}{n}" for n in range(1, order + 1) for f in "sc"]


@query(
    "fourier_features",
    f"""WITH {HIST_SQL} SELECT kpi, dim_key, ds, {fourier_sql(1.0, 3, 'daily')},
    {fourier_sql(7.0, 5, 'weekly')} FROM hist""",
)
def fourier_features(spark, d):
    ds = F.col("ds")
    daily = zip(calendar.fourier_features(ds, 1.0, 3), fourier_names(3, "daily"), strict=True)
    weekly = zip(calendar.fourier_features(ds, 7.0, 5), fourier_names(5, "weekly"), strict=True)
    return history(spark, d).select(
        *SERIES, "ds", *[rnd(c).alias(n) for c, n in (*daily, *weekly)]
    )


@query(
    "conditional_seasonality",
    f"""WITH {HIST_SQL} SELECT kpi, dim_key, ds,
    {fourier_sql(1.0, 3, 'weekday', ' * (isodow(ds) < 6)::INT')},
    {fourier_sql(1.0, 3, 'weekend', ' * (isodow(ds) >= 6)::INT')} FROM hist""",
)
def conditional_seasonality(spark, d):
    names = fourier_names(3, "weekday") + fourier_names(3, "weekend")
    terms = calendar.conditional_seasonality(F.col("ds"), 3)
    return history(spark, d).select(
        *SERIES, "ds", *[rnd(c).alias(n) for c, n in zip(terms, names, strict=True)]
    )


NTH = "CAST((day(ds) + 6) // 7 AS INT)"


@query(
    "holiday_features",
    f"""WITH h AS (SELECT o_orderkey, o_orderdate AS ds FROM orders)
    SELECT o_orderkey, ds, CASE
      WHEN month(ds) = 1 AND day(ds) = 1 THEN 'new_year'
      WHEN month(ds) = 1 AND isodow(ds) = 1 AND {NTH} = 3 THEN 'martin_luther_king'
      WHEN month(ds) = 2 AND isodow(ds) = 1 AND {NTH} = 3 THEN 'washington'
      WHEN month(ds) = 5 AND isodow(ds) = 1 AND day(ds) > 24 THEN 'memorial'
      WHEN month(ds) = 6 AND day(ds) = 19 AND year(ds) >= 2021 THEN 'juneteenth'
      WHEN month(ds) = 7 AND day(ds) = 4 THEN 'independence'
      WHEN month(ds) = 9 AND isodow(ds) = 1 AND {NTH} = 1 THEN 'labor'
      WHEN month(ds) = 10 AND isodow(ds) = 1 AND {NTH} = 2 THEN 'columbus'
      WHEN month(ds) = 11 AND day(ds) = 11 THEN 'veterans'
      WHEN month(ds) = 11 AND isodow(ds) = 4 AND {NTH} = 4 THEN 'thanksgiving'
      WHEN month(ds) = 12 AND day(ds) = 25 THEN 'christmas' END AS holiday FROM h""",
)
def holiday_features(spark, d):
    """Order dates span several years, so every rule fires."""
    flags = calendar.us_holiday(F.col("ds"))
    name = F.coalesce(*[F.when(flag == 1.0, n) for n, flag in flags.items()])
    return table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("ds")
    ).select("o_orderkey", "ds", name.alias("holiday"))


SEASONAL_ONE = [plans.SEASONAL_GRID[20]]


@query("fit_forecaster")
def fit_forecaster(spark, d):
    """All 48 seasonal parameter sets on every series."""
    models = fc.fit_forecaster(history(spark, d), plans.SEASONAL_GRID)
    return models.select(
        *SERIES, "p_id", "mode", rnd("k").alias("k"), rnd("m").alias("m"),
        F.size("deltas").alias("n_changepoints"), F.size("beta").alias("n_terms"),
    )


COMPONENTS = ["yhat", "trend", "additive_terms", "multiplicative_terms", "holidays", "daily", "weekly"]


@query("predict_forecaster")
def predict_forecaster(spark, d):
    h = history(spark, d)
    models = fc.fit_forecaster(h, SEASONAL_ONE)
    out = fc.predict_forecaster(fc.make_future(h), models)
    return out.select(*SERIES, "ds", "p_id", *[rnd(c).alias(c) for c in COMPONENTS])


@query(
    "make_future",
    f"""WITH {HIST_SQL}, e AS (SELECT kpi, dim_key, max(ds) AS hi FROM hist GROUP BY 1, 2)
    SELECT kpi, dim_key, ds FROM hist UNION ALL
    SELECT kpi, dim_key, unnest(generate_series(hi + INTERVAL 1 HOUR, hi + INTERVAL 168 HOUR,
                                INTERVAL 1 HOUR)) FROM e""",
)
def make_future(spark, d):
    return fc.make_future(history(spark, d))


@query(
    "time_spine",
    """SELECT dim_key, unnest(generate_series(a, b - INTERVAL 5 MINUTE, INTERVAL 5 MINUTE)) AS ds FROM (
    SELECT event_type AS dim_key, date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b
    FROM events GROUP BY 1)""",
)
def time_spine(spark, d):
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    spans = table(spark, d, "events").groupBy(F.col("event_type").alias("dim_key")).agg(
        F.min(day).alias("start"), F.max(day).alias("end")
    )
    return fc.time_spine(spans)


@query(
    "param_grid",
    f"""WITH {EH_SQL} SELECT k.kpi, cps, share FROM (SELECT DISTINCT kpi FROM eh) k,
    (SELECT unnest([0.01, 0.1, 1.0]::DOUBLE[]) AS cps) a,
    (SELECT unnest([0.8, 0.9, 0.95]::DOUBLE[]) AS share) b""",
)
def param_grid(spark, d):
    kpis = eh(spark, d).select("kpi").distinct()
    return joins.param_product(kpis, plans.TREND_GRID).select(
        "kpi", F.col("changepoint_prior_scale").alias("cps"),
        F.col("changepoint_range").alias("share"),
    )


def regime_frame(spark, d):
    """Regimes as if the series' missing ratio followed its sample variety."""
    return history(spark, d).groupBy(*SERIES).agg(
        (1 - F.count("y") / F.lit(720)).alias("missing"),
        F.timestamp_diff("DAY", F.min("ds"), F.max("ds")).alias("days"),
    )


@query(
    "cv_cutoffs",
    f"""WITH {HIST_SQL}, s AS (SELECT kpi, dim_key, min(ds) AS a, max(ds) AS b FROM hist GROUP BY 1, 2),
    g AS (SELECT kpi, dim_key, a, b, unnest(range(0, 40)) AS n FROM s)
    SELECT kpi, dim_key, b - INTERVAL 48 HOUR - to_hours(n * 48) AS cutoff FROM g
    WHERE b - INTERVAL 48 HOUR - to_hours(n * 48) >= a + INTERVAL 16 DAY""",
)
def cv_cutoffs(spark, d):
    regimes = regime_frame(spark, d).select(
        *SERIES, fc.cv_regime(F.lit(0.1), F.col("days")).alias("r")
    ).select(*SERIES, "r.*")
    return fc.cv_cutoffs(history(spark, d), regimes).select(*SERIES, "cutoff")


@query(
    "cv_regime",
    f"""WITH {HIST_SQL}, day AS (SELECT kpi, dim_key, dayofyear(ds) AS doy, count(*) / 24.0 AS share
         FROM hist GROUP BY 1, 2, 3)
    SELECT kpi, dim_key, CAST(doy AS INT) AS days, {rsql('1 - share')} AS missing,
      CAST(CASE WHEN round(1 - share, 6) < 0.15 THEN 384 WHEN doy > 14 AND doy < 18 THEN 336
           WHEN doy > 14 THEN 384 END AS DOUBLE) AS initial,
      CAST(CASE WHEN round(1 - share, 6) < 0.15 THEN 48 WHEN doy > 14 THEN 24 END AS DOUBLE) AS horizon,
      CAST(CASE WHEN round(1 - share, 6) < 0.15 THEN 48 WHEN doy > 14 THEN 24 END AS DOUBLE) AS period
    FROM day""",
)
def cv_regime(spark, d):
    """Each day of each series stands for one history length, so all branches are met."""
    days = history(spark, d).groupBy(*SERIES, F.dayofyear("ds").alias("days")).agg(
        rnd(1 - F.count("y") / 24.0).alias("missing")
    )
    return days.select(
        *SERIES, "days", "missing", fc.cv_regime(F.col("missing"), F.col("days")).alias("r")
    ).select(
        *SERIES, "days", "missing",
        *[F.col(f"r.{c}").cast("double").alias(c) for c in ("initial", "horizon", "period")],
    )


@query("cross_validate")
def cross_validate(spark, d):
    h = history(spark, d)
    cutoffs = fc.cv_cutoffs(h, plans.regimes(h))
    out = fc.cross_validate(h, cutoffs, plans.TREND_FIT_GRID)
    return out.select(*SERIES, "cutoff", "p_id", "ds", rnd("y").alias("y"), rnd("yhat").alias("yhat"))


# A deterministic stand-in forecast: the hour-of-week mean, used where SQL must follow.
PROFILE_SQL = (
    HIST_SQL
    + """, prof AS (SELECT kpi, dim_key, isodow(ds) AS dw, hour(ds) AS h, avg(y) AS yhat
      FROM hist GROUP BY 1, 2, 3, 4),
    fut AS (SELECT kpi, dim_key, ds FROM hist UNION ALL
      SELECT kpi, dim_key, unnest(generate_series(hi + INTERVAL 1 HOUR, hi + INTERVAL 168 HOUR,
        INTERVAL 1 HOUR)) FROM (SELECT kpi, dim_key, max(ds) AS hi FROM hist GROUP BY 1, 2)),
    sp AS (SELECT kpi, dim_key, min(ds) AS a, max(ds) AS "end", stddev_pop(y) AS sd FROM hist GROUP BY 1, 2),
    fc AS (SELECT f.kpi, f.dim_key, f.ds, s."end", s.sd, s.a,
        round(60 - epoch(f.ds - s.a) / 86400.0 * 2.5, 9) AS trend,
        round(p.yhat - 50, 9) AS additive_terms, 0.0::DOUBLE AS holidays, round(p.yhat - 50, 9) AS daily,
        round(60 - epoch(f.ds - s.a) / 86400.0 * 2.5, 9) + round(p.yhat - 50, 9) AS yhat,
        lower, upper
      FROM fut f JOIN sp s ON f.kpi = s.kpi AND f.dim_key = s.dim_key
      JOIN prof p ON f.kpi = p.kpi AND f.dim_key = p.dim_key AND isodow(f.ds) = p.dw AND hour(f.ds) = p.h
      JOIN rules r ON f.kpi = r.kpi)"""
)
PROFILE_SQL = PROFILE_SQL.replace(", prof AS", f", {RULES_SQL}, prof AS")


def stand_in(spark, d):
    """Falling line plus the hour-of-week shape, one week past the history, with context."""
    h = history(spark, d)
    kpi = eh(spark, d)
    span = h.groupBy(*SERIES).agg(F.min("ds").alias("_a"), F.max("ds").alias("end"))
    times = fc.make_future(h).withColumnRenamed("ds", "ts")
    shaped = apply_profile(times, seasonal_profile(kpi)).withColumnRenamed("ts", "ds")
    days = F.timestamp_diff("SECOND", F.col("_a"), F.col("ds")) / 86400.0
    terms = F.round(F.col("yhat") - 50, 9)
    return (
        shaped.join(span, SERIES)
        .withColumn("trend", F.round(60 - days * 2.5, 9))
        .withColumns(
            {
                "additive_terms": terms, "multiplicative_terms": F.lit(0.0),
                "holidays": F.lit(0.0), "daily": terms,
            }
        )
        .withColumn("yhat", fc.recompose())
        .drop("_a")
        .join(F.broadcast(rules(spark).select("kpi", "lower", "upper")), "kpi")
    )


METRICS = ["mse", "rmse", "mae", "mape", "mdape", "smape"]


@query(
    "forecast_metrics",
    f"""WITH {PROFILE_SQL}, e AS (SELECT f.kpi, f.dim_key, h.y, f.yhat FROM fc f JOIN hist h
      ON f.kpi = h.kpi AND f.dim_key = h.dim_key AND f.ds = h.ds)
    SELECT kpi, dim_key, {rsql('avg((y - yhat) * (y - yhat))', 4)} AS mse,
      {rsql('sqrt(avg((y - yhat) * (y - yhat)))', 4)} AS rmse, {rsql('avg(abs(y - yhat))', 4)} AS mae,
      CASE WHEN min(abs(y)) >= 1e-8 THEN {rsql('avg(abs(y - yhat) / nullif(abs(y), 0))', 4)} END AS mape,
      CASE WHEN min(abs(y)) >= 1e-8 THEN
        {rsql('quantile_cont(abs(y - yhat) / nullif(abs(y), 0), 0.5)', 4)} END AS mdape,
      {rsql('avg(coalesce(abs(y - yhat) / nullif((abs(y) + abs(yhat)) / 2, 0), 0))', 4)} AS smape
    FROM e GROUP BY 1, 2""",
)
def forecast_metrics(spark, d):
    joined = stand_in(spark, d).join(history(spark, d), [*SERIES, "ds"])
    out = fc.forecast_metrics(joined, SERIES)
    return out.select(*SERIES, *[rnd(m, 4).alias(m) for m in METRICS])


@query(
    "select_best_params",
    f"""WITH {HIST_SQL}, m AS (SELECT kpi, dim_key, 'p' || hour(ds) AS p_id, avg(abs(y - 40)) AS mae
         FROM hist GROUP BY 1, 2, 3)
    SELECT kpi, dim_key, p_id, {rsql('mae')} AS mae FROM (SELECT *, row_number() OVER
      (PARTITION BY kpi, dim_key ORDER BY round(mae, 9), p_id) AS rn FROM m) WHERE rn = 1""",
)
def select_best_params(spark, d):
    """Hours of the day stand for parameter sets."""
    metrics = history(spark, d).groupBy(
        *SERIES, F.concat(F.lit("p"), F.hour("ds").cast("string")).alias("p_id")
    ).agg(F.round(F.avg(F.abs(F.col("y") - 40)), 9).alias("mae"))
    return fc.select_best_params(metrics).select(*SERIES, "p_id", rnd("mae").alias("mae"))


SHAPE_SQL = """shape AS (SELECT kpi, dim_key,
  avg((yhat < lower)::INT) AS below, avg((yhat > upper)::INT) AS above,
  max_by(trend, ds) AS last_trend FROM fc WHERE ds >= "end" GROUP BY 1, 2)"""


@query(
    "multiplicative_reject",
    f"""WITH {PROFILE_SQL}, {SHAPE_SQL}
    SELECT kpi, dim_key, {rsql('below')} AS below, {rsql('above')} AS above,
      {rsql('last_trend')} AS last_trend,
      last_trend < 0 OR below > 0.1 OR above > 0.1 AS bound_part FROM shape""",
)
def multiplicative_reject(spark, d):
    out = fc.multiplicative_reject(stand_in(spark, d), history(spark, d))
    return out.select(
        *SERIES, *[rnd(c).alias(c) for c in ("below", "above", "last_trend")], "bound_part"
    )


@query(
    "additive_violation",
    f"""WITH {PROFILE_SQL}, {SHAPE_SQL}
    SELECT kpi, dim_key, below > 0.1 AS violation FROM shape""",
)
def additive_violation(spark, d):
    """The stand-in's trend always falls, so only the lower side can be violated."""
    shape = fc.future_shape(stand_in(spark, d))
    return shape.select(*SERIES, fc.additive_violation(shape).alias("violation"))


IQR_SQL = """di AS (SELECT kpi, dim_key, CAST(ds AS DATE) AS day,
    quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS q FROM hist GROUP BY 1, 2, 3),
  iq AS (SELECT kpi, dim_key, quantile_cont(q, 0.5) AS iqr FROM di GROUP BY 1, 2)"""


@query(
    "trend_violation",
    f"""WITH {PROFILE_SQL}, {IQR_SQL}
    SELECT f.kpi, f.dim_key, {rsql('max(iqr)')} AS iqr,
      avg((yhat - iqr < lower)::INT) > 0.1 AS violation
    FROM fc f JOIN iq ON f.kpi = iq.kpi AND f.dim_key = iq.dim_key WHERE ds >= "end" GROUP BY 1, 2""",
)
def trend_violation(spark, d):
    out = fc.trend_violation(stand_in(spark, d), history(spark, d))
    return out.select(*SERIES, rnd("iqr").alias("iqr"), "violation")


@query("significant_changepoint")
def significant_changepoint(spark, d):
    """Of every series under every trend parameter set."""
    h = history(spark, d)
    models = fc.fit_forecaster(h, plans.TREND_FIT_GRID)
    return plans.changepoint_of(models, h, SERIES, ["p_id"])


@query(
    "repair_trend",
    f"""WITH {PROFILE_SQL}, lp AS (SELECT kpi, dim_key, max(ds) FILTER (
        ds >= a + INTERVAL 7 DAY AND trend - 5 > lower AND trend + 5 < upper) AS p FROM fc GROUP BY 1, 2),
    held AS (SELECT fc.kpi, fc.dim_key, p, trend AS tr FROM fc JOIN lp ON fc.kpi = lp.kpi
             AND fc.dim_key = lp.dim_key AND fc.ds = lp.p)
    SELECT f.kpi, f.dim_key, f.ds, {rsql('CASE WHEN f.ds > h.p THEN h.tr ELSE f.trend END')} AS trend,
      {rsql('CASE WHEN f.ds > h.p THEN h.tr ELSE f.trend END + f.additive_terms')} AS yhat
    FROM fc f LEFT JOIN held h ON f.kpi = h.kpi AND f.dim_key = h.dim_key""",
)
def repair_trend(spark, d):
    forecast = stand_in(spark, d)
    week = F.min("ds") + F.expr("INTERVAL 7 DAYS")
    cp = history(spark, d).groupBy(*SERIES).agg(week.alias("last_changepoint"))
    out = fc.repair_trend(forecast, cp, F.lit(-5.0), F.lit(5.0))
    return out.select(*SERIES, "ds", rnd("trend").alias("trend"), rnd("yhat").alias("yhat"))


@query(
    "forecast_results",
    f"""WITH {PROFILE_SQL} SELECT f.kpi, f.dim_key, f.ds, {rsql('y')} AS ground_truth, {rsql('yhat')} AS pred,
      {rsql('(y - yhat) / sd')} AS error, {rsql('y - trend')} AS gt_wo_trend,
      {rsql('yhat - trend')} AS pred_wo_trend,
      {rsql('y - trend - holidays - daily')} AS ground_truth_noise,
      {rsql('yhat - trend - holidays - daily')} AS pred_noise
    FROM fc f LEFT JOIN hist h ON f.kpi = h.kpi AND f.dim_key = h.dim_key AND f.ds = h.ds""",
)
def forecast_results(spark, d):
    out = fc.forecast_results(stand_in(spark, d), history(spark, d))
    cols = ["ground_truth", "pred", "error", "gt_wo_trend", "pred_wo_trend",
            "ground_truth_noise", "pred_noise"]
    return out.select(*SERIES, "ds", *[rnd(c).alias(c) for c in cols])


@query(
    "split_past_future",
    f"""WITH {PROFILE_SQL} SELECT f.kpi, f.dim_key, f.ds, h.y IS NULL AS is_future
    FROM fc f LEFT JOIN hist h ON f.kpi = h.kpi AND f.dim_key = h.dim_key AND f.ds = h.ds""",
)
def split_past_future(spark, d):
    times = fc.make_future(history(spark, d))
    past, future = joins.split_past_future(times, history(spark, d), [*SERIES, "ds"])
    return past.withColumn("is_future", F.lit(False)).unionByName(
        future.withColumn("is_future", F.lit(True))
    )


@query(
    "seasonal_profile",
    f"""WITH {GRID_SQL}, p AS (SELECT kpi, dim_key, isodow(ts) AS dw, hour(ts) AS h, avg(value) AS yhat
      FROM eh GROUP BY 1, 2, 3, 4)
    SELECT g.kpi, g.dim_key, g.ts, {rsql('yhat')} AS yhat FROM grid g JOIN p ON g.kpi = p.kpi
      AND g.dim_key = p.dim_key AND isodow(g.ts) = p.dw AND hour(g.ts) = p.h""",
)
def seasonal_profile_query(spark, d):
    out = apply_profile(grid(spark, d).drop("value"), seasonal_profile(eh(spark, d)))
    return out.select(*SERIES, "ts", rnd("yhat").alias("yhat"))


RESULTS = ["ground_truth", "pred", "error", "trend", "gt_wo_trend", "pred_wo_trend"]


@query("forecast_trend")
def forecast_trend(spark, d):
    """Tune on the trend grid, refit, repair and score every series."""
    h = history(spark, d)
    out = plans.forecast_trend(h, plans.tune(h, plans.TREND_FIT_GRID), rules(spark))
    return out.select(*SERIES, "ds", *[rnd(c).alias(c) for c in RESULTS])


@query("forecast_seasonal")
def forecast_seasonal(spark, d):
    """Tune on the 48-set seasonal grid, refit, reject, repair and score every series."""
    h = history(spark, d)
    out = plans.forecast_seasonal(h, plans.tune(h, plans.SEASONAL_GRID), rules(spark))
    return out.select(*SERIES, "ds", *[rnd(c).alias(c) for c in RESULTS])

