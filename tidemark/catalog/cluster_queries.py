"""Point, neighbour, clustering and classification queries on last week's points."""

from pyspark.sql import functions as F

from tidemark.catalog.base import EH_SQL, eh, query, rnd, rsql
from tidemark.operators import cluster, kernel, neighbors
from tidemark.schema import SERIES
from tidemark.session import cut

RECENT_SQL = (
    EH_SQL
    + """,
recent AS (SELECT * FROM eh WHERE ts >= (SELECT max(ts) FROM eh) - INTERVAL 7 DAY),
qs AS (SELECT kpi, dim_key, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
       quantile_cont(value, 0.75) AS q3 FROM recent GROUP BY 1, 2),
sc AS (SELECT r.kpi, r.dim_key, r.ts, r.value,
       row_number() OVER (PARTITION BY r.kpi, r.dim_key ORDER BY ts) - 1 AS idx,
       (value - q2) / CASE WHEN q3 - q1 = 0 THEN 1 ELSE q3 - q1 END AS scaled
       FROM recent r JOIN qs ON r.kpi = qs.kpi AND r.dim_key = qs.dim_key),
wd AS (SELECT kpi, quantile_cont(scaled, 0.95) - quantile_cont(scaled, 0.05) AS w FROM sc GROUP BY 1)"""
)
PTS_SQL = (
    RECENT_SQL
    + f""",
pts AS MATERIALIZED (SELECT s.kpi, dim_key || '/' || lpad(CAST(idx AS VARCHAR), 5, '0') AS id, dim_key,
        CAST(idx AS INT) AS idx, {rsql('idx / 163.0 * w')} AS x, {rsql('scaled')} AS y
        FROM sc s JOIN wd ON s.kpi = wd.kpi)"""
)
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def knn_sql(name, a, b, k, where="true", dist=DIST, extra=""):
    return f"""{name} AS MATERIALIZED (SELECT * FROM (
      SELECT a.kpi, a.id, b.id AS neighbor, {dist} AS d{extra}, row_number() OVER (
        PARTITION BY a.kpi, a.id ORDER BY {dist}, b.id) AS rk
      FROM {a} a JOIN {b} b ON a.kpi = b.kpi WHERE {where}) WHERE rk <= {k})"""


def points(spark, d):
    """Points without jitter, rounded so that both engines see the same coordinates."""
    pts = cluster.build_points(eh(spark, d), jitter_seed=None)
    return cut(pts.withColumns({"x": rnd("x"), "y": rnd("y")}))


@query(
    "robust_scale",
    f"""WITH {RECENT_SQL} SELECT kpi, dim_key, ts, {rsql('scaled')} AS scaled FROM sc""",
)
def robust_scale(spark, d):
    from tidemark.operators.joins import trailing_window

    out = cluster.robust_scale(trailing_window(eh(spark, d)))
    return out.select(*SERIES, "ts", rnd("scaled").alias("scaled"))


@query(
    "time_axis_scale",
    f"""WITH {RECENT_SQL} SELECT s.kpi, dim_key, ts, {rsql('idx / 163.0 * w')} AS x
    FROM sc s JOIN wd ON s.kpi = wd.kpi""",
)
def time_axis_scale(spark, d):
    from tidemark.operators.joins import trailing_window
    from tidemark.operators.reshape import row_index

    scaled = cluster.robust_scale(trailing_window(eh(spark, d)))
    out = cluster.time_axis_scale(scaled.withColumn("idx", row_index(SERIES)))
    return out.select(*SERIES, "ts", rnd("x").alias("x"))


@query("build_points", f"WITH {PTS_SQL} SELECT kpi, id, dim_key, idx, x, y FROM pts")
def build_points(spark, d):
    return points(spark, d).select("kpi", "id", "dim_key", "idx", "x", "y")


@query("build_points_jittered")
def build_points_jittered(spark, d):
    out = cluster.build_points(eh(spark, d), jitter_seed=7)
    return out.select("kpi", "id", "dim_key", "idx", rnd("x").alias("x"), rnd("y").alias("y"))


@query(
    "knn_join",
    f"""WITH {PTS_SQL}, {knn_sql('nn', 'pts', 'pts', 5)}
    SELECT kpi, id, CAST(rk AS INT) AS rank, neighbor, {rsql('d')} AS distance FROM nn""",
)
def knn_join(spark, d):
    pts = points(spark, d)
    out = neighbors.knn_join(pts, pts, ["kpi"], 5)
    return out.select("kpi", "id", "rank", "neighbor", rnd("distance").alias("distance"))


@query(
    "knn_join_manhattan",
    f"""WITH {PTS_SQL}, {knn_sql('nn', 'pts', 'pts', 3, "b.dim_key <> 'error'",
                                 'abs(a.x - b.x) + abs(a.y - b.y)')}
    SELECT kpi, id, CAST(rk AS INT) AS rank, neighbor, {rsql('d')} AS distance FROM nn""",
)
def knn_join_manhattan(spark, d):
    pts = points(spark, d)
    out = neighbors.knn_join(
        pts, pts.filter("dim_key <> 'error'"), ["kpi"], 3, metric="manhattan"
    )
    return out.select("kpi", "id", "rank", "neighbor", rnd("distance").alias("distance"))


CURVE_SQL = f"""{knn_sql('nn', 'pts', 'pts', 5)},
  kth AS (SELECT kpi, id, d AS kth FROM nn WHERE rk = 5),
  curve AS (SELECT kpi, kth, CAST(sum(count(*)) OVER (PARTITION BY kpi ORDER BY kth) AS BIGINT) AS rank
            FROM kth GROUP BY kpi, kth)"""


@query(
    "knn_distance_curve",
    f"WITH {PTS_SQL}, {CURVE_SQL} SELECT kpi, {rsql('kth', 9)} AS kth, rank FROM curve",
)
def knn_distance_curve(spark, d):
    out = cluster.knn_distance_curve(points(spark, d))
    return out.select("kpi", rnd("kth", 9).alias("kth"), "rank")


EPS_SQL = """ee AS (SELECT kpi, min(rank) AS x0, max(rank) AS x1, min(kth) AS y0, max(kth) AS y1
    FROM curve GROUP BY 1),
  rot AS (SELECT c.kpi, c.kth, c.rank, round((kth - y0) / (y1 - y0) * cos(pi() / 4)
      - (rank - x0) / CAST(x1 - x0 AS DOUBLE) * sin(pi() / 4), 9) AS up
    FROM curve c JOIN ee ON c.kpi = ee.kpi),
  eps AS MATERIALIZED (SELECT kpi, kth AS eps FROM (SELECT *, row_number() OVER (
      PARTITION BY kpi ORDER BY up, rank) AS rn FROM rot) WHERE rn = 1)"""


@query(
    "dbscan_eps",
    f"WITH {PTS_SQL}, {CURVE_SQL}, {EPS_SQL} SELECT kpi, {rsql('eps')} AS eps FROM eps",
)
def dbscan_eps(spark, d):
    return cluster.dbscan_eps(points(spark, d)).select("kpi", rnd("eps").alias("eps"))


@query(
    "dbscan_core",
    f"""WITH {PTS_SQL}, {CURVE_SQL}, {EPS_SQL}
    SELECT k.kpi, k.id, kth <= eps AS is_core FROM kth k JOIN eps e ON k.kpi = e.kpi""",
)
def dbscan_core(spark, d):
    pts = points(spark, d)
    return cluster.core_points(pts, cluster.dbscan_eps(pts)).select("kpi", "id", "is_core")


@query("dbscan")
def dbscan(spark, d):
    pts = points(spark, d)
    out = cluster.dbscan(pts, cut(cluster.dbscan_eps(pts)))
    return out.select("kpi", "id", rnd("x").alias("x"), rnd("y").alias("y"), "label")


# Stand-in labels for the reduction steps: one minor cluster and two-sided noise.
LAB_SQL = (
    PTS_SQL
    + """,
lab AS MATERIALIZED (SELECT *, CASE WHEN dim_key = 'view' AND idx BETWEEN 30 AND 120 AND y > 0.3
    THEN 'minor' WHEN y > 1.1 OR y < -0.95 THEN '-1' ELSE 'main' END AS label FROM pts)"""
)


def labelled(spark, d):
    y = F.col("y")
    minor = (F.col("dim_key") == "view") & F.col("idx").between(30, 120) & (y > 0.3)
    label = F.when(minor, "minor").when((y > 1.1) | (y < -0.95), "-1").otherwise("main")
    return points(spark, d).withColumn("label", label)


NEAR_SQL = f"""hi AS (SELECT kpi, quantile_cont(y, 0.975) AS h FROM lab GROUP BY 1),
  ask AS MATERIALIZED (SELECT l.* FROM lab l JOIN hi ON l.kpi = hi.kpi WHERE label = '-1' AND y < h),
  {knn_sql('n1', 'ask', 'lab', 5, "b.label = 'main'")}, {knn_sql('n2', 'ask', 'lab', 5, "b.label = '-1'")},
  chg AS (SELECT kpi, id FROM (SELECT kpi, id, avg(d) AS d1 FROM n1 GROUP BY 1, 2)
          JOIN (SELECT kpi, id, avg(d) AS d2 FROM n2 GROUP BY 1, 2) USING (kpi, id) WHERE d1 < d2)"""


@query(
    "reassign_near_outliers",
    f"""WITH {LAB_SQL}, {NEAR_SQL}
    SELECT l.kpi, l.id, CASE WHEN c.id IS NOT NULL THEN 'main' ELSE l.label END AS label
    FROM lab l LEFT JOIN chg c ON l.kpi = c.kpi AND l.id = c.id""",
)
def reassign_near_outliers(spark, d):
    lab = labelled(spark, d)
    out = cluster.reassign_near_outliers(lab, cluster.main_label(lab))
    return out.select("kpi", "id", "label")


@query(
    "one_sided_outliers",
    f"""WITH {LAB_SQL}, m AS (SELECT kpi, quantile_cont(y, 0.5) AS mid FROM lab WHERE label = 'main' GROUP BY 1),
    s AS (SELECT l.kpi, count(*) FILTER (y > mid) AS na, count(*) FILTER (y < mid) AS nb
          FROM lab l JOIN m ON l.kpi = m.kpi WHERE label = '-1' GROUP BY 1)
    SELECT l.kpi, l.id, CASE WHEN label = '-1' AND na > 0 AND nb > 0
      AND ((na > nb AND y < mid) OR (na <= nb AND y > mid)) THEN 'main' ELSE label END AS label
    FROM lab l LEFT JOIN m ON l.kpi = m.kpi LEFT JOIN s ON l.kpi = s.kpi""",
)
def one_sided_outliers(spark, d):
    lab = labelled(spark, d)
    return cluster.one_sided_outliers(lab, cluster.main_label(lab)).select("kpi", "id", "label")


@query(
    "reassign_between",
    f"""WITH {LAB_SQL}, c AS (SELECT kpi, avg(y) AS cy FROM lab WHERE label = 'main' GROUP BY 1),
    o AS (SELECT kpi, avg(y) AS my, min(x) AS x0, max(x) AS x1 FROM lab WHERE label = 'minor' GROUP BY 1),
    nz AS (SELECT *, y * 0.4 AS yy FROM lab),
    ask AS MATERIALIZED (SELECT n.kpi, n.id, n.x, n.yy AS y FROM nz n JOIN c ON n.kpi = c.kpi
      JOIN o ON n.kpi = o.kpi WHERE n.label = '-1' AND n.yy > least(my, cy) AND n.yy < greatest(my, cy)
      AND n.x > x0 AND n.x < x1),
    {knn_sql('n1', 'ask', 'lab', 3, "b.label = 'main'")}, {knn_sql('n2', 'ask', 'lab', 3, "b.label = '-1'")}
    SELECT kpi, id, CASE WHEN d2 >= d1 THEN 'main' ELSE '-1' END AS new_label
    FROM (SELECT kpi, id, avg(d) AS d1 FROM n1 GROUP BY 1, 2)
    JOIN (SELECT kpi, id, avg(d) AS d2 FROM n2 GROUP BY 1, 2) USING (kpi, id)""",
)
def reassign_between(spark, d):
    """Noise is pulled towards the centre so that some of it falls between the clusters."""
    lab = labelled(spark, d)
    minor = lab.filter("label = 'minor'").select("kpi", F.col("label").alias("minor")).distinct()
    noise = lab.filter("label = '-1'").withColumn("y", F.col("y") * 0.4)
    return cluster.reassign_between(lab, cluster.main_label(lab), minor, noise)


@query(
    "hull_boundary",
    f"""WITH {LAB_SQL}, loc AS MATERIALIZED (SELECT kpi, label, x, y, min(id) AS id FROM lab
      WHERE label <> '-1' GROUP BY 1, 2, 3, 4),
    {knn_sql('nn', 'loc', 'loc', 9, "a.label = b.label", extra=", a.label, a.x, a.y, atan2(b.y - a.y, b.x - a.x) AS t")},
    g AS (SELECT *, t - lag(t) OVER w AS step, first_value(t) OVER w AS t0 FROM nn WHERE d > 0
          WINDOW w AS (PARTITION BY kpi, label, id ORDER BY t)),
    h AS (SELECT kpi, label, id, x, y, greatest(min(t0) - max(t) + 2 * pi(), coalesce(max(step), 0)) AS gap
          FROM g GROUP BY 1, 2, 3, 4, 5)
    SELECT kpi, label, id, {rsql('x')} AS x, {rsql('y')} AS y, {rsql('gap')} AS gap FROM h WHERE gap > 5 * pi() / 6""",
)
def hull_boundary(spark, d):
    lab = labelled(spark, d).filter("label <> '-1'")
    out = cluster.hull_boundary(lab)
    return out.select("kpi", "label", "id", *[rnd(c).alias(c) for c in ("x", "y", "gap")])


@query("merge_minor_clusters")
def merge_minor_clusters(spark, d):
    lab = labelled(spark, d)
    out = cluster.merge_minor_clusters(lab, cut(cluster.main_label(lab)))
    return out.select("kpi", "id", "label")


@query(
    "binary_outlier_label",
    f"""WITH {LAB_SQL} SELECT kpi, id, CAST(CASE WHEN label = '-1' THEN 0 ELSE 1 END AS INT) AS merged
    FROM lab""",
)
def binary_outlier_label(spark, d):
    lab = labelled(spark, d)
    out = cluster.binary_outlier_label(lab, cluster.main_label(lab))
    return out.select("kpi", "id", "merged")


@query("merge_clusters")
def merge_clusters(spark, d):
    """All reduction steps in order, from the stand-in labels."""
    return cluster.merge_clusters(labelled(spark, d)).select("kpi", "id", "label", "merged")


BORDER_SQL = """mg AS MATERIALIZED (SELECT *, CASE WHEN label = '-1' THEN 0 ELSE 1 END AS merged FROM lab),
  side AS (SELECT kpi, avg(y) FILTER (merged = 1) > avg(y) FILTER (merged = 0) AS below FROM mg GROUP BY 1),
  env AS (SELECT m.kpi, m.idx, max(x) AS x, below, CASE WHEN below THEN min(y) ELSE max(y) END AS e
          FROM mg m JOIN side s ON m.kpi = s.kpi WHERE merged = 1 GROUP BY m.kpi, m.idx, below),
  sm AS (SELECT *, CASE WHEN count(e) OVER w = 7 THEN avg(e) OVER w END AS s FROM env
         WINDOW w AS (PARTITION BY kpi ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  gp AS (SELECT *, max(abs(s - e)) OVER (PARTITION BY kpi) AS g FROM sm WHERE s IS NOT NULL),
  brd AS MATERIALIZED (
    SELECT kpi, 'out/' || lpad(CAST(idx AS VARCHAR), 5, '0') AS id, x,
           CASE WHEN below THEN s - g ELSE s + g END AS y, 0 AS merged FROM gp
    UNION ALL SELECT kpi, 'border/' || lpad(CAST(idx AS VARCHAR), 5, '0'), x, s, 1 FROM gp)"""


def merged_points(spark, d):
    merged = F.when(F.col("label") == "-1", 0).otherwise(1)
    return labelled(spark, d).withColumn("merged", merged)


@query(
    "border_points",
    f"""WITH {LAB_SQL}, {BORDER_SQL} SELECT kpi, id, {rsql('x')} AS x, {rsql('y')} AS y,
    CAST(merged AS INT) AS merged FROM brd""",
)
def border_points(spark, d):
    out = cluster.border_points(merged_points(spark, d))
    return out.select("kpi", "id", rnd("x").alias("x"), rnd("y").alias("y"), "merged")


@query("smote")
def smote(spark, d):
    out = cluster.smote(merged_points(spark, d), ratio=0.6)
    return out.select("kpi", "id", rnd("x").alias("x"), rnd("y").alias("y"), "merged")


SCALED_SQL = """tr AS (SELECT kpi, id, x, y, merged FROM mg WHERE dim_key <> 'error'),
  pr AS (SELECT kpi, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM tr GROUP BY 1),
  ts AS MATERIALIZED (SELECT t.kpi, id, round((x - mx) / sx, 9) AS x, round((y - my) / sy, 9) AS y, merged
                      FROM tr t JOIN pr ON t.kpi = pr.kpi)"""


def voted(name, dist):
    return f"""SELECT kpi, id, CAST(min_by(merged, struct_pack(a := -n, b := merged)) AS INT) AS prediction
    FROM (SELECT kpi, id, merged, count(*) AS n FROM {name} GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query(
    "knn_classify",
    f"""WITH {LAB_SQL}, {BORDER_SQL}, {SCALED_SQL},
    qy AS MATERIALIZED (SELECT m.kpi, id, round((x - mx) / sx, 9) AS x, round((y - my) / sy, 9) AS y
          FROM mg m JOIN pr ON m.kpi = pr.kpi WHERE dim_key = 'error'),
    {knn_sql('nn', 'qy', 'ts', 5, extra=', b.merged')} {voted('nn', DIST)}""",
)
def knn_classify(spark, d):
    """Classify one event type's points from those of the others."""
    pts = merged_points(spark, d)
    out = cluster.knn_classify(
        pts.filter("dim_key <> 'error'"), pts.filter("dim_key = 'error'"), k=5
    )
    return out.select("kpi", "id", F.col("prediction").cast("int").alias("prediction"))


@query("rbf_svm_grid")
def rbf_svm_grid(spark, d):
    """Grid search of all KPIs in one job; the table has five event types, hence that minimum."""
    out = kernel.rbf_svm_grid(merged_points(spark, d), min_series=5)
    return out.select("kpi", "gamma", rnd("accuracy", 3).alias("accuracy"), "chosen")


@query("rbf_svm_mesh")
def rbf_svm_mesh(spark, d):
    """Class over a mesh by the classifier refitted with the chosen gamma."""
    pts = cut(merged_points(spark, d))
    out = kernel.rbf_svm_predict(cluster.decision_grid(pts, 0.25), cut(kernel.rbf_svm_grid(pts, min_series=5)))
    return out.select("kpi", "id", rnd("x").alias("x"), rnd("y").alias("y"), "prediction")


MESH_SQL = """bx AS (SELECT kpi, min(x) AS x0, max(x) AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1
    FROM pts GROUP BY 1),
  mi AS (SELECT kpi, x0, y0, y1, unnest(range(0, CAST(ceil((x1 - x0) / 0.25) AS BIGINT))) AS i FROM bx),
  mesh AS MATERIALIZED (SELECT kpi, CAST(i AS VARCHAR) || '/' || CAST(j AS VARCHAR) AS id,
    x0 + i * 0.25::DOUBLE AS x, y0 + j * 0.25::DOUBLE AS y FROM (SELECT *, unnest(range(0,
      CAST(ceil((y1 - y0) / 0.25) AS BIGINT))) AS j FROM mi))"""


@query(
    "decision_grid",
    f"""WITH {LAB_SQL}, {BORDER_SQL}, {MESH_SQL},
    tall AS (SELECT kpi, id, x, y, merged FROM mg UNION ALL SELECT * FROM brd),
    pr AS (SELECT kpi, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy
           FROM tall GROUP BY 1),
    ts AS MATERIALIZED (SELECT t.kpi, id, round((x - mx) / sx, 9) AS x, round((y - my) / sy, 9) AS y, merged
                        FROM tall t JOIN pr ON t.kpi = pr.kpi),
    qy AS MATERIALIZED (SELECT m.kpi, id, round((x - mx) / sx, 9) AS x, round((y - my) / sy, 9) AS y
                        FROM mesh m JOIN pr ON m.kpi = pr.kpi),
    {knn_sql('nn', 'qy', 'ts', 5, extra=', b.merged')}, v AS ({voted('nn', DIST)})
    SELECT v.kpi, v.id, {rsql('m.x')} AS x, {rsql('m.y')} AS y, prediction
    FROM v JOIN mesh m ON v.kpi = m.kpi AND v.id = m.id""",
)
def decision_grid(spark, d):
    """Class over a mesh, from the points and their border rows."""
    pts = cut(merged_points(spark, d))
    mesh = cluster.decision_grid(pts, 0.25)
    out = cluster.knn_classify(cut(cluster.training_points(pts)), mesh, k=5)
    return out.select(
        "kpi", "id", rnd("x").alias("x"), rnd("y").alias("y"),
        F.col("prediction").cast("int").alias("prediction"),
    )
