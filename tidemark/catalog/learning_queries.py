"""Machine learning and pattern mining queries."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.catalog.base import query, rnd, rsql, table
from tidemark.operators import aggregates, learning
from tidemark.session import cut

DIMS = 64  # elements of an embedding


def vectors(spark, d):
    return learning.vectorize(table(spark, d, "embeddings"), "embedding")


@query(
    "assemble_features",
    f"""SELECT vec_id, CAST({DIMS} AS INT) AS size, {rsql(f'list_sum(embedding[1:{DIMS}]::DOUBLE[])')} AS total
    FROM embeddings""",
)
def assemble_features(spark, d):
    cols = [F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(DIMS)]
    wide = table(spark, d, "embeddings").select("vec_id", *cols)
    out = learning.assemble_features(wide, [f"f{i}" for i in range(DIMS)])
    parts = vector_to_array("features")
    total = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
    return out.select("vec_id", F.size(parts).alias("size"), rnd(total).alias("total"))


@query("kmeans")
def kmeans(spark, d):
    data = vectors(spark, d)
    model = learning.kmeans(data, k=3)
    sizes = model.transform(data).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    centres = spark.createDataFrame(
        [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())],
        "prediction int, centre array<double>",
    )
    norm = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda a, v: a + v * v))
    return sizes.join(centres, "prediction").select("prediction", "n", rnd(norm, 4).alias("centre_norm"))


def binary(df):
    return df.withColumn("label", F.when(F.col("label") < 5, 1.0).otherwise(0.0))


@query("logistic_regression")
def logistic_regression(spark, d):
    train, test = learning.train_test_split(binary(vectors(spark, d)), "vec_id")
    model = learning.logistic_regression(train)
    auc = learning.evaluate_auc(model.transform(test))
    scored = learning.accuracy(model.transform(test), "label", "prediction")
    return scored.select(
        rnd("accuracy", 4).alias("accuracy"), "n", rnd(F.lit(auc), 4).alias("auc"),
        rnd(F.lit(float(model.intercept)), 4).alias("intercept"),
    )


@query(
    "train_test_split",
    """SELECT vec_id, label, ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 < 0.7
      AS is_train FROM embeddings""",
)
def train_test_split(spark, d):
    data = table(spark, d, "embeddings").select("vec_id", "label")
    train, test = learning.train_test_split(data, "vec_id", 0.7)
    return train.withColumn("is_train", F.lit(True)).unionByName(
        test.withColumn("is_train", F.lit(False))
    )


@query(
    "auc",
    f"""WITH s AS (SELECT l_quantity * (1 - l_discount) AS score, (l_returnflag = 'R')::INT AS y FROM lineitem),
    g AS (SELECT round(score, 9) AS score, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
          FROM s GROUP BY 1),
    c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score) - neg AS below FROM g)
    SELECT {rsql('sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))')} AS auc FROM c""",
)
def auc(spark, d):
    scored = table(spark, d, "lineitem").select(
        F.round(F.col("l_quantity") * (1 - F.col("l_discount")), 9).alias("score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )
    return aggregates.auc(scored, "score", "label").select(rnd("auc").alias("auc"))


@query(
    "accuracy",
    f"""SELECT {rsql("avg(CAST((l_discount > 0.05) = (l_returnflag = 'R') AS INT))")} AS accuracy,
      CAST(count(*) AS BIGINT) AS n FROM lineitem""",
)
def accuracy(spark, d):
    scored = table(spark, d, "lineitem").select(
        (F.col("l_discount") > 0.05).alias("prediction"), (F.col("l_returnflag") == "R").alias("label")
    )
    out = learning.accuracy(scored, "label", "prediction")
    return out.select(rnd("accuracy").alias("accuracy"), "n")


@query("random_forest")
def random_forest(spark, d):
    """Four features, three classes, 70/30."""
    cols = [F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(4)]
    data = table(spark, d, "embeddings").select(
        "vec_id", (F.col("label") % 3).cast("double").alias("label"), *cols
    )
    train, test = learning.train_test_split(
        learning.assemble_features(data, [f"f{i}" for i in range(4)]), "vec_id"
    )
    model = learning.random_forest(train)
    out = learning.accuracy(model.transform(test), "label", "prediction")
    return out.select(rnd("accuracy", 4).alias("accuracy"), "n")


SUPPORT, CONFIDENCE = 0.02, 0.15
BASKET_SQL = """b AS MATERIALIZED (SELECT DISTINCT l_orderkey AS o, p_brand AS i FROM lineitem
    JOIN part ON l_partkey = p_partkey),
  tot AS (SELECT count(DISTINCT o) AS n FROM b),
  one AS (SELECT i, count(*) AS c FROM b GROUP BY 1),
  two AS (SELECT x.i AS i, y.i AS j, count(*) AS c FROM b x JOIN b y ON x.o = y.o AND x.i <> y.i GROUP BY 1, 2)"""


def brand_baskets(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return learning.baskets(items.join(parts, "l_partkey"), "l_orderkey", "p_brand")


@query(
    "frequent_itemsets",
    f"""WITH {BASKET_SQL}, u AS (SELECT i AS items, c FROM one UNION ALL
      SELECT i || ',' || j, c FROM two WHERE i < j)
    SELECT items, CAST(c AS BIGINT) AS freq FROM u, tot WHERE c >= ceil({SUPPORT} * n)""",
)
def frequent_itemsets(spark, d):
    """Brand baskets of the orders; at this support no itemset exceeds two brands."""
    model = learning.fp_growth(brand_baskets(spark, d), SUPPORT, CONFIDENCE)
    return model.freqItemsets.select(F.array_join(F.array_sort("items"), ",").alias("items"), "freq")


@query(
    "association_rules",
    f"""WITH {BASKET_SQL} SELECT t.i AS antecedent, t.j AS consequent, {rsql('t.c / a.c')} AS confidence,
      {rsql('(t.c / a.c) / (b1.c / n)')} AS lift, {rsql('t.c / n')} AS support
    FROM two t JOIN one a ON t.i = a.i JOIN one b1 ON t.j = b1.i, tot
    WHERE t.c >= ceil({SUPPORT} * n) AND t.c / a.c >= {CONFIDENCE}""",
)
def association_rules(spark, d):
    model = learning.fp_growth(brand_baskets(spark, d), SUPPORT, CONFIDENCE)
    return model.associationRules.select(
        F.array_join("antecedent", ",").alias("antecedent"),
        F.array_join("consequent", ",").alias("consequent"),
        rnd("confidence").alias("confidence"), rnd("lift").alias("lift"),
        rnd("support").alias("support"),
    )


@query(
    "rule_predict",
    f"""WITH {BASKET_SQL}, r AS (SELECT t.i AS a, t.j AS c FROM two t JOIN one a ON t.i = a.i, tot
        WHERE t.c >= ceil({SUPPORT} * n) AND t.c / a.c >= {CONFIDENCE}),
      p AS (SELECT DISTINCT b.o, r.c FROM b JOIN r ON b.i = r.a
        WHERE NOT EXISTS (SELECT 1 FROM b h WHERE h.o = b.o AND h.i = r.c))
    SELECT k.o AS l_orderkey, coalesce(string_agg(p.c, ',' ORDER BY p.c), '') AS prediction
    FROM (SELECT DISTINCT o FROM b) k LEFT JOIN p ON k.o = p.o GROUP BY 1""",
)
def rule_predict(spark, d):
    """What the rules add to each basket, by a containment join."""
    found = cut(brand_baskets(spark, d))
    rules = learning.fp_growth(found, SUPPORT, CONFIDENCE).associationRules
    return learning.rule_predict(found, rules, "l_orderkey").select(
        "l_orderkey", F.array_join("prediction", ",").alias("prediction")
    )
