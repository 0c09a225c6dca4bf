"""Distributed learning and pattern mining on Spark ML."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.fpm import FPGrowth
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble_features(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Numeric columns -> one vector; each column is used once."""
    return VectorAssembler(inputCols=list(dict.fromkeys(columns)), outputCol=out).transform(df)


def vectorize(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    """Array column -> vector, without splitting it into columns first."""
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def kmeans(df: DataFrame, k: int = 3, max_iter: int = 20, tol: float = 1e-4, seed: int = 1):
    """k-means|| with two initialization steps; returns the fitted model."""
    return KMeans(
        k=k, maxIter=max_iter, tol=tol, seed=seed, initMode="k-means||", initSteps=2
    ).fit(df)


def logistic_regression(
    df: DataFrame, max_iter: int = 10, reg: float = 0.3, elastic_net: float = 0.0
):
    return LogisticRegression(
        family="binomial", maxIter=max_iter, regParam=reg, elasticNetParam=elastic_net
    ).fit(df)


def random_forest(df: DataFrame, trees: int = 20, seed: int = 1):
    return RandomForestClassifier(numTrees=trees, seed=seed).fit(df)


def hash_share(key: Column) -> Column:
    """Number in [0, 1) from the first eight hex digits of the key's md5."""
    head = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10)
    return head.cast("long") / F.lit(float(1 << 32))


def train_test_split(
    df: DataFrame, key: str, share: float = 0.7, how: str = "hash", seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """``hash`` is reproducible whatever the partitioning; ``random`` is Spark's own split;
    ``ordered`` cuts the unshuffled range of a numeric key."""
    if how == "random":
        return tuple(df.randomSplit([share, 1 - share], seed=seed))
    if how == "ordered":
        from tidemark.operators.ranking import exact_quantiles

        at = exact_quantiles(df, [], key, {"_cut": share})
        # one quantile: a single row
        marked = df.crossJoin(F.broadcast(at))
        first = F.col(key) < F.col("_cut")
        return marked.filter(first).drop("_cut"), marked.filter(~first).drop("_cut")
    first = hash_share(F.col(key)) < share
    return df.filter(first), df.filter(~first)


def evaluate_auc(scored: DataFrame, label: str = "label") -> float:
    """Area under ROC by Spark's evaluator (bins the curve); ``aggregates.auc`` is exact."""
    return BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC").evaluate(scored)


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def baskets(df: DataFrame, key: str, item: str) -> DataFrame:
    """Transactions with distinct items."""
    return df.groupBy(key).agg(F.collect_set(item).alias("items"))


def fp_growth(df: DataFrame, min_support: float = 0.5, min_confidence: float = 0.6):
    """Parallel FP-growth; the model offers itemsets, rules and predictions."""
    return FPGrowth(
        itemsCol="items", minSupport=min_support, minConfidence=min_confidence
    ).fit(df)


def rule_predict(df: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Items that the rules add to every basket: (key, prediction), a sorted array, empty if none.

    ``df``: key, items (a set); ``rules``: antecedent, consequent (arrays). A rule applies to a basket
    that holds its whole antecedent and none of its consequent. A containment join: every rule waits
    at the rarest item of its antecedent, baskets visit the items they hold, and what meets is
    verified on the whole antecedent. A rule of an empty antecedent or a null basket applies nowhere.
    """
    held = df.select(key, "items", F.explode("items").alias("_item"))
    used = rules.select("antecedent", "consequent").distinct()
    counts = held.groupBy("_item").agg(F.count(F.lit(1)).alias("_c"))
    waiting = (
        used.select("*", F.explode("antecedent").alias("_item"))
        .join(counts, "_item")
        .groupBy("antecedent", "consequent")
        .agg(F.min_by("_item", F.struct("_c", "_item")).alias("_item"))
    )
    met = held.join(waiting, "_item").filter(
        (F.size(F.array_except("antecedent", "items")) == 0) & ~F.arrays_overlap("consequent", "items")
    )
    added = (
        met.select(key, F.explode("consequent").alias("_new"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("_new")).alias("prediction"))
    )
    none = F.array().cast(df.schema["items"].dataType)
    return df.select(key).join(added, key, "left").select(key, F.coalesce("prediction", none).alias("prediction"))
