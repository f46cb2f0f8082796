"""Principal components and control classifiers."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintlight.operators import trees as grown
from faintlight.operators.tables import set_checkpoints

#: Rows below which a task of a fit isn't worth its start, and beyond which there are more tasks than cores.
TASK_ROWS, MOST_ROWS = 2000, 500_000


def explained_variance(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(component, ratio, cumulative) of the first k principal components of the standardised columns.

    Rows with a null or NaN in a column are left out.
    """
    steps = [
        VectorAssembler(inputCols=columns, outputCol="__raw", handleInvalid="skip"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True),
        PCA(inputCol="__x", outputCol="__pc", k=k),
    ]
    ratios = [float(r) for r in Pipeline(stages=steps).fit(rows.select(*columns)).stages[-1].explainedVariance]
    parts = [(i + 1, r, sum(ratios[: i + 1])) for i, r in enumerate(ratios)]
    return rows.sparkSession.createDataFrame(parts, "component int, ratio double, cumulative double")


def weighted(train: DataFrame) -> DataFrame:
    """train with `weight`, n / (classes * rows of the class), so that all classes weigh the same."""
    sizes = train.groupBy("clase").agg(F.count("*").alias("__n"))
    whole = sizes.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k")).first()
    share = F.lit(float(whole["__all"] or 0)) / (F.lit(max(whole["__k"], 1)) * F.col("__n"))
    return train.join(sizes, "clase").withColumn("weight", share).drop("__n")


def merged(rows: DataFrame) -> DataFrame:
    """Rows equal in label, features and weight as one with their weights together, where that leaves fewer than nine tenths."""
    same = rows.withColumn("__v", vector_to_array("__x")).groupBy("__y", "__v", "weight").agg(F.count("*").alias("__n")).checkpoint()
    found = same.agg(F.count("*").alias("different"), F.sum("__n").alias("all")).first()
    if not found["all"] or found["different"] > 0.9 * found["all"]:
        return rows
    return same.select("__y", array_to_vector("__v").alias("__x"), (F.col("weight") * F.col("__n")).alias("weight"))


def dealt(rows: DataFrame) -> DataFrame:
    """The rows kept evenly over the session's cores, for a fit that passes over them often, however they were keyed before."""
    rows = rows.checkpoint()
    n = max(rows.count(), 1)
    tasks = max(min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / TASK_ROWS)), math.ceil(n / MOST_ROWS))
    return rows.repartition(tasks).checkpoint()


def control(train: DataFrame, test: DataFrame, classifier, balanced: bool = True) -> DataFrame:
    """(id, clase, prediction) of the test rows by a classifier fitted on train; both have id, clase and v (an array).

    Rows without class aren't learned from. Columns of v are standardised by train.
    """
    set_checkpoints(train.sparkSession)
    known = train.where("clase IS NOT NULL")
    known = (weighted(known) if balanced else known.withColumn("weight", F.lit(1.0))).select(F.col("clase").cast("string"), "weight", array_to_vector("v").alias("__raw"))
    index = StringIndexer(inputCol="clase", outputCol="__y").fit(known)
    scale = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(known)
    model = classifier.setParams(featuresCol="__x", labelCol="__y", weightCol="weight", predictionCol="__p").fit(dealt(merged(index.transform(scale.transform(known)).select("__y", "__x", "weight"))))
    found = model.transform(scale.transform(test.select("id", F.col("clase").cast("string"), array_to_vector("v").alias("__raw"))))
    names = F.array(*map(F.lit, index.labels))
    return found.select("id", "clase", F.get(names, F.col("__p").cast("int")).alias("prediction"))


def forest_control(train: DataFrame, test: DataFrame, trees: int = 200, depth: int = 30, seed: int = 42, leaf: int = 1, balanced: bool = True) -> DataFrame:
    """(id, clase, prediction) of the test rows by a random forest fitted on train; both have id (long, unique), clase and v.

    The root of the features is tried at each split; leaves have at least `leaf` drawn rows. Rows without class aren't
    learned from; of classes equally likely the more frequent one is predicted.
    """
    set_checkpoints(train.sparkSession)
    known = train.where("clase IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("clase").cast("string").alias("clase"), F.col("v").cast("array<double>").alias("v"))
    sizes = known.groupBy("clase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "clase").collect()
    whole = sum(r["n"] for r in sizes)
    classes = [(r["clase"], y, whole / (len(sizes) * r["n"]) if balanced else 1.0) for y, r in enumerate(sizes)]
    labels = train.sparkSession.createDataFrame(classes, "clase string, y int, w double")
    known = known.join(F.broadcast(labels), "clase").select("id", "v", "y", "w").checkpoint()
    asked = test.select(F.col("id").cast("long").alias("id"), F.col("clase").cast("string").alias("clase"), F.col("v").cast("array<double>").alias("v")).checkpoint()
    places = asked.groupBy("v").agg(F.min("id").alias("rep")).checkpoint()  # equal rows are asked once
    found = grown.votes(known, places.select(F.col("rep").alias("id"), "v"), max(len(sizes), 1), trees, depth, leaf, seed)
    best = found.groupBy("id").agg(F.max(F.struct("share", (-F.col("label")).alias("turn"))).alias("x")).select(F.col("id").alias("rep"), (-F.col("x.turn")).alias("y"))
    return asked.join(places, "v", "left").join(best, "rep", "left").join(F.broadcast(labels.select("y", F.col("clase").alias("prediction"))), "y", "left").select("id", "clase", "prediction")


def logistic_control(train: DataFrame, test: DataFrame, c: float = 1.0, steps: int = 1000) -> DataFrame:
    """control() by multinomial logistic regression with penalty 1 / (c * rows)."""
    n = max(train.where("clase IS NOT NULL").count(), 1)
    return control(train, test, LogisticRegression(maxIter=steps, regParam=1 / (c * n), family="multinomial"))
