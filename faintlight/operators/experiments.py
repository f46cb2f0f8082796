"""Experiments with control classifiers: feature sets left out or added, choices of features, importances.

Train and test rows have id, clase and one column for each feature. A model is a function (train, test) -> (id, clase,
prediction) such as models.forest_control, where both frames have id, clase and v (an array). Loops on the driver are
over experiments; each one's work is Spark's.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from hashlib import sha256

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintlight.operators import models, stats
from faintlight.operators.neighbours import vector
from faintlight.operators.tables import at_once

Model = Callable[[DataFrame, DataFrame], DataFrame]


def metrics(predictions: DataFrame) -> DataFrame:
    """One row: n, accuracy, balanced_accuracy (mean recall of the classes that occur), macro_f1."""
    per_class = stats.class_metrics(predictions.where("clase IS NOT NULL"), "clase", "prediction").where("support > 0")
    hits = F.sum(F.col("recall") * F.col("support"))
    return per_class.agg(
        F.sum("support").alias("n"), (hits / F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1")
    )


def compared(train: DataFrame, test: DataFrame, sets: dict[str, list[str]], model: Model = models.forest_control) -> DataFrame:
    """(experiment, n_features, n, accuracy, balanced_accuracy, macro_f1): a model for each named set of columns, some at once."""

    def result(name: str, columns: list[str]) -> DataFrame:
        a, b = (x.select("id", "clase", vector(*columns).alias("v")) for x in (train, test))
        return metrics(model(a, b)).select(F.lit(name).alias("experiment"), F.lit(len(columns)).alias("n_features"), "*")

    return reduce(DataFrame.unionByName, at_once(train.sparkSession, [partial(result, name, columns) for name, columns in sets.items()]))


def durably(spark: SparkSession, runs: dict[str, Callable[[], DataFrame]], folder: str, settings: dict | None = None, at_once: int = 4) -> DataFrame:
    """All rows of the runs' results, each result with its run's name in front as `run`.

    Up to `at_once` runs go on at a time, each in a scheduler pool of its own. A result is written in `folder`, which
    driver and executors share, under the digest of its name and the settings (whatever decides on the results: data,
    columns, seeds); what stands there already isn't run again, so after a lost driver the same call does the rest.
    If a run fails the others still end and are kept; then its error is raised. Results need one schema.
    """
    if not runs:
        raise ValueError("no runs")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()

    def done(path: str) -> bool:
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(hadoop).exists(mark)

    def result(name: str) -> str:
        key = json.dumps([name, settings or {}], sort_keys=True, default=str)
        path = f"{folder.rstrip('/')}/{sha256(key.encode()).hexdigest()}"
        if not done(path):
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            runs[name]().select(F.lit(name).alias("run"), "*").write.mode("overwrite").parquet(path)
        return path

    with ThreadPoolExecutor(at_once) as pool:
        begun = [pool.submit(inheritable_thread_target(result), name) for name in runs]
    return spark.read.parquet(*(each.result() for each in begun))


def compared_durably(
    train: DataFrame, test: DataFrame, sets: dict[str, list[str]], folder: str, settings: dict, model: Model = models.forest_control, at_once: int = 4
) -> DataFrame:
    """compared() by durably(): the settings must name the data and the model, the columns of a set are added to them."""
    runs = {json.dumps([name, columns]): partial(compared, train, test, {name: columns}, model) for name, columns in sets.items()}
    return durably(train.sparkSession, runs, folder, settings, at_once).drop("run")


def leaving_out(groups: dict[str, list[str]]) -> dict[str, list[str]]:
    """Sets for compared(): all columns, then all but each group. Groups that would leave nothing are skipped."""
    whole = [c for columns in groups.values() for c in columns]
    rest = {f"without_{name}": [c for c in whole if c not in columns] for name, columns in groups.items()}
    return {"all": whole} | {name: columns for name, columns in rest.items() if columns}


def taking_away(groups: dict[str, list[str]]) -> dict[str, list[str]]:
    """Sets for compared(): all columns, then without the first group, without the first two, and so on."""
    names = list(groups)
    sets = {"all": [c for name in names for c in groups[name]]}
    for i, name in enumerate(names[:-1]):
        sets[f"also_without_{name}"] = [c for other in names[i + 1 :] for c in groups[other]]
    return sets


def singly(columns: list[str]) -> dict[str, list[str]]:
    """Sets for compared(): each column by itself."""
    return {c: [c] for c in columns}


def selected(train: DataFrame, test: DataFrame, columns: list[str], model: Model = models.forest_control, forward: bool = True, by: str = "balanced_accuracy") -> DataFrame:
    """(step, feature, n_features, score): features added one at a time, or taken away, by what scores best.

    Each step tries all that are left and keeps the best by the metric `by`, the first by name among equals.
    """
    chosen, left, steps = [], sorted(columns), []
    while left and (forward or len(left) > 1):
        sets = {c: [*chosen, c] if forward else [x for x in left if x != c] for c in left}
        best = compared(train, test, sets, model).orderBy(F.desc(by), "experiment").first()
        left.remove(best["experiment"])
        chosen.append(best["experiment"])
        steps.append((len(steps) + 1, best["experiment"], int(best["n_features"]), float(best[by])))
    return train.sparkSession.createDataFrame(steps, "step int, feature string, n_features int, score double")


def over_seeds(train: DataFrame, test: DataFrame, sets: dict[str, list[str]], seeds: list[int], trees: int = 200) -> DataFrame:
    """How compared() with forests spreads over seeds: (experiment, runs, mean, std, min, max) of balanced accuracy."""
    runs = [compared(train, test, sets, partial(models.forest_control, trees=trees, seed=s)).withColumn("seed", F.lit(s)) for s in seeds]
    return stats.run_summary(reduce(DataFrame.unionByName, runs), "balanced_accuracy", ["experiment"])


def importances(train: DataFrame, columns: list[str], trees: int = 200, depth: int = 30, seed: int = 42) -> DataFrame:
    """(feature, forest, logistic): a forest's share of impurity removed, and the mean absolute coefficient over
    classes of a logistic regression on standardised columns. Rows with a null in a column or no class are left out."""
    rows = models.weighted(train.where("clase IS NOT NULL")).select(F.col("clase").cast("string"), "weight", *columns)
    ready = Pipeline(
        stages=[
            StringIndexer(inputCol="clase", outputCol="__y"),
            VectorAssembler(inputCols=columns, outputCol="__raw", handleInvalid="skip"),
            StandardScaler(inputCol="__raw", outputCol="__x", withMean=True),
        ]
    ).fit(rows)
    learn = {"featuresCol": "__x", "labelCol": "__y", "weightCol": "weight"}
    ready = ready.transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, **learn).fit(ready)
    logistic = LogisticRegression(maxIter=100, family="multinomial", **learn).fit(ready)
    means = abs(logistic.coefficientMatrix.toArray()).mean(axis=0)
    found = [(c, float(a), float(b)) for c, a, b in zip(columns, forest.featureImportances.toArray(), means, strict=True)]
    return train.sparkSession.createDataFrame(found, "feature string, forest double, logistic double")
