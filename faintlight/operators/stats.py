"""Distribution statistics, tests and metrics as plain aggregates and windows."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintlight.operators import order
from faintlight.operators.tables import set_checkpoints


def long_form(frame: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, variable, value), one row per key and column."""
    return frame.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select(*keys, "x.*")


def describe(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and percentiles of value."""
    found = order.quantiles(rows, "value", (0.01, 0.25, 0.5, 0.75, 0.99), keys)
    q = found.select(*(F.col(k).alias(f"__of_{k}") for k in keys), *(F.col("q")[i].alias(p) for i, p in enumerate(("p1", "p25", "p50", "p75", "p99"))))
    moments = rows.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys] or F.lit(True)
    return moments.join(q, same, "left").select(*keys, "n", "mean", "std", "min", "p1", "p25", "p50", "p75", "p99", "max")


def heavy_tails(described: DataFrame, limit: float = 50.0) -> DataFrame:
    """range / IQR of each variable, and whether it is beyond the limit; variables without IQR are left out."""
    iqr = F.col("p75") - F.col("p25")
    return described.where(iqr > 0).withColumn("tail_ratio", (F.col("max") - F.col("min")) / iqr).withColumn("heavy", F.col("tail_ratio") > limit)


#: Ranks over whole tables: see order.ranked().
ranked = order.ranked


def average_rank(value: str, within: list[str] = ()) -> Column:
    """Rank from 1 with ties sharing their mean rank."""
    ties = F.count("*").over(Window.partitionBy(*within, value))
    return F.rank().over(Window.partitionBy(*within).orderBy(value)) + (ties - 1) / 2


def percentile_rank(value: str, within: list[str] = ()) -> Column:
    """average_rank as a percentage of the number of rows."""
    return average_rank(value, within) / F.count("*").over(Window.partitionBy(*within)) * 100


def percentile_ranked(rows: DataFrame, value: str, name: str, within: list[str] = ()) -> DataFrame:
    """Adds the mean rank as a percentage of the number of rows, over the table or among equal `within`."""
    sizes = rows.groupBy(*(F.col(k).alias(f"__of_{k}") for k in within)).agg(F.count("*").alias("__all"))
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in within] or F.lit(True)
    found = order.ranked(rows, value, name, average=True, within=within).join(sizes if within else F.broadcast(sizes), same)
    return found.withColumn(name, F.col(name) / F.col("__all") * 100).drop("__all", *(f"__of_{k}" for k in within))


def median_gap(rows: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """The median of group a less that of group b, over the interquartile range of both together (1e-12 at least)."""
    v, g = F.col(value), F.col(group)
    found = order.quantiles_of(rows.where(g.isin(a, b)), {"a": F.when(g == a, v), "b": F.when(g == b, v), "both": v}, [0.25, 0.5, 0.75])
    return found.select(((F.col("a")[1] - F.col("b")[1]) / F.greatest(F.col("both")[2] - F.col("both")[0], F.lit(1e-12))).alias("gap"))


def roc_auc(rows: DataFrame, score: str, label: str, within: list[str] = ()) -> DataFrame:
    """Area under the ROC curve of score for label 1 against 0, by average ranks (Mann and Whitney), from counts of the scores."""
    counts = rows.groupBy(*within, score).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    counts = order.cumulated(counts, score, ["n"], within)
    pos, neg, rank = F.sum("pos"), F.sum("neg"), F.col("before_n") + (F.col("n") + 1) / 2
    auc = (F.sum(F.col("pos") * rank) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))
    return counts.groupBy(*within).agg(auc.alias("auc"), F.coalesce(pos, F.lit(0)).alias("n_pos"), F.coalesce(neg, F.lit(0)).alias("n_neg"))


def kruskal_wallis(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The H statistic with correction for ties, from counts of the values."""
    set_checkpoints(rows.sparkSession)
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n")).checkpoint()
    ranks = order.cumulated(counts.groupBy(F.col(value).alias("__v")).agg(F.sum("n").alias("t")), "__v", ["t"])
    ranks = ranks.select("__v", (F.col("before_t") + (F.col("t") + 1) / 2).alias("rank"), F.col("t").cast("double").alias("t"))
    ties = ranks.agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    of_group = counts.join(ranks, F.col(value).eqNullSafe(F.col("__v"))).groupBy(group).agg(F.sum(F.col("rank") * F.col("n")).alias("r"), F.sum("n").alias("n"))
    sums = of_group.agg(F.sum(F.col("r") ** 2 / F.col("n")).alias("s"), F.sum("n").alias("n"), F.count("*").alias("n_groups"))
    total = F.col("n").cast("double")
    h = (12 / (total * (total + 1)) * F.col("s") - 3 * (total + 1)) / (1 - F.col("ties") / (total**3 - total))
    return sums.crossJoin(ties).select(h.alias("h"), F.col("n_groups"), F.col("n"))


def kolmogorov_smirnov(rows: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """The largest distance between the cumulative shares of groups a and b."""
    counts = rows.where(F.col(group).isin(a, b)).groupBy(value).agg(F.count_if(F.col(group) == a).alias("a"), F.count_if(F.col(group) == b).alias("b"))
    sums = order.cumulated(counts, value, ["a", "b"])
    whole = sums.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    share = lambda c: (F.col(f"before_{c}") + F.col(c)) / F.col(f"n_{c}")
    return sums.join(F.broadcast(whole)).withColumn("d", F.abs(share("a") - share("b"))).groupBy("n_a", "n_b").agg(F.max("d").alias("ks")).select("ks", "n_a", "n_b")


def chi2_tail(value: Column, freedom: Column) -> Column:
    """The probability of a larger chi-square value with so many degrees of freedom; null for nulls or none.

    For an even number it is a sum of Poisson terms; for an odd one the same sum over halves, from the normal tail on.
    """
    half, df = value.cast("double") / 2, freedom.cast("long")
    even = df % 2 == 0
    # Terms x^a / gamma(a + 1) for a from 0 or 1/2 on, below df / 2; each follows from the one before.
    start = F.when(even, F.exp(-half)).otherwise(F.exp(-half) * F.sqrt(half) * 2 / math.sqrt(math.pi))
    n = F.when(even, df / 2).otherwise((df - 1) / 2).cast("int")
    first = F.struct(start.alias("term"), F.lit(0.0).alias("total"))
    step = lambda x, i: F.struct((x["term"] * half / (i + F.when(even, 0.0).otherwise(0.5))).alias("term"), (x["total"] + x["term"]).alias("total"))
    total = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), first, step)["total"]
    return F.when((value >= 0) & (df > 0), F.least(F.lit(1.0), total + F.when(even, 0.0).otherwise(normal_tail(half))))


def normal_tail(half: Column) -> Column:
    """erfc(sqrt(half)), the chance that a standard normal value lies further from 0 than sqrt(2 * half).

    By its power series below 4 and by its continued fraction from there on, both to about 1e-15.
    """
    x = F.sqrt(half)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("term"), x.alias("total")),
        lambda s, i: F.struct((-s["term"] * half / i).alias("term"), (s["total"] - s["term"] * half / i / (2 * i + 1)).alias("total")),
    )["total"]
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda f, i: x + i / F.lit(2.0) / f)
    return F.when(half < 4, 1 - series * 2 / math.sqrt(math.pi)).otherwise(F.exp(-half) / math.sqrt(math.pi) / fraction)


def kolmogorov_tail(distance: Column, n_a: Column, n_b: Column, terms: int = 100) -> Column:
    """The asymptotic probability of a larger distance between two samples of one distribution."""
    scaled = distance * F.sqrt(n_a.cast("double") * n_b / (n_a + n_b))
    term = lambda i: F.when(i % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * i * i * scaled * scaled)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda x, i: x + term(i))
    # The series needs ever more terms near 0, where the probability is 1 to many places.
    return F.when(scaled < 0.2, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def recall_at_fpr(rows: DataFrame, score: str, label: str, rates: tuple[float, ...] = (0.01, 0.02, 0.05, 0.10, 0.20)) -> DataFrame:
    """For each rate the score that so many of label 0 exceed, the rate reached, and the recall of label 1 (score >= threshold)."""
    limits = order.quantiles(rows.where(F.col(label) == 0), score, [1 - r for r in rates]).select(F.posexplode("q").alias("i", "threshold")).withColumn("fpr", F.array(*map(F.lit, rates))[F.col("i")])
    hit = F.col(score) >= F.col("threshold")
    share = lambda k: F.count_if(hit & (F.col(label) == k)) / F.count_if(F.col(label) == k)
    return rows.join(F.broadcast(limits)).groupBy("fpr", "threshold").agg(share(0).alias("fpr_reached"), share(1).alias("recall"))


def class_metrics(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where undefined."""
    both = rows.select(F.explode(F.array(F.struct(F.col(truth).alias("k"), F.lit(1).alias("t"), F.lit(0).alias("g"), (F.col(truth) == F.col(guess)).cast("int").alias("h")), F.struct(F.col(guess).alias("k"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("h")))).alias("x")).select("x.*")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    m = both.groupBy(F.col("k").alias("class")).agg(F.sum("t").alias("support"), F.sum("g").alias("guessed"), F.sum("h").alias("hits"))
    m = m.withColumn("precision", zero(F.try_divide("hits", "guessed"))).withColumn("recall", zero(F.try_divide("hits", "support")))
    return m.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))).drop("guessed", "hits")


def standard_scaled(frame: DataFrame, columns: list[str], fit: Column | None = None, within: list[str] = ()) -> DataFrame:
    """The columns less their mean, over their population deviation (1 if that is 0), both taken where `fit` holds."""
    pick = lambda c: F.when(fit, F.col(c)) if fit is not None else F.col(c)
    moments = [f(pick(c)).alias(f"__{name}_{c}") for c in columns for name, f in (("mean", F.avg), ("dev", F.stddev_pop))]
    found = frame.groupBy(*(F.col(k).alias(f"__of_{k}") for k in within)).agg(*moments)
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in within]
    joined = frame.join(found, same) if within else frame.join(F.broadcast(found))
    scale = lambda c: F.when(F.col(f"__dev_{c}") > 0, F.col(f"__dev_{c}")).otherwise(1.0)
    return joined.withColumns({c: (F.col(c) - F.col(f"__mean_{c}")) / scale(c) for c in columns}).select(*frame.columns)


def robust_scaled(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The columns less their median, over their interquartile range (1 if that is 0)."""
    stats = order.quantiles_of(frame, {f"__{c}": F.col(c) for c in columns}, (0.25, 0.5, 0.75))
    q = lambda c, i: F.col(f"__{c}")[i]
    iqr = lambda c: q(c, 2) - q(c, 0)
    return frame.join(F.broadcast(stats)).withColumns({c: (F.col(c) - q(c, 1)) / F.when(iqr(c) > 0, iqr(c)).otherwise(1.0) for c in columns}).drop(*(f"__{c}" for c in columns))


def imputed(frame: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Infinite and NaN values become the column's median where `train` holds, or 0 if there is none."""
    ok = {c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in columns}
    medians = order.quantiles_of(frame.where(train), {f"__{c}": ok[c] for c in columns}, [0.5])
    return frame.join(F.broadcast(medians)).withColumns({c: F.coalesce(ok[c], F.col(f"__{c}")[0], F.lit(0.0)) for c in columns}).drop(*(f"__{c}" for c in columns))


def bucket_metrics(rows: DataFrame, value: str, truth: str, guess: str, buckets: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """(bucket, objects, mean, median, accuracy, balanced) for ranges [low, high) of a value; None leaves an end open.

    Balanced accuracy is the mean of the recalls of the classes in a bucket. A bucket without rows has a row of nulls with
    0 objects; rows in no bucket, without a class or without a value don't count, and a null guess is a wrong one. Rows are
    counted by bucket, class, value and hit first, so a hot bucket isn't one task's.
    """
    v = F.col(value)
    inside = {k: (F.lit(True) if low is None else v >= low) & (F.lit(True) if high is None else v < high) for k, (low, high) in buckets.items()}
    named = F.coalesce(*(F.when(test & v.isNotNull(), k) for k, test in inside.items()))
    hit = F.coalesce(F.col(truth) == F.col(guess), F.lit(False))
    counts = rows.select(named.alias("bucket"), F.col(truth).alias("class"), v.cast("double").alias("v"), hit.alias("hit")).where("bucket IS NOT NULL AND class IS NOT NULL")
    counts = counts.groupBy("bucket", "class", "v").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    recalls = counts.groupBy("bucket", "class").agg((F.sum("hits") / F.sum("n")).alias("recall")).groupBy("bucket").agg(F.avg("recall").alias("balanced"))
    values = counts.groupBy("bucket", "v").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    found = values.groupBy("bucket").agg(
        F.sum("n").alias("objects"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("v", F.lit(0.5), F.col("n")).alias("median"), (F.sum("hits") / F.sum("n")).alias("accuracy"),
    )
    names = rows.sparkSession.createDataFrame([(k,) for k in buckets], "bucket string")
    return names.join(found, "bucket", "left").join(recalls, "bucket", "left").withColumn("objects", F.coalesce("objects", F.lit(0)))


def class_observations(rows: DataFrame, label: str, count: str) -> DataFrame:
    """How many observations the objects of each class have: objects, mean, median, sample deviation, least and most."""
    n = F.col(count)
    return rows.groupBy(label).agg(
        F.count(n).alias("objects"), F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.stddev_samp(n).alias("std"), F.min(n).alias("min"), F.max(n).alias("max"),
    )


def hash_order(column: Column, seed: str) -> Column:
    return F.md5(F.concat(column.cast("string"), F.lit(seed)))


def stratified(frame: DataFrame, key: str, stratum: str, share: float = 0.8, seed: str = "42") -> DataFrame:
    """Adds is_train: the first `share` of each stratum by a hash of the key."""
    turn = Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key)
    return frame.withColumn("is_train", F.row_number().over(turn) <= F.round(F.count("*").over(Window.partitionBy(stratum)) * share))


def group_folds(frame: DataFrame, group: str, k: int = 5, seed: str = "42") -> DataFrame:
    """Adds fold 0..k-1, the same for all rows of a group: groups take turns in the order of a hash."""
    groups = frame.select(group).distinct().withColumn("__h", F.concat_ws(":", hash_order(F.col(group), seed), F.col(group).cast("string")))
    groups = order.ranked(groups, "__h", "__r")
    return frame.join(groups.select(group, ((F.col("__r") - 1) % k).cast("int").alias("fold")), group)


def run_summary(rows: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """How a metric spreads over several runs: their number, mean, deviation and extremes."""
    return rows.groupBy(*by).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, percent) of each value; nulls are a value."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("__all")))).withColumn("percent", 100.0 * F.col("n") / F.col("__all")).drop("__all")


def differences(pairs: DataFrame, a: Column, b: Column, least: float = 1e-9) -> DataFrame:
    """Mean, median and largest of |a - b|, and how many are above `least`; pairs with nulls don't count."""
    d = pairs.select(F.abs(a - b).alias("d")).where("d IS NOT NULL")
    more = F.count_if(F.col("d") > least)
    found = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.max("d").alias("max"), more.alias("n_differ"), (100.0 * more / F.count("*")).alias("percent_differ"))
    median = order.quantiles_of(d, {"median": F.col("d")}, [0.5]).select(F.col("median")[0].alias("median"))
    return found.join(F.broadcast(median)).select("n", "mean", "median", "max", "n_differ", "percent_differ")


def bucket(value: Column, limits: list[float], names: list[str]) -> Column:
    """The name of the range that holds the value: below the first limit, then between limits, then from the last on."""
    found = F.lit(names[-1])
    for limit, name in reversed(list(zip(limits, names, strict=False))):
        found = F.when(value < limit, name).otherwise(found)
    return F.when(value.isNotNull(), found)
