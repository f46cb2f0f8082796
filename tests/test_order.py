"""Ranks and quantiles of whole tables against plain computations, on skewed and awkward values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faintlight.operators import order, stats

NAN, INF = float("nan"), float("inf")


def test_thousands_of_ranges_and_a_value_that_most_rows_hold(spark):
    values = [float(i) for i in range(6000)] + [7.5] * 3000 + [None] * 5
    rows = spark.createDataFrame(list(enumerate(values)), "id long, x double")
    for descending in (False, True):
        got = {r["id"]: r["rank"] for r in order.ranked(rows, "x", descending=descending, per_task=2000).collect()}
        s = pd.Series([-INF if v is None else v for v in values])
        assert got == dict(enumerate(s.rank(method="min", ascending=not descending)))
    counts = rows.groupBy("x").agg(F.count("*").alias("n"))
    got = order.cumulated(counts, "x", ["n"], per_task=2).where("x = 5999").first()  # 3,000 ranges
    assert got["before_n"] == 9004


def test_average_ranks_within_groups_and_one_value_for_all(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"id": range(400), "g": rng.integers(0, 3, 400).astype(str), "x": rng.integers(0, 20, 400).astype(float)})
    frame.loc[:20, "g"] = None
    rows = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "id long, g string, x double")
    for per_task in (10**6, 7):
        got = {r["id"]: r["r"] for r in order.ranked(rows, "x", "r", average=True, within=["g"], per_task=per_task).collect()}
        assert got == dict(zip(frame["id"], frame.groupby("g", dropna=False)["x"].rank(), strict=True))
    same = spark.range(5000).withColumn("x", F.lit(1.0))
    assert {r["rank"] for r in order.ranked(same, "x", average=True, per_task=10).select("rank").distinct().collect()} == {2500.5}
    assert order.ranked(same.limit(0), "x").collect() == []


@pytest.mark.parametrize(
    "values",
    [
        [3.0], [1.0, 2.0], [5.0] * 50, list(range(101)), [0.0, -0.0, 5e-324, -5e-324, 1e-310, 2e-310], [1e308, -1e308, 1.7e308, -1.7e308, 1.0],
        [INF, -INF, 1.0, 2.0, INF], [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0 + 3 * 2**-52], [*(10.0**k for k in range(-300, 300, 7)), *(-(10.0**k) for k in range(-300, 300, 11))],
        [0.1 * i for i in range(997)] + [0.3] * 500,
    ],
)
def test_quantiles_are_exact(spark, values):
    shares = [0.0, 0.01, 0.125, 0.25, 0.5, 0.6, 0.99, 1.0]
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(5)
    got = order.quantiles(rows, "x", shares).first()
    want = rows.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0]
    assert got["n"] == len(values)
    assert got["q"] == pytest.approx(want, rel=1e-12, abs=0, nan_ok=True)


def test_quantiles_of_groups_and_columns(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": rng.integers(0, 5, 2000), "x": rng.lognormal(0, 3, 2000), "y": rng.integers(0, 7, 2000).astype(float)})
    rows = spark.createDataFrame(frame)
    got = {r["g"]: r["q"] for r in order.quantiles(rows, "x", [0.1, 0.5], ["g"]).collect()}
    for g, part in frame.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(part["x"], [0.1, 0.5]).tolist(), rel=1e-12)
    both = order.quantiles_of(rows, {"a": F.col("x"), "b": F.col("y"), "none": F.lit(None)}, [0.25, 0.75]).first()
    assert both["a"] == pytest.approx(np.quantile(frame["x"], [0.25, 0.75]).tolist(), rel=1e-12) and both["none"] is None
    assert both["b"] == np.quantile(frame["y"], [0.25, 0.75]).tolist()
    assert order.quantiles(rows.limit(0), "x", [0.5]).collect() == []
    nan = spark.createDataFrame([(1.0,), (2.0,), (NAN,)], "x double")
    assert order.quantiles(nan, "x", [0.0, 0.5]).first()["q"] == [1.0, 2.0]


def test_tests_of_distributions_in_many_ranges(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(("a", "b")[int(k)], float(x), int(k)) for k, x in zip(rng.integers(0, 2, 500), rng.normal(size=500).round(1), strict=True)], "g string, x double, y int")
    whole = [stats.kolmogorov_smirnov(rows, "g", "x", "a", "b").first(), stats.kruskal_wallis(rows, "g", "x").first(), stats.roc_auc(rows, "x", "y").first()]
    monkeypatch.setattr(order, "PER_TASK", 3)
    monkeypatch.setattr(order.cumulated, "__defaults__", (*order.cumulated.__defaults__[:-1], 3))
    parts = [stats.kolmogorov_smirnov(rows, "g", "x", "a", "b").first(), stats.kruskal_wallis(rows, "g", "x").first(), stats.roc_auc(rows, "x", "y").first()]
    for a, b in zip(whole, parts, strict=True):
        assert list(a) == pytest.approx(list(b), rel=1e-12)


def test_two_levels_keep_no_buffer_of_values(spark, tmp_path):
    from faintlight.plans.queries import describe_two_levels

    rows = [("A" if i % 3 else None, "F" if i % 2 else "O", float(i), float(i % 7), None, 1.0) for i in range(50)]
    spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = describe_two_levels(spark, str(tmp_path))
    assert "percentile(" not in got._jdf.queryExecution().toString()
    found = {(r["nivel"], r["clase"], r["variable"]): r for r in got.collect()}
    assert len(found) == 16 and found["flag", None, "l_quantity"]["n"] == 17
    assert [found["flag", None, "l_quantity"][c] for c in ("q25", "median", "q75")] == [12.0, 24.0, 36.0] and found["status", "F", "l_discount"]["median"] is None
