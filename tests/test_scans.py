"""Places of rows in files, curves with metadata, observed drops, sinks, digests and components."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from faintlight import curves
from faintlight.operators import linear, quality
from faintlight.sources import scans, sinks

NESTED = "sourceid string, bands_data struct<g:struct<mjd:array<double>,target:array<double>,past_feat_dynamic_real:array<double>>,r:struct<mjd:array<double>,target:array<double>,past_feat_dynamic_real:array<double>>>, period double, class_str string"


def test_first_rows_are_those_of_the_files(spark, tmp_path):
    for name, first, files in (("b", 0, 3), ("a", 1000, 1)):
        spark.range(first, first + 500).withColumn("position", F.lit("own")).repartitionByRange(files, "id").sortWithinPartitions("id").write.option("parquet.block.size", 1024).parquet(str(tmp_path / name))
    paths = [str(tmp_path / "b"), str(tmp_path / "a")]
    got = scans.positioned(spark, paths).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1000)) and {r["input_position"] for r in got} == {"own"}
    assert [r["id"] for r in got] == [*range(500), *range(1000, 1500)]
    for n in (0, 3, 700, 5000, None):
        rows = scans.first_rows(spark, paths, n).repartition(7)
        assert sorted(r["id"] for r in rows.collect()) == [*range(500), *range(1000, 1500)][: 5000 if n is None else n]
    train, test = scans.train_and_test(spark, paths, paths[0], 600, 10)
    assert train.count() == 600 and sorted(r["id"] for r in test.collect()) == list(range(10))


def nested(spark):
    g = lambda *v: (list(v[0]), list(v[1]), v[2])
    nan = math.nan
    return spark.createDataFrame(
        [
            ("ok", (g([1.0, 2.0], [3.0, 4.0], None), g([5.0, 6.0], [7.0, 8.0], [0.1, 0.2])), 2.5, "EW"), ("none", None, 1.0, "EA"),
            ("short", (g([1.0, 2.0], [3.0], None), None), None, None), ("errors", (None, g([1.0, 2.0], [3.0, 4.0], [0.1])), 1.0, "EW"),
            ("few", (g([1.0, nan], [3.0, 4.0], None), (None, [1.0], None)), 1.0, "EW"), ("empty", (None, None), 1.0, "EW"),
        ],
        NESTED,
    )


def test_drops_are_counted_by_the_action_itself(spark):
    scan = scans.checked(scans.curves_of(nested(spark.newSession())), observe=True)
    kept = sorted((r["id_objeto"], r["banda"], r["metadata"]) for r in scan.curves.collect())
    assert kept == [("ok", "g", {"period": 2.5}), ("ok", "r", {"period": 2.5})]
    reasons = {scans.NO_BANDS: 1, scans.LENGTHS: 1, scans.ERROR_LENGTH: 1, scans.FEW_POINTS: 1}
    assert scan.discarded() == {"curves": 6, "discarded": 4} | reasons
    assert scans.checked(scans.curves_of(nested(spark))).discarded() == {"curves": 6, "discarded": 4} | reasons
    assert {(r["id_objeto"], r["reason"]) for r in scan.rejected.collect()} == {
        ("none", scans.NO_BANDS), ("short", scans.LENGTHS), ("errors", scans.ERROR_LENGTH), ("few", scans.FEW_POINTS),
    }
    points = scans.points(scan.curves)
    assert points.columns == [*curves.COLUMNS, "metadata"]
    assert sorted((r["banda"], r["t"], r["m"], r["e"], r["src_idx"]) for r in points.collect()) == [("g", 1.0, 3.0, None, 0), ("g", 2.0, 4.0, None, 1), ("r", 5.0, 7.0, 0.1, 0), ("r", 6.0, 8.0, 0.2, 1)]


def test_strict_scans_end_at_the_first_invalid_curve(spark, tmp_path):
    with pytest.raises(PySparkException, match="short g: times and magnitudes differ"):
        scans.checked(scans.curves_of(nested(spark).where("sourceid = 'short'")), strict=True).curves.count()
    assert scans.checked(scans.curves_of(nested(spark).where("sourceid = 'ok'")), strict=True).curves.count() == 2
    nested(spark).coalesce(1).drop("sourceid", "class_str").write.parquet(str(tmp_path / "n"))
    scan = scans.read_curves(spark, str(tmp_path / "n"), max_objects=1)  # without an id column the place is the id
    assert {(r["id_objeto"], r["clase"]) for r in scan.curves.collect()} == {("0", None)}
    assert scans.checked(scans.curves_of(nested(spark).limit(0))).curves.collect() == []


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ä,\"b\"", 1 / 3), (2, None, None), (3, "x", -2.5)], "id long, name string, x double")
    sinks.to_csv(rows, str(tmp_path / "plain"), one_file=True)
    back = spark.read.option("header", True).option("escape", '"').schema(rows.schema).csv(str(tmp_path / "plain"))
    assert {r["id"]: r["x"] for r in back.collect()} == {1: 1 / 3, 2: None, 3: -2.5}
    sinks.to_csv(rows, str(tmp_path / "marked"), mark=True, digits=10, one_file=True)
    (file,) = (tmp_path / "marked").glob("*.csv")
    text = file.read_bytes()
    assert text.startswith(b"\xef\xbb\xbfid,name,x") and b"0.3333333333" in text and b"-2.5000000000" in text and "ä".encode() in text
    with pytest.raises(PySparkException):
        sinks.to_csv(rows, str(tmp_path / "plain"))
    sinks.to_parquet(rows, str(tmp_path / "parts"), by=("id",))
    assert sorted(p.name for p in (tmp_path / "parts").glob("id=*")) == ["id=1", "id=2", "id=3"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "parts")).select("id", "x").collect()), key=str) == sorted([(1, 1 / 3), (2, None), (3, -2.5)], key=str)


def test_digests_follow_time_and_last_copies_win(spark):
    rows = [("a", "r", 9.0, 1.0, None, 0), ("a", "r", 10.0, 2.0, None, 0), ("b", "r", 10.0, 2.0, None, 0), ("b", "r", 9.0, 1.0 + 1e-12, None, 1), ("c", "g", 9.0, 1.0, 0.5, 0)]
    p = spark.createDataFrame(rows, "id_objeto string, banda string, t double, m double, e double, copy int")
    digest = {r["id_objeto"]: r["content"] for r in quality.curve_hash(p).collect()}
    assert digest["a"] == digest["b"] != digest["c"]
    exact = {r["id_objeto"]: r["content"] for r in quality.exact_curve_hash(p).collect()}
    assert len(set(exact.values())) == 3 and all(len(x) == 64 for x in exact.values())
    left = quality.without_known_curves(p.where("id_objeto = 'a'"), p.where("id_objeto <> 'a'")).collect()
    assert [r["id_objeto"] for r in left] == ["c"]
    assert sorted((r["id_objeto"], r["t"]) for r in curves.last_duplicate(p, "copy").collect()) == [("a", 9.0), ("a", 10.0), ("b", 9.0), ("c", 9.0)]


def test_components_of_many_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 6)) + 1e7
    columns = [f"x{i}" for i in range(6)] + ["same", "odd name"]
    rows = [(*map(float, r), 3.0, float(r[0] - 1e7)) for r in x] + [(math.nan, *[1.0] * 7), (None, *[1.0] * 7), (math.inf, *[1.0] * 7)]
    frame = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in columns)).repartition(6)
    found = linear.moments(frame, columns)
    want = np.cov(np.array(rows[:400]).T, bias=True)
    assert found.n == 400 and np.allclose(found.covariance, want, rtol=1e-6, atol=1e-6)
    parts = linear.components(frame, columns[:7])
    assert parts.columns == columns[:6] and parts.ratios.sum() == pytest.approx(1) and parts.needed(0.999999) == 4 and parts.needed(0.0) == 1
    scores = np.array([[r[f"pc{j}"] for j in (1, 2, 3, 4)] for r in parts.scores(frame.where("x0 < 1e300"), 4).collect()])
    assert np.allclose(scores.T @ scores / 400, np.diag(parts.values[:4]), atol=1e-4)
    assert all(r["pc1"] is None for r in parts.scores(frame.where("x0 IS NULL OR isnan(x0)"), 1).collect())
    table = linear.variance_table(spark, parts, 3).collect()
    assert [r["component"] for r in table] == [1, 2, 3] and table[2]["cumulative"] == pytest.approx(parts.ratios[:3].sum())
    pairs = {(r["a"], r["b"]): r for r in linear.correlations(frame, columns).collect()}
    assert pairs["x0", "odd name"]["band"] == 2 and pairs["x0", "same"]["r"] is None
    assert linear.moments(frame.limit(0), columns).n == 0
