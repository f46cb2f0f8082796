import math
import struct
from functools import partial

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from faintlight import curves
from faintlight.functions import features, shapes
from faintlight.operators import detect, experiments, models, stats
from faintlight.sources.binary import binary_table


def test_chi_square_tail_at_published_quantiles(spark):
    known = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (11.344866730144373, 3, 0.01), (18.307038053275146, 10, 0.05), (0.0, 4, 1.0)]
    rows = spark.createDataFrame([(x, df) for x, df, _ in known] + [(None, 2), (1.0, 0)], "x double, df int")
    got = [r[0] for r in rows.select(stats.chi2_tail(F.col("x"), F.col("df"))).collect()]
    assert got[:5] == pytest.approx([p for _, _, p in known], abs=1e-9)
    assert all(v is None or math.isnan(v) for v in got[5:])


def test_equal_times_keep_the_order_of_storage(spark):
    rows = [("a", "r", 1.0, 5.0, 0), ("a", "r", 1.0, 1.0, 1), ("a", "r", 2.0, 9.0, 2)]
    points = curves.canonical(spark.createDataFrame(rows, "id_objeto string, banda string, t double, m double, src_idx long"))
    assert features.change_stats(points).first()["max_abs_change"] == 8.0
    assert features.core_features(points).first()["maximum_slope"] == 8.0


def test_resampling_a_straight_line(spark):
    rows = [("a", "r", float(t), 2.0 * t, t) for t in (0, 1, 3, 4, 10)] + [("a", "r", 10.0, 99.0, 11), ("flat", "r", 0.0, 1.0, 0), ("flat", "r", 1.0, 1.0, 1)]
    points = curves.canonical(spark.createDataFrame(rows, "id_objeto string, banda string, t double, m double, src_idx long"))
    got = shapes.resampled(points, bins=11, least=2).orderBy("bin").collect()
    mean, sd = 7.2, math.sqrt(sum((2 * t - 7.2) ** 2 for t in (0, 1, 3, 4, 10)) / 5)
    assert [r["bin"] for r in got] == list(range(11))
    assert [r["value"] for r in got] == pytest.approx([(2 * t - mean) / sd for t in range(11)])


def test_binary_records(spark, tmp_path):
    (tmp_path / "x.name").write_text("amp  period\n")
    (tmp_path / "x.dat").write_bytes(b"".join(struct.pack("<2f", i, i / 2) for i in range(5)))
    (tmp_path / "ids.dat").write_bytes(b"".join(struct.pack("<Q", 10**12 + i) for i in range(5)))
    read = lambda ids: binary_table(spark, *(f"file://{tmp_path}/{n}" for n in ("x.dat", "x.name", ids)))
    assert sorted(map(tuple, read("ids.dat").collect())) == [(10**12 + i, float(i), i / 2) for i in range(5)]
    (tmp_path / "few.dat").write_bytes(struct.pack("<Q", 1))
    with pytest.raises(Exception, match="different numbers"):
        read("few.dat").collect()


def test_experiments_find_the_feature_that_tells_classes_apart(spark):
    rows = [(i, "ab"[i % 2], float(i % 2) + (i % 7) / 100, float(i % 5)) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, clase string, good double, noise double")
    train, test = frame.where("id < 80"), frame.where("id >= 80")
    model = partial(models.logistic_control, steps=20)
    got = {r["experiment"]: r for r in experiments.compared(train, test, experiments.leaving_out({"g": ["good"], "n": ["noise"]}), model).collect()}
    assert got["all"]["accuracy"] == got["without_n"]["accuracy"] == 1.0 and got["without_g"]["accuracy"] < 0.9
    assert got["all"]["n"] == 40 and got["without_g"]["n_features"] == 1
    assert experiments.selected(train, test, ["good", "noise"], model).first()["feature"] == "good"
    best = experiments.importances(train, ["good", "noise"], trees=10, depth=4).orderBy(F.desc("forest")).first()
    assert best["feature"] == "good" and best["logistic"] > 0
    assert experiments.taking_away({"g": ["good"], "n": ["noise"]}) == {"all": ["good", "noise"], "also_without_g": ["noise"]}


def test_a_set_against_itself_takes_only_optional_columns_with_values(spark):
    rows = [(i, float(i % 10), float("nan") if i == 3 else float(i % 4), None) for i in range(60)] + [(99, 500.0, 300.0, None)]
    frame = spark.createDataFrame(rows, "id long, x double, y double, period double")
    got = detect.detect_self(frame, ["x", "y"], trees=20).orderBy("rank_if").first()
    assert got["id"] == 99 and got["strong_global"]


def test_experiments_go_on_where_they_stopped(spark, tmp_path):
    rows = [(i, "ab"[i % 2], float(i % 2) + (i % 7) / 100, float(i % 5)) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, clase string, good double, noise double")
    train, test, fitted = frame.where("id < 80"), frame.where("id >= 80"), []
    sets = {"all": ["good", "noise"], "good": ["good"], "noise": ["noise"]}

    def model(a, b):
        n = len(a.first()["v"])
        fitted.append(n)
        if n == 2 and len(fitted) <= 3:
            raise RuntimeError("lost")
        return models.logistic_control(a, b, steps=10)

    run = partial(experiments.compared_durably, train, test, sets, f"file://{tmp_path}", {"rows": "id < 80"}, model)
    with pytest.raises(RuntimeError, match="lost"):
        run()
    assert sorted(fitted) == [1, 1, 2]
    got = {r["experiment"]: r["accuracy"] for r in run().collect()}
    assert sorted(fitted) == [1, 1, 2, 2] and got["all"] == got["good"] == 1.0 and got["noise"] < 0.9
    want = experiments.compared(train, test, sets, partial(models.logistic_control, steps=10))
    assert sorted(map(tuple, run().collect())) == sorted(map(tuple, want.collect())) and len(fitted) == 4
    other = experiments.compared_durably(train, test, {"good": ["good"]}, f"file://{tmp_path}", {"rows": "all"}, model)
    assert other.count() == 1 and len(fitted) == 5


def test_a_fit_passes_over_different_rows_dealt_evenly(spark, monkeypatch):
    rows = [(6000 * copy + i, "ab"[(i % 10 + i % 7 // 4) % 2], [float(i % 10), float(i % 1009)]) for copy in range(3) for i in range(6000)]
    frame, seen, fit = spark.createDataFrame(rows, "id long, clase string, v array<double>").coalesce(1), [], LogisticRegression._fit

    def spied(self, table):
        seen.append((table.count(), table.rdd.getNumPartitions()))
        return fit(self, table)

    monkeypatch.setattr(LogisticRegression, "_fit", spied)
    got = models.logistic_control(frame, frame, steps=20)
    assert seen == [(6000, 3)]  # of 18,000 rows in one task
    assert got.count() == 18_000
    monkeypatch.setattr(models, "merged", lambda rows: rows)
    want = models.logistic_control(frame, frame, steps=20)
    assert seen[1][0] == 18_000 and got.exceptAll(want).count() <= 18
