"""Detection with the class as a key: the rows of each class by itself, however many classes there are."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faintlight.operators import detect, forest, models, neighbours, trees


def rows(spark, rng, n, classes, first=0):
    x = rng.normal(size=(n, 2)) * [3, 1] + [5, 0]
    return spark.createDataFrame([(first + i, float(a), float(b), f"c{i % classes}") for i, (a, b) in enumerate(x)], "id long, x double, y double, clase string").repartition(4)


def test_many_classes_give_what_each_gives_by_itself(spark, monkeypatch):
    monkeypatch.setattr(detect, "MIN_CLASS", 8)
    monkeypatch.setattr(forest, "ROWS", 16)
    monkeypatch.setattr(forest, "CHUNKS", 2)
    rng = np.random.default_rng(1)
    train, test = rows(spark, rng, 1000, 50), rows(spark, rng, 500, 50, 5000)
    few = F.when(F.col("id") == 0, "lonely").otherwise(F.col("clase")).alias("clase")
    train, test = (f.select("id", "x", "y", few) for f in (train, test))
    got = {r["id"]: r for r in detect.detect_per_class(train, test, ["x", "y"], trees=5, percent=80.0).collect()}
    assert len(got) == 500 and any(r["strong_in_class"] for r in got.values())
    for k in ("c3", "c17"):
        a, b = train.where(F.col("clase") == k), test.where(F.col("clase") == k)
        alone = {r["id"]: r for r in detect.scores(a, b, ["x", "y"], trees=5).collect()}
        assert len(alone) == 10
        for i, r in alone.items():
            assert (got[i]["score_if"], got[i]["score_lof"]) == pytest.approx((r["score_if"], r["score_lof"]))
        for s in ("if", "lof"):
            ranks = pd.Series({i: got[i][f"score_{s}"] for i in alone}).rank() / 10 * 100
            assert {i: got[i][f"percentile_{s}"] for i in alone} == pytest.approx(ranks.to_dict())


def test_scores_against_classes_are_those_of_their_forests(spark, monkeypatch):
    monkeypatch.setattr(detect, "MIN_CLASS", 20)
    monkeypatch.setattr(forest, "ROWS", 32)
    rng = np.random.default_rng(2)
    train, test = rows(spark, rng, 90, 3), rows(spark, rng, 150, 7, 1000)
    got = {(r["id"], r["clase"]): r["score"] for r in detect.class_scores(train, test, ["x", "y"], trees=6).collect()}
    assert len(got) == 450
    for k in ("c0", "c2"):
        own = train.where(F.col("clase") == k)
        for r in detect.scores(own, test, ["x", "y"], trees=6).collect():
            assert got[r["id"], k] == pytest.approx(r["score_if"])
    out = {r["id"]: r for r in detect.detect_against_classes(train, test, ["x", "y"], trees=6).collect()}
    for i, r in out.items():
        best = min((s, k) for (j, k), s in got.items() if j == i)
        assert (r["score_min"], r["nearest_class"]) == best and r["scores"] == {k: got[i, k] for k in ("c0", "c1", "c2")}
    assert sorted(r["rank_percentile"] for r in out.values())[-1] == 100.0
    with pytest.raises(ValueError, match="no class"):
        detect.detect_against_classes(train.limit(3), test, ["x", "y"], trees=2)


def test_no_plan_grows_with_the_classes(spark, monkeypatch):
    monkeypatch.setattr(detect, "MIN_CLASS", 2)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(3)
    jobs = {}
    for classes in (25, 500):
        train, test = rows(spark, rng, 4 * classes, classes), rows(spark, rng, 2 * classes, classes, 10**6)
        spark.sparkContext.setJobGroup(f"of {classes}", "")
        assert detect.detect_per_class(train, test, ["x", "y"], trees=2).count() == 2 * classes
        jobs[classes] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"of {classes}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[500] <= 1.5 * jobs[25]


def test_the_control_forest_is_that_of_the_experiments(spark):
    rows = [(i, "ab"[i % 2] if i != 4 else None, float(i % 2) + (i % 7) / 100, float(i % 5) if i != 7 else None) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, kind string, x double, y double")
    train, test = frame.where("id < 80"), frame.where("id >= 80").unionByName(spark.createDataFrame([(200, "c", 1.0, 1.0), (201, "a", None, 1.0)], frame.schema))
    got = {r["id"]: r for r in detect.control_forest(train, test, ["x", "y"], "kind", trees=5).collect()}
    assert sorted(got) == [*range(80, 120), 200]
    assert all(not r["wrong"] and r["predicted"] == r["clase"] for i, r in got.items() if i < 200) and got[200]["wrong"]
    v = frame.where("y IS NOT NULL").select("id", F.col("kind").alias("clase"), F.array("x", "y").alias("v"))
    coarse = models.forest_control(v, v, trees=5, leaf=100).select("prediction").distinct().count()
    assert coarse == 1  # no split leaves 100 rows on both sides


def test_a_forest_comes_once_for_many_rows_and_trees_come_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(forest, "ROWS", 50)
    rng = np.random.default_rng(6)
    known = rows(spark, rng, 120, 2).select("id", "clase", F.array("x", "y").alias("v"))
    forests = forest.forests(known, trees=4)
    streams = forest._score_streams

    def seen(batches):
        for batch in batches:
            assert batch.schema.field("cut").type.value_type == "double"  # one tree a row, not a forest beside each block
            yield from streams([batch])

    monkeypatch.setattr(forest, "_score_streams", seen)
    got = forest.scored_by_class(known, forests, against_all=True)
    assert got.count() == 240 and got.select("id", "clase").distinct().count() == 240


def test_neighbouring_numbers_are_split():
    x = [1.0] * 20 + [float(np.nextafter(1.0, 2.0))] * 20
    for tree in range(20):
        pdf = pd.DataFrame({"id": range(40), "tree": tree, "v": [[a] for a in x]})
        found = forest._grow(pdf, 42).iloc[0]
        assert found["feature"] == [0, -1, -1] and found["cut"][0] == x[-1]


def test_rows_come_once_for_the_trees_of_a_unit_and_copies_are_one_row(spark, monkeypatch):
    rng = np.random.default_rng(7)
    points = [(100 * copy + i, [float(a), float(a + i % 2)], f"c{i % 2}") for copy in range(3) for i, a in enumerate(rng.normal(size=100))]
    once = {i % 100: v for i, v, _ in points[:100]}
    frame = spark.createDataFrame([(i, once[i % 100], k) for i, _, k in points], "id long, v array<double>, clase string")
    got = {r["id"]: r["prediction"] for r in models.forest_control(frame, frame, trees=40).collect()}
    assert len(got) == 300 and all(got[i] == got[i % 100] == f"c{i % 2}" for i in got)  # each copy with its own id

    def counted(batches, **_):
        known = sum(b.num_rows - sum(b.column("asks").to_pylist()) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0], type=pa.int32()), pa.array([float(known)])], names=["id", "label", "share"])

    monkeypatch.setattr(trees, "_votes", counted)
    train = frame.select("id", "v", F.expr("int(right(clase, 1))").alias("y"), F.lit(1.0).alias("w"))
    rows = trees.votes(train, frame.select("id", "v"), 2, 40, 30, 1, 42).first()["share"] * 40
    assert rows <= 100 * 2 * spark.sparkContext.defaultParallelism  # not 40 times the 300 rows drawn


def test_a_merged_row_is_drawn_as_often_as_its_copies_together():
    x, y, w = np.arange(400.0)[:, None], np.arange(400) // 100 % 2, np.ones(400)
    rows = [(np.arange(400), x, y, w, np.full(400, 50), np.zeros((400, 2)))]
    grown = trees._grown(rows, (0, 0), 1, 2, 2, 30, 1, 42)
    assert [t.cut[0] % 100 for t in grown] == [99.5, 99.5] and all((t.asked(x).argmax(axis=1) == y).all() for t in grown)  # of 50 copies some are drawn


def test_the_pipeline_gives_what_its_detectors_give(spark, monkeypatch):
    monkeypatch.setattr(detect, "MIN_CLASS", 20)
    rng = np.random.default_rng(8)
    train, test = rows(spark, rng, 120, 2), rows(spark, rng, 60, 2, 1000)
    got = {r["id"]: r for r in detect.detect(train, test, ["x", "y"], trees=5, control_trees=5).collect()}
    whole = {r["id"]: r for r in detect.detect_global(train, test, ["x", "y"], trees=5).collect()}
    in_class = {r["id"]: r for r in detect.detect_per_class(train, test, ["x", "y"], trees=5).collect()}
    control = {r["id"]: r for r in detect.control_forest(train, test, ["x", "y"], trees=5).collect()}
    assert len(got) == 60
    for i, r in got.items():
        assert r["score_lof"] == pytest.approx(whole[i]["score_lof"]) and r["rank_if"] == whole[i]["rank_if"]
        assert (r["strong_in_class"], r["predicted"], r["wrong"]) == (in_class[i]["strong_in_class"], control[i]["predicted"], control[i]["wrong"])


def test_rows_against_themselves_are_worked_out_and_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(60, 2)), rng.integers(1, 4, 60), axis=0)
    seen, searches, searched = spark.sparkContext.accumulator(0), [], neighbours._searched
    schema = "id long, x double, y double"

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], schema)
    monkeypatch.setattr(neighbours, "_searched", lambda *a: searches.append(1) or searched(*a))
    got = {r["id"]: r["score_lof"] for r in detect.detect_self(frame.mapInArrow(counted, schema), ["x", "y"], trees=3).collect()}
    assert seen.value <= 2 * len(x) and len(searches) == 1
    apart = {r["id"]: r["score_lof"] for r in detect.detect_global(frame, frame.where("true"), ["x", "y"], trees=3).collect()}
    assert len(searches) == 3 and got == pytest.approx(apart)


def test_trees_with_a_top_take_turns_and_give_the_same_shares(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(600, 3))
    made = [(i, [float(a) for a in r], int(r[0] > 0) + 2 * int(r[1] > 0), 1.0) for i, r in enumerate(x)]
    frame = spark.createDataFrame(made, "id long, v array<double>, y int, w double")
    train, test = frame.where("id % 4 > 0"), frame.where("id % 4 = 0").select("id", "v")
    monkeypatch.setattr(trees, "WHOLE", 100)
    shuffled, voted = [], trees._voted
    monkeypatch.setattr(trees, "_voted", lambda met, *a: shuffled.append(met.count()) or voted(met, *a))
    shares = {}
    for most in (10**9, 1000):
        monkeypatch.setattr(trees, "SHUFFLED", most)
        shuffled.clear()
        shares[most] = {(r["id"], r["label"]): r["share"] for r in trees.votes(train, test, 4, 10, 8, 1, 42).collect()}
        if most == 1000:
            assert len(shuffled) == 5 and max(shuffled) < 1200
    assert len(shuffled) > 1 and shares[1000] == pytest.approx(shares[10**9], abs=1e-8)
    assert len({i for i, _ in shares[1000]}) == 150
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
