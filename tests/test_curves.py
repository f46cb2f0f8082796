"""Small curves with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from faintlight import curves
from faintlight.functions import features
from faintlight.operators import crossmatch, detect, forest, matching, models, neighbours, quality, stats, trees
from faintlight.sources import registry


def points(spark, rows):
    return curves.canonical(spark.createDataFrame(rows, "id_objeto string, banda string, t double, m double, e double, clase string, src_idx long"))


def curve(spark, ts, ms, es=None, band="r"):
    return points(spark, [("a", band, t, m, e, "k", i) for i, (t, m, e) in enumerate(zip(ts, ms, es or [None] * len(ts), strict=True))])


def test_core_features(spark):
    f = features.core_features(curve(spark, [3.0, 1.0, 2.0, 2.0, 5.0], [4.0, 1.0, 2.0, 2.0 + 0.0, 16.5])).first()
    assert f["n_points"] == 5
    f = features.core_features(curve(spark, [1.0, 2.0, 2.0, 3.0, 5.0], [1.0, 2.0, 4.0, 8.0, 16.5])).first()
    assert f["eta"] == pytest.approx(0.7340207808564232) and f["maximum_slope"] == 4.25
    assert f["skew"] == pytest.approx(0.9224931669965295) and f["kurtosis"] == pytest.approx(-0.6223625395757866)
    assert f["inter_percentile_range_25"] == 10.75 and f["chi2"] == pytest.approx(1.25)


def test_flat_and_single_curves(spark):
    f = features.core_features(curve(spark, [1.0, 2.0, 3.0, 4.0], [7.0] * 4)).first()
    assert [f[c] for c in ("skew", "kurtosis", "stetson_K", "chi2", "eta", "maximum_slope")] == [0.0] * 6
    f = features.core_features(curve(spark, [1.0], [7.0])).first()
    assert f["eta"] == 0.0 and f["maximum_slope"] == 0.0
    assert features.core_features(curve(spark, [], [])).count() == 0


def test_cleaning_and_validity(spark):
    nan, inf = math.nan, math.inf
    p = curve(spark, [1.0, nan, 3.0, 4.0], [1.0, 2.0, inf, 4.0], [0.1, 0.1, 0.1, nan])
    assert curves.clean(p).count() == 1
    assert curves.validity(p).first()["valid"] is True  # errors don't count for validity
    assert curves.valid_curves(curve(spark, [1.0], [1.0])).count() == 0


def test_main_band(spark):
    p = points(spark, [("a", b, 1.0, 1.0, None, None, i) for i, b in enumerate(["i", "g", None])] + [("b", "x", 1.0, 1.0, None, None, 9), ("b", "w", 1.0, 1.0, None, None, 10)])
    assert {(r["id_objeto"], r["banda"]) for r in curves.main_band(p).collect()} == {("a", "g"), ("b", "x")}


def test_fourier_finds_a_sine(spark):
    ts = [i * 0.37 for i in range(40)]
    f = features.fourier_features(curve(spark, ts, [math.sin(math.pi * t) for t in ts]), F.lit(2.0)).first()
    assert f["amplitude_1"] == pytest.approx(1.0) and f["r21"] == pytest.approx(0, abs=1e-9) and f["residual_std"] == pytest.approx(0, abs=1e-6)
    assert features.fourier_features(curve(spark, ts[:5], ts[:5]), F.lit(2.0)).first()["amplitude_1"] is None


def test_padding_and_ties(spark):
    p = curve(spark, [1.0, 2.0, 3.0, 3.0, 3.0], [1.0, 2.0, 5.0, 5.0, 5.0])
    assert quality.tail_padding(p).first()["n_padding"] == 2
    assert [(r["t"], r["size"], r["constant"], r["at_end"]) for r in quality.tie_groups(p).collect()] == [(3.0, 3, True, True)]
    same = curve(spark, [2.0, 1.0], [2.0, 1.0]).withColumn("id_objeto", F.lit("b"))
    assert quality.curve_hash(same.union(curve(spark, [1.0, 2.0], [1.0, 2.0]))).select("content").distinct().count() == 1


def test_percentile_rank_and_auc(spark):
    s = spark.createDataFrame([(3,), (1,), (3,), (2,)], "s int")
    assert sorted(r[0] for r in s.select(stats.percentile_rank("s")).collect()) == [25.0, 50.0, 87.5, 87.5]
    toy = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert stats.roc_auc(toy, "s", "y").first()["auc"] == 0.75


def test_designations_and_cones(spark):
    names = spark.createDataFrame([("CSS_J103704.9-103740",), ("CSS_J161804.2+093650",), ("nothing",)], "n string")
    ra, dec = crossmatch.position(F.col("n"))
    got = [tuple(r) for r in names.select(F.round(ra, 8), F.round(dec, 8)).collect()]
    assert got == [(159.27041667, -10.62777778), (244.5175, 9.61388889), (None, None)]
    objects = spark.createDataFrame([(1, 359.9999, 0.0), (2, 10.0, 89.9999), (3, 50.0, 5.0)], "id long, ra double, dec double")
    stars = spark.createDataFrame([(7, 0.0001, 0.0), (8, 190.0, 89.9999), (9, 51.0, 5.0)], "cat_id long, ra double, dec double")
    assert {r["id"]: r["cat_id"] for r in crossmatch.cone_join(objects, stars, 0.001).collect()} == {1: 7, 2: 8, 3: None}


def test_forest_ranks_an_outlier_first(spark):
    rows = [(i, [(i * 7 % 11) / 11, (i * 5 % 13) / 13]) for i in range(99)] + [(99, [10.0, 10.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["score"] for r in forest.scored(v, forest.grown(v, trees=50)).collect()}
    assert max(got, key=got.get) == 99 and all(0 < s < 1 for s in got.values())


def test_small_classes_have_no_candidates(spark):
    rows = [(i, "big" if i < 60 else "small", float(i % 7), float(i % 5)) for i in range(80)]
    f = spark.createDataFrame(rows, "id long, clase string, x double, y double")
    got = detect.detect_per_class(f, f, ["x", "y"], trees=10).collect()
    assert {r["clase"]: r["enough"] for r in got} == {"big": True, "small": False}
    assert not any(r["strong_in_class"] for r in got if r["clase"] == "small")


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("obj,time,mag,b\nx,1,2.5,r\nx,2,-999,r\ny,3,bad,g\n")
    manifest = {"mapeo_columnas": {"id_objeto": "obj", "tiempo": "time", "magnitud": "mag", "banda": "b"}, "offset_tiempo": 100}
    got = registry.tabular(spark, manifest, str(tmp_path / "t.csv")).orderBy("id_objeto", "t").collect()
    assert [(r["id_objeto"], r["t"], r["m"]) for r in got] == [("x", 101.0, 2.5), ("x", 102.0, None), ("y", 103.0, None)]
    with pytest.raises(ValueError):
        registry.tabular(spark, {"mapeo_columnas": {"id_objeto": "obj"}}, "x")
    (tmp_path / "a.yaml").write_text("nombre: Zed\nmapeo_columnas: {id_objeto: obj}\n")
    (tmp_path / "b.yaml").write_text("nombre: [\n")
    with pytest.warns(UserWarning):
        assert registry.available(str(tmp_path)) == [("a", "Zed")]
    assert registry.typed([{"id": "n", "tipo": "numero"}, {"id": "f", "tipo": "ruta_archivo"}], {"n": "-3", "f": "a;b"}) == {"n": -3, "f": ["a", "b"]}
    with pytest.raises(TypeError):
        registry.register("x", "x")(int)


def test_nested_source(spark):
    band = "struct<mjd:array<double>,target:array<double>,past_feat_dynamic_real:array<double>>"
    f = spark.createDataFrame([("s", "RRab", ({"mjd": [1.0, 2.0], "target": [3.0, 4.0], "past_feat_dynamic_real": [0.1, 0.2]}, None, None))], f"sourceid string, class_str string, bands_data struct<g:{band},r:{band},i:{band}>")
    assert [(r["banda"], r["t"], r["m"], r["e"]) for r in registry.nested(f).collect()] == [("g", 1.0, 3.0, 0.1), ("g", 2.0, 4.0, 0.2)]


def test_greedy_match_takes_what_one_sequence_would(spark):
    pairs = [(a, b, float((a * 7 + b * 13) % 5)) for a in range(12) for b in range(9) if (a + b) % 3]
    used, wanted = set(), set()
    for d, a, b in sorted((d, a, b) for a, b, d in pairs):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            wanted.add((a, b, d))
    kinds = "id long, neighbour long, distance double"
    rows = [*pairs, pairs[0], (1, None, 0.0), (None, 2, 0.0), (3, 3, float("nan"))]
    assert {tuple(r) for r in matching.greedy_match(spark.createDataFrame(rows, kinds)).collect()} == wanted
    assert matching.greedy_match(spark.createDataFrame([], kinds)).count() == 0


def test_matching_goes_on_after_the_first_neighbours(spark):
    where = {i: float(i * i % 17) / 16 + (5.0 if i > 30 else 0.0) for i in range(40)} | {i: 3.0 for i in range(40, 64)}
    v = spark.createDataFrame([(i, [x]) for i, x in where.items()], "id long, v array<double>")
    a, b = v.where("id % 2 = 0"), v.where("id % 2 = 1")
    for k in (2, 5):
        near = neighbours.nearest(a, b, k)
        bound = 1.5 * near.agg(F.percentile("distance", 0.25)).first()[0] if k > 2 else 0.0
        used, wanted = set(), set()
        for d, x, y in sorted((abs(where[x] - where[y]), x, y) for x in where for y in where if x % 2 == 0 and y % 2 == 1):
            if d <= bound and x not in used and y not in used:
                used |= {x, y}
                wanted.add((x, y))
        factor = 1.5 if k > 2 else 0.0
        assert {(r["id"], r["neighbour"]) for r in matching.match_all(a, b, k, factor).collect()} == wanted
        assert {40, 42, 44, 46, 48, 50, 52, 54, 56, 58, 60, 62} <= {x for x, _ in wanted}


def test_silhouettes(spark):
    v = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 0), (2, [10.0], 1), (3, None, 1)], "id long, v array<double>, label long")
    got = {r["id"]: r["silhouette"] for r in neighbours.silhouettes(v, v).collect()}
    assert got == {0: pytest.approx(0.9), 1: pytest.approx(8 / 9), 2: 0.0}


def test_controls_learn_separate_classes(spark):
    rows = [(i, "ab"[i % 2], [float(i % 2 * 10 + i % 3), float(i % 5)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, clase string, v array<double>")
    for got in (models.forest_control(v, v, trees=5), models.logistic_control(v, v)):
        assert all(r["clase"] == r["prediction"] for r in got.collect())


def test_detector_queries_take_all_classes_and_trees(spark, monkeypatch):
    from faintlight.plans import queries

    calls = []
    for name in ("detect", "detect_global", "detect_against_classes"):
        monkeypatch.setattr(detect, name, lambda train, test, columns, **options: calls.append((train, test, options)) or train.withColumn("scores", F.lit(0)))
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/part.parquet").select("p_brand").distinct().count()
    for name in ("full_pipeline", "ood_min_score", "iforest_lof_global"):
        queries.QUERIES[name](spark, sf)
        train, test, options = calls.pop()
        assert train.union(test).select("clase").distinct().count() == n and not options


def test_forests_of_classes_are_those_of_each_class(spark):
    rows = [(i, "ab"[i % 2], [(i * 7 % 11) / 11, (i * 5 % 13) / 13]) for i in range(80)]
    v = spark.createDataFrame(rows, "id long, clase string, v array<double>")
    got = forest.grown_by_class(v, trees=5)
    for k in "ab":
        size, trees = forest.grown(v.where(F.col("clase") == k), trees=5)
        plain = lambda ts: sorted((t["tree"], t["feature"], t["cut"], t["path"]) for t in ts)
        assert got[k][0] == size and plain(got[k][1]) == plain(trees)


def test_cones_find_what_all_pairs_would(spark, monkeypatch):
    rng = np.random.default_rng(7)
    where = lambda n: [*zip(rng.uniform(0, 360, n), rng.uniform(-90, 90, n)), *zip(rng.uniform(0, 360, n), rng.uniform(88, 90, n)), *zip(10 + rng.normal(0, 0.01, n), rng.normal(0, 0.01, n))]  # noqa: E731, B905
    a, b = where(150), where(150)
    b += b[:40] + a[:20]
    objects = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([*a, a[3]])] + [(999, None, 1.0)], "id long, ra double, dec double")
    stars = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "cat_id long, ra double, dec double")
    monkeypatch.setattr(crossmatch, "CELL", 4)
    got = {r["id"]: r for r in crossmatch.cone_join(objects, stars, 3.0).collect()}
    assert len(got) == 452 and got[999]["cat_id"] is None
    every = objects.crossJoin(stars.select("cat_id", F.col("ra").alias("x"), F.col("dec").alias("y"))).withColumn("d", crossmatch.separation(F.col("ra"), F.col("dec"), F.col("x"), F.col("y"))).where("d <= 3")
    wanted = {r["id"]: r["s"] for r in every.groupBy("id").agg(F.min(F.struct("d", "cat_id")).alias("s")).collect()}
    assert all((r["distance"], r["cat_id"]) == tuple(wanted.get(i, (None, None))) for i, r in got.items())


def test_crowded_cones_begin_narrow(spark):
    k = F.col("id")
    points = spark.range(4000).select("id", ((k * 7919) % 36000 / 100.0).alias("ra"), ((k * 104729) % 100 / 100.0 + 84).alias("dec"))
    stars = points.where("id % 2 = 1").select(k.alias("cat_id"), F.col("ra").alias("cat_ra"), F.col("dec").alias("cat_dec"))
    reach = crossmatch.first_radius(stars, 2.0)
    assert reach < 1 and crossmatch.candidates(points.where("id % 2 = 0").select("ra", "dec"), stars, reach).count() < 2000 * 9 * crossmatch.CELL


def test_control_forests_grow_whole_trees(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6))
    rows = [(i, str(int(a[0] > 0) + 2 * int(a[1] + a[2] > 0)), [float(v) for v in a]) for i, a in enumerate(x)]
    v = spark.createDataFrame(rows, "id long, clase string, v array<double>")
    train, test = v.where("id % 3 > 0"), v.where("id % 3 = 0")
    calls = []
    monkeypatch.setattr(trees.RandomForestClassifier, "fit", lambda *a: calls.append(a))
    got = models.forest_control(train, test, trees=30).collect()  # no pass of the table for each few nodes
    assert not calls and len(got) == 200 and sum(r["clase"] == r["prediction"] for r in got) > 170
    assert all(r["clase"] == r["prediction"] for r in models.forest_control(train, train.limit(50), trees=60).collect())
    monkeypatch.undo()
    monkeypatch.setattr(trees, "WHOLE", 100)
    got = models.forest_control(train, test, trees=10).collect()
    assert len(got) == 200 and sum(r["clase"] == r["prediction"] for r in got) > 160


def test_best_cuts_are_those_of_all_cuts():
    rng = np.random.default_rng(5)
    node, rank, y, w, n = rng.integers(0, 3, 60), rng.integers(0, 9, 60), rng.integers(0, 4, 60), rng.uniform(0.5, 2, 60), rng.integers(1, 4, 60)
    totals = np.array([[w[(node == a) & (y == c)].sum() for c in range(4)] for a in range(3)])
    for of, score, low, _ in zip(*trees._split(node, rank, y, w, n, totals, 4), strict=True):
        every = {}
        for cut in range(8):
            a, b = (node == of) & (rank <= cut), (node == of) & (rank > cut)
            if n[a].sum() >= 4 and n[b].sum() >= 4:
                every[cut] = sum(sum(w[s & (y == c)].sum() ** 2 for c in range(4)) / w[s].sum() for s in (a, b))
        assert score == pytest.approx(max(every.values())) and score == pytest.approx(every[low])
