"""Feature families against NumPy on odd curves, manifests in full, look-ups, buckets and exports."""

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

import faintlight
from faintlight import curves
from faintlight.functions import families, features
from faintlight.operators import stats
from faintlight.sources import registry

NAN = float("nan")


def points(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"id_objeto string, banda string, t double, m double, e double, clase string, src_idx long{extra}")


def curve(name, band, m, t=None, e=1.0):
    return [(name, band, float(i if t is None else t[i]), x, e if np.isscalar(e) or e is None else e[i], None, i) for i, x in enumerate(m)]


def test_families_of_a_curve_by_hand(spark):
    m, e, t = [1.0, 4.0, 2.0, 8.0, 3.0], [0.5, 1.0, 2.0, 0.5, 1.0], [5.0, 1.0, 2.0, 9.0, 4.0]
    got = families.eighteen(points(spark, curve("a", "g", m, t, e))).first()
    x, s = np.array(m), np.array(e)
    assert got["std"] == pytest.approx(x.std(ddof=1)) and got["ipr"] == pytest.approx(np.percentile(x, 75) - np.percentile(x, 25))
    assert got["eta"] == pytest.approx((np.diff(x) ** 2).sum() / ((x - x.mean()) ** 2).sum())  # in the order of storage
    d = np.sqrt(5 / 4) * (x - x.mean()) / s
    assert got["stetson_k"] == pytest.approx(np.abs(d).mean() / np.sqrt((d**2).mean()))
    assert got["chi2"] == pytest.approx((((x - x.mean()) / s) ** 2).mean())
    o = np.argsort(t)
    assert got["maximum_slope"] == pytest.approx(np.abs(np.diff(x[o]) / np.diff(np.array(t)[o])).max())
    both = families.seventeen(points(spark, curve("a", "g", m, t, e) + curve("a", "r", [2.0, 2.0]))).first()
    w = np.average(x, weights=1 / s**2)
    assert both["chi2"] == pytest.approx((((x - w) / s) ** 2).mean() / 2) and both["n"] == 3.5


def test_bands_follow_each_other_in_their_fixed_order(spark):
    p = points(spark, curve("a", "i", [9.0, 9.0]) + curve("a", "g", [1.0, 2.0]) + curve("a", "r", [5.0, 7.0]) + curve("a", "z", [100.0, 200.0]))
    got = families.fifteen(p).first()
    x = np.array([1.0, 2.0, 5.0, 7.0, 9.0, 9.0])
    z = np.cumsum((x - x.mean()) / x.std())
    assert got["n"] == 6 and got["change_mean"] == pytest.approx(np.abs(np.diff(x)).mean()) and got["cusum"] == pytest.approx(z.max() - z.min())
    relative = families.fifteen(p, relative=True).first()
    assert relative["mean"] is None and relative["std_relative"] == pytest.approx(x.std() / 4) and relative["skew"] == pytest.approx(got["skew"])


def test_short_flat_and_broken_curves_in_all_families(spark):
    rows = curve("one", "g", [3.0]) + curve("flat", "r", [2.0, 2.0, 2.0]) + curve("bad", "i", [NAN, 1.0, 2.0], e=[1.0, NAN, None]) + curve(None, "g", [1.0, 2.0], e=None)
    p = points(spark, rows)
    eleven = {r["id_objeto"]: r for r in families.eleven(p).collect()}
    assert set(eleven) == {"one", "flat"} and eleven["one"]["g_slope"] == 0 and eleven["one"]["g_cadence_mean"] == 0 and eleven["flat"]["r_skew"] == 0 and eleven["flat"]["g_n"] is None
    assert len(eleven["one"]) == 1 + 3 * 21 + 1
    twelve = {r["id_objeto"]: r for r in families.twelve(p).collect()}
    assert twelve["one"]["g_slope"] is None and twelve["bad"]["i_n"] == 1 and twelve[None]["g_error_mean"] is None
    thirteen = {r["id_objeto"]: r for r in families.thirteen(p).collect()}
    assert thirteen[None]["g_snr"] == 0 and thirteen["one"]["g_std_diff"] == 0 and len(thirteen["one"]) == 1 + 3 * 16 + 1
    fifteen = {r["id_objeto"]: r for r in families.fifteen(p).collect()}
    assert fifteen["one"]["std"] is None and fifteen["flat"]["kurtosis"] == 0 and fifteen["flat"]["cusum"] == 0
    sixteen = {r["id_objeto"]: r for r in families.sixteen(p).collect()}
    assert sixteen["bad"]["i_mean"] == 0 and sixteen["bad"]["i_mad"] == 1 and sixteen["flat"]["r_std"] == 0
    seventeen = {r["id_objeto"]: r for r in families.seventeen(p).collect()}
    assert seventeen["one"]["std"] == 0 and seventeen[None]["chi2"] == 0 and seventeen["flat"]["eta"] == 0
    eighteen = {r["id_objeto"]: r for r in families.eighteen(p).collect()}
    assert eighteen["flat"]["stetson_k"] == 0 and eighteen[None]["chi2"] == 0 and eighteen["one"]["maximum_slope"] == 0
    for family in (families.eleven, families.twelve, families.thirteen, families.fifteen, families.sixteen, families.seventeen, families.eighteen):
        assert family(p.where("false")).count() == 0


def test_modes_take_the_longest_band(spark):
    line = [float(i) for i in range(12)]
    p = points(spark, curve("a", "g", [1.0] * 11) + curve("a", "r", line) + curve("flat", "g", [1.0] * 12) + curve("short", "g", line[:9]))
    p = p.withColumn("period", p["t"] * 0 + 2.5)
    got = {mode: {r["id_objeto"]: r for r in families.fourteen(p, mode, bins=8).collect()} for mode in families.MODES}
    assert got["period"]["a"]["period"] == 2.5 and set(got["period"]) == {"a", "flat"} and set(got["shape"]) == {"a"}
    assert got["observation"]["a"]["n"] == 12 and got["observation"]["a"]["duration"] == 11 and got["statistics"]["a"]["amplitude"] == 11
    z = (np.linspace(0, 11, 8) - 5.5) / np.std(line)
    assert [got["shape_period"]["a"][f"shape_{i}"] for i in range(8)] == pytest.approx(z)
    assert [len(next(iter(got[m].values()))) for m in families.MODES] == [2, 9, 12, 9, 10, 29]
    with pytest.raises(ValueError):
        families.fourteen(p, "none")


def test_own_periods_fold_each_curve(spark):
    t = np.linspace(0, 30, 60)
    rows = [r for name, period in (("a", 2.0), ("b", 5.0)) for r in curve(name, "g", [float(x) for x in 3 * np.sin(2 * np.pi * t / period)], t)]
    meta = [(*r, {"period": 2.0} if r[0] == "a" else {"period": 5.0}) for r in rows] + [(*r, {}) for r in curve("c", "g", [1.0, 2.0])]
    p = points(spark, meta, ", metadata map<string,double>")
    found = {r["id_objeto"]: r for r in features.fourier_features(p).collect()}
    assert set(found) == {"a", "b"} and all(r["amplitude_1"] == pytest.approx(3) and r["residual_std"] < 1e-6 for r in found.values())
    core = {r["id_objeto"]: r["period"] for r in features.core_features(p).collect()}
    assert core == {"a": 2.0, "b": 5.0, "c": None}


def test_own_steps(spark):
    p = points(spark, [(*r, s) for r, s in zip(curve("a", "g", [1.0, 3.0, 10.0, 4.0]), [None, 2.0, 0.0, 4.0], strict=True)], ", own double")
    got = families.seventeen(p, step="own").first()
    assert got["maximum_slope"] == 0.25 and got["step_mean"] == 3 and got["step_std"] == 1


def test_manifests_in_full(spark, tmp_path):
    registry.write_template(str(tmp_path / "my.yaml"))
    with pytest.raises(FileExistsError):
        registry.write_template(str(tmp_path / "my.yaml"))
    assert registry.available(str(tmp_path))[0] == ("my_source", "My source")
    (tmp_path / "t.csv").write_text("object_id,mjd,mag,mag_err,filter,class\nx,2459000.5,2.5,0.1,r,RR\nx,null,-999,,r,RR\n")
    manifest = yaml.safe_load(registry.TEMPLATE)
    manifest["acceso"]["ruta_defecto"], manifest["unidades"]["offset_tiempo"] = str(tmp_path / "t.csv"), -2400000.5
    got = registry.tabular(spark, manifest).orderBy("src_idx").collect()
    assert [(r["t"], r["m"], r["e"], r["banda"], r["clase"]) for r in got] == [(59000.0, 2.5, 0.1, "r", "RR"), (None, None, None, "r", "RR")]
    manifest["acceso"]["formato"] = "xml"
    with pytest.raises(ValueError):
        registry.tabular(spark, manifest)


def test_look_ups_bands_and_buckets(spark):
    rows = spark.createDataFrame([("star 7 x",), ("star 8",), ("none",), (None,)], "key string")
    classes = spark.createDataFrame([(7, "b"), (7, "a"), (9, "c")], "id_objeto long, clase string")
    assert [tuple(r) for r in registry.classed(rows, "key", r"star\s+(\d+)", classes).select("id_objeto", "clase").collect()] == [("7", "a")]
    p = points(spark, curve("a", "z", [1.0]) + curve("b", "i", [1.0]) + curve("b", "g", [2.0]))
    assert [(r["id_objeto"], r["banda"]) for r in curves.first_named_band(p).collect()] == [("b", "g")]
    scored = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (2, "b", "b"), (50, "a", None), (None, "a", "a"), (1, None, "a")], "n int, y string, g string")
    got = {r["bucket"]: r for r in stats.bucket_metrics(scored, "n", "y", "g", {"low": (None, 10), "mid": (10, 20), "high": (20, None)}).collect()}
    assert (got["low"]["objects"], got["low"]["accuracy"], got["low"]["balanced"], got["low"]["median"]) == (3, pytest.approx(2 / 3), 0.75, 2)
    assert (got["mid"]["objects"], got["mid"]["mean"], got["mid"]["balanced"]) == (0, None, None) and got["high"]["accuracy"] == 0


def test_exports():
    assert all(hasattr(faintlight, name) for name in faintlight.__all__)


def test_points_are_dealt_over_bounded_tasks(spark, monkeypatch):
    from faintlight.plans import queries

    monkeypatch.setattr(curves, "TASK_POINTS", 500)
    sf = "/root/testdata/sf0.001"
    for name in ("family_15", "family_17", "tie_groups", "tie_characterisation"):
        found = queries.QUERIES[name](spark, sf)
        assert found.rdd.getNumPartitions() >= spark.read.parquet(f"{sf}/lineitem.parquet").count() / 500
    sizes = queries.lc_part(spark, sf).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 1500
