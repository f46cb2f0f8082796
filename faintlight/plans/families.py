"""Queries of whole feature families, own periods, bucket metrics and class look-ups, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from faintlight import curves
from faintlight.functions import families, features
from faintlight.operators import stats
from faintlight.plans.queries import EVENTS, LINEITEM, lc_events, lc_lineitem, query, rounded, table
from faintlight.sources import registry

_Q = {f"p{round(100 * s):02d}": f"quantile_cont(m, {s})" for s in (0.05, 0.10, 0.20, 0.25, 0.75, 0.80, 0.90, 0.95)}
_PLACE = "list_position(['g', 'r', 'i'], banda)"


def _statistics(keys: str, points: str = LINEITEM) -> str:
    """Tables up to `s`: the library's statistics of each key, said in SQL."""
    quantiles = ", ".join(f"{q} AS {name}" for name, q in _Q.items())
    return f"""WITH {points}, c0 AS (SELECT *, CASE WHEN e > 0 THEN e END AS sg, avg(m) OVER k AS mu, quantile_cont(m, 0.5) OVER k AS med, stddev_pop(m) OVER k AS sd, m - lag(m) OVER st AS dm,
    m - lag(m) OVER ti AS tm, t - lag(t) OVER ti AS dt FROM p WINDOW k AS (PARTITION BY {keys}), st AS (PARTITION BY {keys} ORDER BY {_PLACE}, t, m, e), ti AS (PARTITION BY {keys} ORDER BY t, m, e)),
c1 AS (SELECT *, CASE WHEN sd > 1e-12 THEN (m - mu) / sd ELSE 0 END AS z, sum(m / sg / sg) OVER k / sum(1 / sg / sg) OVER k AS wm FROM c0 WINDOW k AS (PARTITION BY {keys})),
c2 AS (SELECT *, sum(z) OVER (PARTITION BY {keys} ORDER BY {_PLACE}, t, m, e ROWS UNBOUNDED PRECEDING) AS cs FROM c1),
s AS (SELECT {keys}, count(*) AS n, avg(m) AS mean, max(med) AS median, stddev_pop(m) AS std, coalesce(stddev_samp(m), 0) AS sdev, quantile_cont(abs(m - med), 0.5) AS mad, min(m) AS mn, max(m) AS mx, {quantiles},
    avg(z * z * z) AS skew, CASE WHEN max(sd) > 1e-12 THEN avg(z * z * z * z) - 3 ELSE 0 END AS kurtosis, CASE WHEN max(sd) > 1e-12 THEN avg(power((m - med) / sd, 3)) ELSE 0 END AS skew_median,
    CASE WHEN max(sd) > 1e-12 THEN avg(abs(z)) / sqrt(avg(z * z)) ELSE 0 END AS sk, CASE WHEN max(sd) > 1e-12 THEN avg(abs((m - mu) / sg)) / sqrt(avg(power((m - mu) / sg, 2))) ELSE 0 END AS ske,
    sum(m / e / e) / sum(1 / e / e) AS weighted_mean, CASE WHEN count(sg) > 1 THEN avg(power((m - wm) / sg, 2)) ELSE 0 END AS chi2w, avg(power((m - mu) / sg, 2)) AS chi2e,
    CASE WHEN max(sd) > 1e-12 AND count(*) > 1 THEN sum(dm * dm) / ((count(*) - 1) * power(max(sd), 2)) ELSE 0 END AS eta, CASE WHEN max(sd) > 1e-12 AND count(*) > 1 THEN sum(dm * dm) / sum(power(m - mu, 2)) ELSE 0 END AS eta2,
    avg(abs(dm)) AS cm, stddev_pop(dm) AS csd, max(abs(dm)) AS cmax, max(cs) - min(cs) AS cusum, CASE WHEN count(*) >= 2 AND max(t) > min(t) THEN regr_slope(m, t) END AS slope,
    coalesce(max(abs(tm / dt)) FILTER (WHERE dt <> 0), 0) AS mslope, avg(e) AS em, quantile_cont(e, 0.5) AS emed, stddev_pop(e) AS esd, avg(dt) AS dtm, quantile_cont(dt, 0.5) AS dtmed, stddev_pop(dt) AS dtsd,
    max(t) - min(t) AS span FROM c2 GROUP BY ALL)"""


def _wide(**columns: str) -> str:
    return ", ".join(f"round(max({v}) FILTER (WHERE banda = '{b}'), 4) + 0.0 AS {b}_{k}" for b in families.BANDS for k, v in columns.items())


def _flat(**columns: str) -> str:
    return ", ".join(f"round({v}, 4) AS {k}" for k, v in columns.items())


_11 = dict(mean="mean", median="median", std="std", p10="p10", p25="p25", p75="p75", p90="p90", iqr="p75 - p25", range_10_90="p90 - p10", amplitude="mx - mn", mad="mad", skew="skew_median", error_mean="em", error_median="emed",
    error_std="esd", cadence_mean="coalesce(dtm, 0)", cadence_median="coalesce(dtmed, 0)", cadence_std="coalesce(dtsd, 0)", baseline="span", slope="CASE WHEN n >= 3 THEN coalesce(slope, 0) ELSE 0 END")
_N = ", ".join(f"max(n) FILTER (WHERE banda = '{b}') AS {b}_n" for b in families.BANDS)


@query(f"{_statistics('id_objeto, banda')} SELECT id_objeto, {_N}, {_wide(**_11)}, NULL::DOUBLE AS period FROM s GROUP BY ALL")
def family_11(spark, sf_dir):
    return rounded(families.eleven(lc_lineitem(spark, sf_dir)), 4)


_12 = dict(mean="mean", std="std", median="median", mad="mad", min="mn", max="mx", amplitude="p95 - p05", iqr="p75 - p25", p10="p10", p90="p90", slope="CASE WHEN n >= 3 THEN slope END", error_mean="em", error_std="esd",
    error_median="emed", cadence_mean="dtm", cadence_std="dtsd")


@query(f"{_statistics('id_objeto, banda')} SELECT id_objeto, {_N}, {_wide(**_12)} FROM s GROUP BY ALL")
def family_12(spark, sf_dir):
    return rounded(families.twelve(lc_lineitem(spark, sf_dir)), 4)


_13 = dict(mean="mean", std="std", median="median", amplitude="mx - mn", p05="p05", p25="p25", p75="p75", p95="p95", iqr="p75 - p25", mad="mad", slope="coalesce(slope, 0)", time_span="span", mean_error="em", snr="std / em",
    std_diff="coalesce(csd, 0)")


@query(f"{_statistics('id_objeto, banda')} SELECT id_objeto, {_N}, {_wide(**_13)}, round(max(id_objeto::INT % 9 + 1.5), 4) AS period FROM s GROUP BY ALL")
def family_13(spark, sf_dir):
    """Each object has a period of its own in its points' metadata."""
    period = F.col("id_objeto").cast("int") % 9 + F.lit(1.5)
    return rounded(families.thirteen(lc_lineitem(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("period"), period))), 4)


_15 = dict(std="std", mad="mad", range="mx - mn", iqr="p75 - p25", skew="skew", kurtosis="kurtosis", change_mean="cm", change_std="csd", change_max="cmax", amplitude="(mx - mn) / 2", percent_amplitude="(mx - mn) / 2 / abs(median)", cusum="cusum",
    error_std="esd", cadence_mean="dtm", cadence_median="dtmed", cadence_std="dtsd")
_15_LEVEL = dict(mean="mean", median="median", weighted_mean="weighted_mean", min="mn", max="mx", p25="p25", p75="p75", error_mean="em", error_median="emed")


@query(f"{_statistics('id_objeto')} SELECT id_objeto, n, {_flat(**_15, **_15_LEVEL)} FROM s")
def family_15(spark, sf_dir):
    return rounded(families.fifteen(lc_lineitem(spark, sf_dir)), 4)


@query(f"{_statistics('id_objeto')} SELECT id_objeto, n, {_flat(**_15)}, " + ", ".join(f"NULL::DOUBLE AS {c}" for c in _15_LEVEL) + ", "
    + _flat(std_relative="2 * std / (mx - mn)", iqr_relative="2 * (p75 - p25) / (mx - mn)", change_relative="2 * cm / (mx - mn)", error_relative="esd / std") + " FROM s")
def family_15_relative(spark, sf_dir):
    return rounded(families.fifteen(lc_lineitem(spark, sf_dir), relative=True), 4)


_CENTRED = f"""raw AS (SELECT id_objeto, banda, m, m - quantile_cont(m, 0.5) OVER k AS c, stddev_pop(m) OVER k AS sd FROM q WINDOW k AS (PARTITION BY id_objeto, banda)),
mads AS (SELECT *, quantile_cont(abs(c), 0.5) OVER (PARTITION BY id_objeto, banda) AS ma FROM raw),
p AS (SELECT id_objeto, banda, 0.0::DOUBLE AS t, c / CASE WHEN ma > 1e-12 THEN ma WHEN sd > 1e-12 THEN sd ELSE 1 END AS m, NULL::DOUBLE AS e FROM mads)"""
_16 = dict(mean="mean", std="std", p10="p10", p25="p25", median="median", p75="p75", p90="p90", range_10_90="p90 - p10", skew="skew", mad="mad")


@query(f"{_statistics('id_objeto, banda', LINEITEM.replace('p AS (', 'q AS (', 1) + ', ' + _CENTRED)} SELECT id_objeto, {_wide(**_16)} FROM s GROUP BY ALL")
def family_16(spark, sf_dir):
    found = rounded(families.sixteen(lc_lineitem(spark, sf_dir)), 4)
    # What is close to 0 may come out as -0 in either engine.
    return found.withColumns({c: F.col(c) + 0.0 for c, kind in found.dtypes if kind == "double"})


_17 = dict(mean="mean", median="median", mad="mad", stetson_k="sk", eta="eta", n="n", chi2="chi2w", std="sdev", amplitude="mx - mn", percent_amplitude="100 * (mx - mn) / greatest(abs(mean), 1e-12)", range_5_95="p95 - p05", range_20_80="p80 - p20",
    skew="CASE WHEN n >= 3 THEN skew ELSE 0 END", kurtosis="CASE WHEN n >= 3 THEN kurtosis ELSE 0 END", error_mean="em", error_median="emed", error_std="esd")
_17_TIME = dict(maximum_slope="mslope", step_mean="coalesce(dtm, 0)", step_median="coalesce(dtmed, 0)", step_std="coalesce(dtsd, 0)")


@query(f"{_statistics('id_objeto, banda')} SELECT id_objeto, " + _flat(**{k: f"avg({v})" for k, v in (_17 | _17_TIME).items()}) + " FROM s GROUP BY ALL")
def family_17(spark, sf_dir):
    return rounded(families.seventeen(lc_lineitem(spark, sf_dir)), 4)


@query(f"""WITH {LINEITEM}, h AS (SELECT *, e % 7 AS own, lag(m) OVER (PARTITION BY id_objeto, banda ORDER BY t, m, e) AS before FROM p WHERE e % 7 > 0),
s AS (SELECT id_objeto, banda, coalesce(max(abs((m - before) / own)), 0) AS slope, avg(own) AS a, quantile_cont(own, 0.5) AS b, stddev_pop(own) AS c FROM h GROUP BY ALL),
b AS (SELECT DISTINCT id_objeto, banda FROM p) SELECT id_objeto, round(avg(coalesce(slope, 0)), 4) AS maximum_slope, round(avg(coalesce(a, 0)), 4) AS step_mean,
    round(avg(coalesce(b, 0)), 4) AS step_median, round(avg(coalesce(c, 0)), 4) AS step_std FROM b LEFT JOIN s USING (id_objeto, banda) GROUP BY ALL""")
def own_step_slopes(spark, sf_dir):
    """Slopes over steps that the source gives, here made of the errors; steps of 0 are left out."""
    p = lc_lineitem(spark, sf_dir).withColumn("own", F.col("e") % 7)
    return rounded(families.seventeen(p, step="own").select("id_objeto", "maximum_slope", "step_mean", "step_median", "step_std"), 4)


_18 = dict(mean="mean", median="median", mad="mad", maximum_slope="mslope", std="sdev", amplitude="mx - mn", percent_amplitude="(mx - mn) / greatest(abs(median), 1e-12)", ipr="p75 - p25", skew="CASE WHEN n >= 3 THEN skew ELSE 0 END",
    kurtosis="CASE WHEN n >= 4 THEN kurtosis ELSE 0 END", stetson_k="CASE WHEN n >= 3 THEN ske ELSE 0 END", eta="eta2", chi2="CASE WHEN n >= 2 THEN chi2e ELSE 0 END")


@query(f"{_statistics('id_objeto')} SELECT id_objeto, {_flat(**_18)} FROM s")
def family_18(spark, sf_dir):
    return rounded(families.eighteen(lc_lineitem(spark, sf_dir)), 4)


_14 = dict(period="0.0::DOUBLE", error_mean="em", error_median="emed", error_std="esd", duration="span", cadence_mean="coalesce(dtm, 0)", cadence_median="coalesce(dtmed, 0)", cadence_std="coalesce(dtsd, 0)", mean="mean", std="std", mad="mad",
    p05="p05", p25="p25", median="median", p75="p75", p95="p95", amplitude="mx - mn", range_5_95="p95 - p05", iqr="p75 - p25")
_LONGEST = f"""f AS (SELECT id_objeto, banda FROM (SELECT id_objeto, banda, row_number() OVER (PARTITION BY id_objeto ORDER BY c DESC, {_PLACE}) AS r FROM (SELECT id_objeto, banda, count(*) AS c FROM q GROUP BY ALL)) WHERE r = 1), p AS (SELECT q.* FROM q JOIN f USING (id_objeto, banda))"""


@query(f"{_statistics('id_objeto', LINEITEM.replace('p AS (', 'q AS (', 1) + ', ' + _LONGEST)} SELECT id_objeto, n, {_flat(**_14)} FROM s WHERE n >= 10")
def family_14(spark, sf_dir):
    """All modes but for the shape's columns, which resampled_curves compares."""
    found = families.fourteen(lc_lineitem(spark, sf_dir), "all")
    return rounded(found.drop(*(c for c in found.columns if c.startswith("shape_"))), 4)


# ---- each object's own period


def _with_period(spark, sf_dir):
    return lc_events(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("period"), F.col("id_objeto").cast("int") % 9 + F.lit(1.5)))


@query(f"WITH {EVENTS} SELECT id_objeto, banda, count(*) AS n_points, round(max(id_objeto::INT % 9 + 1.5), 6) AS period, round(stddev_pop(m), 6) AS standard_deviation FROM p GROUP BY ALL")
def core12_own_period(spark, sf_dir):
    return rounded(features.core_features(_with_period(spark, sf_dir)).select("id_objeto", "banda", "n_points", "period", "standard_deviation"))


def _fold(k: int) -> str:
    return f"cos({k} * u) AS c{k}, sin({k} * u) AS s{k}"


@query(f"""WITH {EVENTS}, u AS (SELECT id_objeto, banda, m - avg(m) OVER k AS m, 2 * pi() * ((t - min(t) OVER k) / (id_objeto::INT % 9 + 1.5) - floor((t - min(t) OVER k) / (id_objeto::INT % 9 + 1.5))) AS u FROM p WINDOW k AS (PARTITION BY id_objeto, banda)),
x AS (SELECT *, {_fold(1)}, {_fold(2)}, {_fold(3)} FROM u)
SELECT id_objeto, banda, count(*) AS n, round(sqrt(sum(m * m)), 4) AS norm, round(sum(m * c1), 4) AS c1, round(sum(m * s1), 4) AS s1, round(sum(m * c3), 4) AS c3, round(sum(c1 * c1), 4) AS c1c1, round(sum(c1 * s3), 4) AS c1s3 FROM x GROUP BY ALL""")
def fourier_moments_own_period(spark, sf_dir):
    f = features.fourier_moments(_with_period(spark, sf_dir))
    y, x = F.col("xty"), F.col("xtx")
    return rounded(f.select("id_objeto", "banda", "n", F.sqrt("yty").alias("norm"), y[1].alias("c1"), y[2].alias("s1"), y[5].alias("c3"), x[8].alias("c1c1"), x[13].alias("c1s3")), 4)


# ---- choices of bands, buckets, look-ups


@query(f"WITH {LINEITEM}, n AS (SELECT * FROM p WHERE banda <> 'r' OR id_objeto::INT % 2 = 0), f AS (SELECT id_objeto, arg_min(banda, list_position(['r', 'g'], banda)) AS banda FROM n WHERE banda IN ('r', 'g') GROUP BY ALL) SELECT id_objeto, banda, count(*) AS n FROM n JOIN f USING (id_objeto, banda) GROUP BY ALL")
def first_named_band(spark, sf_dir):
    p = lc_lineitem(spark, sf_dir).where((F.col("banda") != "r") | (F.col("id_objeto").cast("int") % 2 == 0))
    return curves.first_named_band(p, ("r", "g")).groupBy("id_objeto", "banda").agg(F.count("*").alias("n"))


_GUESSED = "c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT n, p_brand AS truth, CASE WHEN p_partkey % 3 = 0 THEN 'other' ELSE p_brand END AS guess FROM c JOIN part ON p_partkey = l_partkey)"


@query(f"""WITH {_GUESSED}, d AS (SELECT * FROM (VALUES ('none', 0, 1), ('few', 1, 25), ('some', 25, 35), ('many', 35, NULL)) v(bucket, low, high)),
j AS (SELECT bucket, g.* FROM d LEFT JOIN g ON n >= low AND (high IS NULL OR n < high)), r AS (SELECT bucket, truth, count(*) AS k, avg((truth = guess)::INT) AS recall FROM j WHERE truth IS NOT NULL GROUP BY ALL)
SELECT bucket, count(truth) AS objects, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(avg((truth = guess)::INT), 6) AS accuracy, (SELECT round(avg(recall), 6) FROM r WHERE r.bucket = j.bucket) AS balanced FROM j GROUP BY bucket""")
def bucket_metrics(spark, sf_dir):
    """Accuracies in buckets of so many observations; the first bucket is empty and still has its row."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    guess = F.when(F.col("p_partkey") % 3 == 0, "other").otherwise(F.col("p_brand"))
    g = c.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("n", F.col("p_brand").alias("truth"), guess.alias("guess"))
    return rounded(stats.bucket_metrics(g, "n", "truth", "guess", {"none": (0, 1), "few": (1, 25), "some": (25, 35), "many": (35, None)}))


@query("WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT n_name AS clase, count(*) AS objects, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(stddev_samp(n), 6) AS std, min(n) AS min, max(n) AS max FROM c JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL")
def class_observations(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    x = c.join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("clase"), "n")
    return rounded(stats.class_observations(x, "clase", "n"))


@query("SELECT o_orderkey, c_custkey::VARCHAR AS id_objeto, c_mktsegment AS clase FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 5 <> 0 AND c_custkey % 4 <> 0")
def classes_by_key(spark, sf_dir):
    """Keys hold ids in words; keys without an id and ids without a class are left out."""
    key = F.when(F.col("o_orderkey") % 5 == 0, F.lit("no id")).otherwise(F.concat(F.lit("table of object "), F.col("o_custkey").cast("string"), F.lit(" (epochs)")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"))
    classes = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("string").alias("id_objeto"), F.col("c_mktsegment").alias("clase"))
    return registry.classed(orders, "key", r"object\s+(\d+)", classes).select("o_orderkey", "id_objeto", "clase")
