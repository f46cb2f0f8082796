"""Registered queries for significance, shapes of curves and experiments with classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from faintlight.functions import features, shapes
from faintlight.operators import detect, experiments, models, stats
from faintlight.plans.queries import EVENTS, ORACLE_SQL, QUERIES, _part_features, lc_events, lc_lineitem, query, rounded

#: Groups of the canonical features for the ablation queries.
GROUPS = {"spread": features.CORE[:6], "form": features.CORE[6:10], "order": features.CORE[10:]}


@query(f"SELECT *, round(exp(-h / 2), 6) AS p FROM ({ORACLE_SQL['kruskal_h']})")
def kruskal_p(spark, sf_dir):
    return rounded(QUERIES["kruskal_h"](spark, sf_dir).withColumn("p", stats.chi2_tail(F.col("h"), F.col("n_groups") - 1)))


@query(f"SELECT *, round(exp(-chi2 / 2), 6) AS p FROM ({ORACLE_SQL['chi2_gof']})")
def chi2_p(spark, sf_dir):
    return rounded(QUERIES["chi2_gof"](spark, sf_dir).withColumn("p", stats.chi2_tail(F.col("chi2"), F.col("df"))))


@query(f"""WITH k AS ({ORACLE_SQL['ks_two_sample']}), l AS (SELECT *, ks * sqrt(n_a::DOUBLE * n_b / (n_a + n_b)) AS l FROM k)
SELECT ks, n_a, n_b, round(CASE WHEN l < 0.2 THEN 1 ELSE least(1.0::DOUBLE, (SELECT 2 * sum((CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * i * i * l * l)) FROM range(1, 101) r(i))) END, 6) AS p FROM l""")
def ks_p(spark, sf_dir):
    return rounded(QUERIES["ks_two_sample"](spark, sf_dir).withColumn("p", stats.kolmogorov_tail(F.col("ks"), F.col("n_a"), F.col("n_b"))))


@query(f"""WITH {EVENTS}, u AS (SELECT id_objeto, banda, t, arg_min(m, src_idx) AS m FROM p GROUP BY ALL),
x AS (SELECT id_objeto, banda, (t - min(t) OVER c) / nullif(max(t) OVER c - min(t) OVER c, 0) AS x, (m - avg(m) OVER c) / nullif(stddev_pop(m) OVER c, 0) AS z, count(*) OVER c AS n FROM u WINDOW c AS (PARTITION BY id_objeto, banda)),
s AS (SELECT *, lead(x) OVER o AS x2, lead(z) OVER o AS z2 FROM x WHERE n >= 10 WINDOW o AS (PARTITION BY id_objeto, banda ORDER BY x))
SELECT id_objeto, banda, i::INTEGER AS bin, round(z + (i / 63.0::DOUBLE - x) / (x2 - x) * (z2 - z), 6) + 0.0 AS value FROM s JOIN range(64) g(i) ON i >= ceil(x * 63) AND (i < ceil(x2 * 63) OR (x2 = 1 AND i = 63))""")
def resampled_curves(spark, sf_dir):
    return rounded(shapes.resampled(lc_events(spark, sf_dir))).withColumn("value", F.col("value") + 0.0)


@query(f"""WITH {EVENTS}, a AS (SELECT *, m - avg(m) OVER c AS y, (t - min(t) OVER c) / 7.0::DOUBLE AS turns FROM p WINDOW c AS (PARTITION BY id_objeto, banda)),
f AS (SELECT *, 2 * pi() * (turns - floor(turns)) AS u FROM a)
SELECT id_objeto, banda, count(*) AS n, round(sum(y * y), 4) AS yty, round(sum(cos(u)), 4) + 0.0 AS c1, round(sum(sin(u)), 4) + 0.0 AS s1, round(sum(y * cos(u)), 4) + 0.0 AS yc1, round(sum(y * sin(u)), 4) + 0.0 AS ys1 FROM f GROUP BY ALL""")
def fourier_moments(spark, sf_dir):
    found = features.fourier_moments(lc_events(spark, sf_dir), F.lit(7.0))
    sums = {"c1": F.col("xtx")[1], "s1": F.col("xtx")[2], "yc1": F.col("xty")[1], "ys1": F.col("xty")[2]}
    found = found.select("id_objeto", "banda", "n", F.round("yty", 4).alias("yty"), *((F.round(v, 4) + 0.0).alias(k) for k, v in sums.items()))
    return found


@query()
def self_detect(spark, sf_dir):
    objects = features.core_features(lc_lineitem(spark, sf_dir), ["id_objeto"]).withColumn("id", F.col("id_objeto").cast("long"))
    return detect.detect_self(objects, features.CORE)


@query()
def feature_ablation(spark, sf_dir):
    train, test = (x.select("id", "clase", *features.CORE) for x in _part_features(spark, sf_dir))
    return experiments.compared(train, test, experiments.leaving_out(GROUPS), models.logistic_control)
