"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faintlight import curves
from faintlight.functions import features
from faintlight.operators import crossmatch, detect, matching, models, neighbours, order, quality, stats
from faintlight.operators.tables import set_checkpoints, small, tidied

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in frame.dtypes))


# ---- light curves made of the test tables


def lc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    points = e.select(F.col("user_id").alias("id_objeto"), F.col("event_type").alias("banda"), curves.days(F.col("ts")).alias("t"), F.col("value").alias("m"), F.col("event_id").alias("src_idx"))
    return curves.dealt(curves.canonical(points), e.count())


def _lineitem(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    band = F.when(F.col("l_returnflag") == "R", "r").when(F.col("l_returnflag") == "N", "g").otherwise("i")
    return table(spark, sf_dir, "lineitem").select(
        F.col(key).alias("id_objeto"), band.alias("banda"), curves.days(F.col("l_shipdate")).alias("t"), F.col("l_extendedprice").alias("m"), F.col("l_quantity").alias("e"), F.col(key).alias("k")
    )


def lc_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    classes = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("k"), F.col("n_regionkey").alias("clase"))
    points = _lineitem(spark, sf_dir, "l_suppkey")
    return curves.dealt(curves.canonical(points.join(small(classes), "k", "left")), points.count())


def lc_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("clase"))
    points = _lineitem(spark, sf_dir, "l_partkey")
    return curves.dealt(curves.canonical(points.join(small(classes), "k", "left")), points.count())


EVENTS = "p AS (SELECT user_id::VARCHAR AS id_objeto, event_type AS banda, epoch_us(ts) / 86400000000.0::DOUBLE + 40587.0 AS t, value AS m, NULL::DOUBLE AS e, event_id AS src_idx FROM events)"
_BAND = "CASE l_returnflag WHEN 'R' THEN 'r' WHEN 'N' THEN 'g' ELSE 'i' END AS banda, epoch_us(l_shipdate) / 86400000000.0::DOUBLE + 40587.0 AS t, l_extendedprice AS m, l_quantity AS e"
LINEITEM = f"p AS (SELECT l_suppkey::VARCHAR AS id_objeto, {_BAND}, n_regionkey::VARCHAR AS clase FROM lineitem LEFT JOIN (supplier JOIN nation ON s_nationkey = n_nationkey) ON s_suppkey = l_suppkey)"
PART = f"p AS (SELECT l_partkey::VARCHAR AS id_objeto, {_BAND}, p_brand AS clase FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"
MAIN = """b AS (SELECT id_objeto, banda, row_number() OVER (PARTITION BY id_objeto ORDER BY CASE banda WHEN 'r' THEN 0 WHEN 'g' THEN 1 WHEN 'i' THEN 2 ELSE 3 END, {first} banda) AS r
    FROM (SELECT id_objeto, banda{agg} FROM p GROUP BY id_objeto, banda)),
mb AS (SELECT p.* FROM p JOIN b ON b.r = 1 AND b.id_objeto = p.id_objeto AND b.banda = p.banda)"""


def core_sql(points: str, source: str, keys: str, passed: str = "") -> str:
    both = f"{keys}{', ' + passed if passed else ''}"
    out = "".join(f"min({c.strip()}) AS {c.strip()}, " for c in passed.split(",") if c.strip())
    return f"""WITH {points},
s AS (SELECT {both}, t, m, avg(m) OVER w AS mu, quantile_cont(m, 0.5) OVER w AS med, stddev_pop(m) OVER w AS sd,
    m - lag(m) OVER o AS dm, t - lag(t) OVER o AS dt FROM {source} WINDOW w AS (PARTITION BY {keys}), o AS (PARTITION BY {keys} ORDER BY t, m, e NULLS FIRST))
SELECT {keys}, {out}count(*) AS n_points, round(max(med), 6) AS median, round(stddev_pop(m), 6) AS standard_deviation,
    round(quantile_cont(abs(m - med), 0.5), 6) AS median_absolute_deviation, round((max(m) - min(m)) / 2, 6) AS amplitude,
    round(CASE WHEN abs(avg(m)) > 1e-12 THEN (max(m) - min(m)) / 2 / abs(avg(m)) ELSE 0 END, 6) AS percent_amplitude,
    round(quantile_cont(m, 0.875) - quantile_cont(m, 0.125), 6) AS inter_percentile_range_25,
    round(CASE WHEN max(sd) > 1e-12 THEN avg(power((m - mu) / sd, 3)) ELSE 0 END, 6) AS skew,
    round(CASE WHEN max(sd) > 1e-12 THEN avg(power((m - mu) / sd, 4)) - 3 ELSE 0 END, 6) AS kurtosis,
    round(CASE WHEN max(sd) > 1e-12 THEN avg(abs(m - mu) / sd) ELSE 0 END, 6) AS "stetson_K",
    round(CASE WHEN max(sd) > 1e-12 THEN sum(power((m - mu) / sd, 2)) / greatest(count(*) - 1, 1) ELSE 0 END, 6) AS chi2,
    round(CASE WHEN max(sd) > 1e-12 AND count(*) > 1 THEN sum(dm * dm) / ((count(*) - 1) * power(max(sd), 2)) ELSE 0 END, 6) AS eta,
    round(coalesce(max(abs(dm / dt)) FILTER (WHERE dt > 0), 0), 6) AS maximum_slope FROM s GROUP BY {keys}"""


@query(core_sql(EVENTS + ", " + MAIN.format(first="first,", agg=", min(src_idx) AS first"), "mb", "id_objeto, banda"))
def core12_main_band(spark, sf_dir):
    return rounded(features.core_features(curves.main_band(lc_events(spark, sf_dir))))


@query(core_sql(EVENTS, "p", "id_objeto, banda"))
def core12_all_bands(spark, sf_dir):
    return rounded(features.core_features(lc_events(spark, sf_dir)))


@query(core_sql(LINEITEM + ", " + MAIN.format(first="", agg=""), "mb", "id_objeto, banda", "clase"))
def core12_lineitem(spark, sf_dir):
    return rounded(features.core_features(curves.main_band(lc_lineitem(spark, sf_dir)), passed=("clase",)))


@query("SELECT o_orderpriority AS id_objeto, o_orderstatus AS banda, count(*) AS n_points, count(*) FILTER (WHERE o_totalprice > 1000) AS n_finite, count(*) FILTER (WHERE o_totalprice > 1000) >= 2 AS valid FROM orders GROUP BY ALL")
def validation_drop_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).otherwise(F.lit(float("nan")))
    return curves.validity(curves.canonical(o.select(F.col("o_orderpriority").alias("id_objeto"), F.col("o_orderstatus").alias("banda"), curves.days(F.col("o_orderdate")).alias("t"), m.alias("m"))))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN NULL ELSE p_size::DOUBLE END AS value FROM part")
def null_token_coercion(spark, sf_dir):
    text = F.when(F.col("p_size") % 7 == 0, "-999").when(F.col("p_size") % 5 == 0, "no number").otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", curves.coerced(text).alias("value"))


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_totalprice END AS v, o_orderkey % 4 <> 0 AS tr FROM orders)
SELECT o_orderkey, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM x WHERE tr), 0), 6) AS value FROM x""")
def impute_train_median(spark, sf_dir):
    v = F.when(F.col("o_orderkey") % 10 == 3, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", v.alias("value"))
    return rounded(stats.imputed(rows, ["value"], F.col("o_orderkey") % 4 != 0))


@query(f"WITH {LINEITEM}, c AS (SELECT id_objeto, banda, count(*) AS n FROM p GROUP BY ALL) SELECT id_objeto, banda, n FROM c QUALIFY row_number() OVER (PARTITION BY id_objeto ORDER BY n DESC, CASE banda WHEN 'g' THEN 0 WHEN 'r' THEN 1 ELSE 2 END) = 1")
def band_longest(spark, sf_dir):
    return curves.longest_band(lc_lineitem(spark, sf_dir))


@query(f"WITH {LINEITEM}, b AS (SELECT id_objeto, banda, avg(m) AS mean, stddev_pop(m) AS std FROM p GROUP BY ALL) SELECT id_objeto, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std, count(*) AS n_bands FROM b GROUP BY ALL")
def band_mean(spark, sf_dir):
    b = lc_lineitem(spark, sf_dir).groupBy("id_objeto", "banda").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))
    return rounded(b.groupBy("id_objeto").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.count("*").alias("n_bands")))


@query("""SELECT l_orderkey::VARCHAR AS id_objeto, banda, count(*) AS n, round(sum(m), 6) AS total FROM (
SELECT l_orderkey, 'g' AS banda, l_quantity AS m FROM lineitem WHERE l_returnflag <> 'A' UNION ALL SELECT l_orderkey, 'bp', l_tax FROM lineitem WHERE l_returnflag <> 'A' AND l_linestatus <> 'F') GROUP BY ALL""")
def unpivot_wide_bands(spark, sf_dir):
    from faintlight.sources.registry import wide

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", curves.days(F.col("l_shipdate")).alias("t"), "l_quantity", "l_tax", (F.col("l_linestatus") == "F").alias("bad"), (F.col("l_returnflag") == "A").alias("reject"))
    p = wide(rows, "l_orderkey", {"g": ("t", "l_quantity", None), "bp": ("t", "l_tax", "bad")}, reject="reject")
    return rounded(p.groupBy("id_objeto", "banda").agg(F.count("*").alias("n"), F.sum("m").alias("total")))


# ---- order, ties, change


@query(f"""WITH {EVENTS}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY id_objeto, banda ORDER BY src_idx) AS d FROM p)
SELECT id_objeto, banda, count(*) AS n, count(*) FILTER (WHERE d < 0) AS inversions, count(*) FILTER (WHERE d = 0) AS ties,
round(coalesce(count(*) FILTER (WHERE d < 0) / nullif(count(*) - 1, 0), 0)::DOUBLE, 6) AS inversion_fraction, count(*) FILTER (WHERE d < 0) = 0 AS is_sorted FROM d GROUP BY ALL""")
def time_order_diagnostic(spark, sf_dir):
    return rounded(quality.time_order(lc_events(spark, sf_dir)))


@query(f"""WITH {LINEITEM}, l AS (SELECT *, max(t) OVER (PARTITION BY id_objeto, banda) AS last FROM p)
SELECT id_objeto, banda, t, count(*) AS size, min(m) = max(m) AS constant, max(last) = t AS at_end FROM l GROUP BY id_objeto, banda, t HAVING count(*) >= 2""")
def tie_groups(spark, sf_dir):
    return quality.tie_groups(lc_lineitem(spark, sf_dir))


@query(f"""WITH {PART}, l AS (SELECT *, t = max(t) OVER (PARTITION BY id_objeto, banda) AS tail FROM p),
g AS (SELECT id_objeto, banda, count(*) AS n, CASE WHEN min(m) FILTER (WHERE tail) = max(m) FILTER (WHERE tail) THEN count(*) FILTER (WHERE tail) - 1 ELSE 0 END AS n_padding FROM l GROUP BY ALL)
SELECT *, n - n_padding AS n_effective FROM g""")
def tail_padding(spark, sf_dir):
    return quality.tail_padding(lc_part(spark, sf_dir))


@query(f"""WITH {EVENTS}, z AS (SELECT id_objeto, banda, t, m, e, (m - avg(m) OVER w) / nullif(stddev_pop(m) OVER w, 0) AS z FROM p WINDOW w AS (PARTITION BY id_objeto, banda)),
c AS (SELECT *, sum(coalesce(z, 0)) OVER (PARTITION BY id_objeto, banda ORDER BY t, m ROWS UNBOUNDED PRECEDING) AS c FROM z)
SELECT id_objeto, banda, round(max(c) - min(c), 6) AS cusum_range FROM c GROUP BY ALL""")
def cusum_range(spark, sf_dir):
    return rounded(features.cusum_range(lc_events(spark, sf_dir)))


@query(f"""WITH {EVENTS}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY id_objeto, banda ORDER BY t, m) AS d FROM p)
SELECT id_objeto, banda, round(avg(d), 6) AS cadence_mean, round(quantile_cont(d, 0.5), 6) AS cadence_median, round(stddev_pop(d), 6) AS cadence_std, round(max(t) - min(t), 6) AS baseline FROM d GROUP BY ALL""")
def cadence_stats(spark, sf_dir):
    return rounded(features.cadence_stats(lc_events(spark, sf_dir)))


@query(f"""WITH {EVENTS}, d AS (SELECT *, m - lag(m) OVER (PARTITION BY id_objeto, banda ORDER BY t, m) AS d FROM p)
SELECT id_objeto, banda, round(avg(abs(d)), 6) AS mean_abs_change, round(stddev_pop(d), 6) AS std_change, round(max(abs(d)), 6) AS max_abs_change FROM d GROUP BY ALL""")
def change_stats(spark, sf_dir):
    return rounded(features.change_stats(lc_events(spark, sf_dir)))


@query(f"""WITH {LINEITEM}, s AS (SELECT *, quantile_cont(m, 0.5) OVER (PARTITION BY id_objeto, banda) AS med FROM p)
SELECT id_objeto, banda, count(m) AS n, round(avg(m), 6) AS mean, round(max(med), 6) AS median, round(stddev_pop(m), 6) AS std, round(quantile_cont(m, 0.1), 6) AS p10, round(quantile_cont(m, 0.25), 6) AS p25,
round(quantile_cont(m, 0.75), 6) AS p75, round(quantile_cont(m, 0.9), 6) AS p90, round(quantile_cont(m, 0.75) - quantile_cont(m, 0.25), 6) AS iqr, round(quantile_cont(m, 0.9) - quantile_cont(m, 0.1), 6) AS range_10_90,
round(max(m) - min(m), 6) AS amplitude, round(quantile_cont(abs(m - med), 0.5), 6) AS mad, round(CASE WHEN stddev_pop(m) > 1e-12 THEN avg(power(m - med, 3)) / power(stddev_pop(m), 3) ELSE 0 END, 6) AS skew_median,
round(avg(e), 6) AS error_mean, round(quantile_cont(e, 0.5), 6) AS error_median, round(stddev_pop(e), 6) AS error_std, round(coalesce(CASE WHEN count(m) >= 3 THEN regr_slope(m, t) END, 0), 6) AS slope FROM s GROUP BY id_objeto, banda""")
def feature_pack_11(spark, sf_dir):
    return rounded(features.pack_eleven(lc_lineitem(spark, sf_dir)))


@query(f"""WITH {LINEITEM}, w AS (SELECT *, 1 / power(greatest(abs(e), 1e-6), 2) AS w FROM p), x AS (SELECT *, sum(w * m) OVER k / sum(w) OVER k AS wm FROM w WINDOW k AS (PARTITION BY id_objeto, banda))
SELECT id_objeto, banda, round(max(wm), 4) AS weighted_mean, round(avg(power(m - wm, 2) * w), 4) AS weighted_chi2, round(stddev_samp(m), 4) AS std_sample,
round(quantile_cont(m, 0.95) - quantile_cont(m, 0.05), 4) AS range_5_95, round(quantile_cont(m, 0.8) - quantile_cont(m, 0.2), 4) AS range_20_80 FROM x GROUP BY id_objeto, banda""")
def feature_pack_17(spark, sf_dir):
    return rounded(features.pack_weighted(lc_lineitem(spark, sf_dir)), 4)


@query()
def fourier_features(spark, sf_dir):
    return features.fourier_features(lc_events(spark, sf_dir), F.lit(7.0))


@query(f"WITH {EVENTS} SELECT id_objeto, banda, round(regr_slope(m, t), 6) AS slope FROM p GROUP BY ALL")
def ols_slope_per_curve(spark, sf_dir):
    return rounded(lc_events(spark, sf_dir).groupBy("id_objeto", "banda").agg(F.regr_slope("m", "t").alias("slope")))


# ---- statistics and metrics

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = "x AS (" + " UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, '{c}' AS variable, {c} AS value FROM lineitem" for c in _NUMBERS) + ")"


def _numbers(spark, sf_dir):
    return stats.long_form(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], _NUMBERS)


@query(f"""WITH {_LONG} SELECT variable, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.25), 6) AS p25,
round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM x GROUP BY variable""")
def feature_describe(spark, sf_dir):
    return rounded(stats.describe(_numbers(spark, sf_dir), ["variable"]))


@query(f"""WITH {_LONG}, d AS (SELECT variable, max(value) - min(value) AS r, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS i FROM x GROUP BY variable)
SELECT variable, round(r / i, 6) AS tail_ratio, r / i > 2 AS heavy FROM d WHERE i > 0""")
def heavy_tails(spark, sf_dir):
    return rounded(stats.heavy_tails(stats.describe(_numbers(spark, sf_dir), ["variable"]), 2.0).select("variable", "tail_ratio", "heavy"))


_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def correlation_pairs(spark, sf_dir):
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in _PAIRS))
    return rounded(table(spark, sf_dir, "lineitem").agg(pairs.alias("x")).select(F.explode("x").alias("x")).select("x.*"))


_RANKS = "r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM x)"


@query(f"""WITH x AS (SELECT l_returnflag AS g, l_quantity AS v FROM lineitem), {_RANKS}, n AS (SELECT g, sum(r) AS s, count(*) AS n FROM r GROUP BY g),
t AS (SELECT sum(power(c, 3) - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY v)), a AS (SELECT sum(s * s / n) AS s, sum(n)::DOUBLE AS n, count(*) AS k FROM n)
SELECT round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (power(n, 3) - n)), 6) AS h, k AS n_groups, n::BIGINT AS n FROM a, t""")
def kruskal_h(spark, sf_dir):
    return rounded(stats.kruskal_wallis(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity"))


@query("""WITH c AS (SELECT l_quantity AS v, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY v),
d AS (SELECT *, abs(sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER ()) AS d FROM c) SELECT round(max(d), 6) AS ks, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b FROM d""")
def ks_two_sample(spark, sf_dir):
    return rounded(stats.kolmogorov_smirnov(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "A", "R"))


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"), "quality", "toxic")


_AUC = "WITH x AS (SELECT n_chars::DOUBLE AS v, toxic AS y FROM documents JOIN labels USING (doc_id)), " + _RANKS + ", a AS (SELECT sum(r) FILTER (WHERE y = 1) AS s, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q FROM r)"


@query(_AUC + " SELECT round((s - p * (p + 1) / 2.0::DOUBLE) / (p * q), 6) AS auc, p AS n_pos, q AS n_neg FROM a")
def roc_auc(spark, sf_dir):
    return rounded(stats.roc_auc(_scored(spark, sf_dir), "score", "toxic"))


@query(_AUC + " SELECT round(greatest((s - p * (p + 1) / 2.0::DOUBLE) / (p * q), 1 - (s - p * (p + 1) / 2.0::DOUBLE) / (p * q)), 6) AS auc FROM a")
def symmetric_auc(spark, sf_dir):
    return rounded(stats.roc_auc(_scored(spark, sf_dir), "score", "toxic").select(F.greatest("auc", 1 - F.col("auc")).alias("auc")))


@query("""WITH x AS (SELECT n_chars::DOUBLE AS s, toxic AS y FROM documents JOIN labels USING (doc_id)), r(fpr) AS (VALUES (0.01::DOUBLE), (0.02), (0.05), (0.1), (0.2)),
q AS (SELECT fpr, quantile_cont(s, [0.99, 0.98, 0.95, 0.9, 0.8])[CASE fpr WHEN 0.01 THEN 1 WHEN 0.02 THEN 2 WHEN 0.05 THEN 3 WHEN 0.1 THEN 4 ELSE 5 END] AS threshold FROM r, x WHERE y = 0 GROUP BY fpr)
SELECT fpr, round(threshold, 6) AS threshold, round(count(*) FILTER (WHERE y = 0 AND s >= threshold) / count(*) FILTER (WHERE y = 0), 6) AS fpr_reached,
round(count(*) FILTER (WHERE y = 1 AND s >= threshold) / count(*) FILTER (WHERE y = 1), 6) AS recall FROM q, x GROUP BY fpr, threshold""")
def recall_at_fpr(spark, sf_dir):
    return rounded(stats.recall_at_fpr(_scored(spark, sf_dir), "score", "toxic"))


@query("""WITH x AS (SELECT quality::VARCHAR AS t, toxic::VARCHAR AS g FROM labels), k AS (SELECT DISTINCT t AS class FROM x UNION SELECT DISTINCT g FROM x),
m AS (SELECT class, count(*) FILTER (WHERE t = class) AS support, count(*) FILTER (WHERE g = class) AS ng, count(*) FILTER (WHERE t = class AND g = class) AS h FROM k, x GROUP BY class),
r AS (SELECT class, support, coalesce(h / nullif(ng, 0), 0) AS p, coalesce(h / nullif(support, 0), 0) AS r FROM m)
SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM r""")
def precision_recall_f1(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("t"), F.col("toxic").cast("string").alias("g"))
    return rounded(stats.class_metrics(rows, "t", "g"))


@query("SELECT quality, count(*) FILTER (WHERE toxic = 0) AS predicted_0, count(*) FILTER (WHERE toxic = 1) AS predicted_1 FROM labels GROUP BY quality")
def confusion_matrix(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality").pivot("toxic", [0, 1]).count().na.fill(0).select("quality", F.col("0").alias("predicted_0"), F.col("1").alias("predicted_1"))


@query("SELECT round(avg(r), 6) AS balanced_accuracy, round(sum(n * r) / sum(n), 6) AS accuracy FROM (SELECT count(*) AS n, avg((quality = toxic)::INT) AS r FROM labels GROUP BY quality)")
def balanced_accuracy(spark, sf_dir):
    r = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.avg((F.col("quality") == F.col("toxic")).cast("int")).alias("r"))
    return rounded(r.agg(F.avg("r").alias("balanced_accuracy"), (F.sum(F.col("n") * F.col("r")) / F.sum("n")).alias("accuracy")))


@query("SELECT lang AS clase, count(*) AS n, count(*) FILTER (WHERE n_chars >= 2000) AS detected, round(avg((n_chars >= 2000)::INT), 6) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def recall_by_class(spark, sf_dir):
    hit = F.col("score") >= 2000
    return rounded(_scored(spark, sf_dir).groupBy(F.col("lang").alias("clase")).agg(F.count("*").alias("n"), F.count_if(hit).alias("detected"), F.avg(hit.cast("int")).alias("recall")))


@query("""WITH o AS (SELECT l_returnflag AS k, count(*)::DOUBLE AS o FROM lineitem WHERE l_linestatus = 'F' GROUP BY k), e AS (SELECT l_returnflag AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY k),
j AS (SELECT o, n / sum(n) OVER () * sum(o) OVER () AS e FROM e JOIN o USING (k)) SELECT round(sum(power(o - e, 2) / e), 6) AS chi2, count(*) - 1 AS df FROM j""")
def chi2_gof(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = li.groupBy("l_returnflag").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("l_linestatus") == "F").cast("double").alias("o"))
    whole = Window.partitionBy()
    c = c.withColumn("e", F.col("n") / F.sum("n").over(whole) * F.sum("o").over(whole))
    return rounded(c.agg(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("chi2"), (F.count("*") - 1).alias("df")))


@query("""SELECT round((quantile_cont(v, 0.5) FILTER (WHERE g = 'A') - quantile_cont(v, 0.5) FILTER (WHERE g = 'R')) / greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 1e-12), 6) AS gap
FROM (SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem WHERE l_returnflag IN ('A', 'R'))""")
def median_gap_iqr(spark, sf_dir):
    return rounded(stats.median_gap(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "A", "R"))


@query("SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders WHERE o_orderkey % 5 <> 0)) / (SELECT stddev_pop(o_totalprice) FROM orders WHERE o_orderkey % 5 <> 0), 6) AS o_totalprice FROM orders")
def standard_scale(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    fit = o.where(F.col("o_orderkey") % 5 != 0).agg(F.avg("o_totalprice").alias("mu"), F.stddev_pop("o_totalprice").alias("sd"))
    return rounded(o.join(F.broadcast(fit)).select("o_orderkey", ((F.col("o_totalprice") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("o_totalprice")))


@query("SELECT o_orderkey, round((o_totalprice - (SELECT quantile_cont(o_totalprice, 0.5) FROM orders)) / (SELECT quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) FROM orders), 6) AS o_totalprice FROM orders")
def robust_scale(spark, sf_dir):
    return rounded(stats.robust_scaled(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]))


# ---- ranks, samples, sets


@query("WITH r AS (SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC) AS rank, count(*) OVER () AS n FROM orders) SELECT o_orderkey, rank FROM r WHERE rank <= greatest((n * 0.02)::DOUBLE // 1, 1)")
def rank_top_fraction(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = max(int(o.count() * 0.02), 1)
    return stats.ranked(o.select("o_orderkey", "o_totalprice"), "o_totalprice", descending=True).where(F.col("rank") <= n).select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, round((rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY lang) * 100, 6) AS percentile FROM documents")
def pct_rank_in_class(spark, sf_dir):
    return rounded(stats.percentile_ranked(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars", "percentile", ["lang"]).select("doc_id", "percentile"))


@query("SELECT event_id, round((rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100, 6) AS percentile FROM events")
def pct_rank_global(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return rounded(stats.percentile_ranked(e, "value", "percentile").select("event_id", "percentile"))


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR || '42'), p_partkey) <= round(count(*) OVER (PARTITION BY p_brand) * 0.8) AS is_train FROM part")
def stratified_split(spark, sf_dir):
    return stats.stratified(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand")


@query("WITH g AS (SELECT user_id, ((row_number() OVER (ORDER BY md5(user_id::VARCHAR || '42'), user_id) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT user_id FROM events)) SELECT user_id, event_id, fold FROM events JOIN g USING (user_id)")
def group_kfold(spark, sf_dir):
    return stats.group_folds(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id")


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus, least(greatest(floor(o_totalprice / 25000), 0), 19) AS cell FROM orders), c AS (SELECT cell, o_orderstatus, count(*) AS n FROM b GROUP BY ALL),
m AS (SELECT cell, min(n) AS least FROM c GROUP BY cell HAVING count(*) = (SELECT count(DISTINCT o_orderstatus) FROM orders))
SELECT o_orderkey, o_orderstatus, cell FROM b JOIN m USING (cell) QUALIFY row_number() OVER (PARTITION BY cell, o_orderstatus ORDER BY md5(o_orderkey::VARCHAR || '42'), o_orderkey) <= least""")
def bin_balance(spark, sf_dir):
    b = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.least(F.greatest(F.floor(F.col("o_totalprice") / 25000), F.lit(0)), F.lit(19)).cast("double").alias("cell"))
    k = b.select("o_orderstatus").distinct().count()
    least = b.groupBy("cell", "o_orderstatus").agg(F.count("*").alias("n")).groupBy("cell").agg(F.min("n").alias("least"), F.count("*").alias("k")).where(F.col("k") == k)
    order = Window.partitionBy("cell", "o_orderstatus").orderBy(stats.hash_order(F.col("o_orderkey"), "42"), "o_orderkey")
    return b.join(least, "cell").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= F.col("least")).select("o_orderkey", "o_orderstatus", "cell")


_SETS = "a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'N' AND l_discount > 0.05)"


def _sets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("id")).distinct(), li.where("l_returnflag = 'N' AND l_discount > 0.05").select(F.col("l_partkey").alias("id")).distinct()


@query(f"WITH {_SETS} SELECT id FROM a INTERSECT SELECT id FROM b")
def semi_overlap(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.intersect(b)


@query(f"WITH {_SETS} SELECT id FROM a EXCEPT SELECT id FROM b")
def set_except(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.subtract(b)


@query(f"WITH {_SETS} SELECT id FROM a UNION SELECT id FROM b")
def set_union(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.union(b).distinct()


@query(f"WITH {_SETS} SELECT round((SELECT count(*) FROM (SELECT id FROM a INTERSECT SELECT id FROM b))::DOUBLE / (SELECT count(*) FROM (SELECT id FROM a UNION SELECT id FROM b)), 6) AS jaccard")
def jaccard_sets(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "id", "full")
    return rounded(both.agg((F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count("*")).alias("jaccard")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 <> 0) AND o_totalprice NOT IN (SELECT o_totalprice FROM orders WHERE o_orderkey % 5 <> 0)")
def anti_leak_clean(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return quality.without_leaks(o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 5 = 0"), ["o_custkey", "o_totalprice"]).select("o_orderkey", "o_custkey")


@query("SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id")
def ordered_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first")).orderBy("first")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def dedup_first(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").withColumn("__r", first).where("__r = 1").select("user_id", "event_id", "event_type")


# ---- group summaries


@query("SELECT lang AS clase, count(*) AS n, round(avg(n_chars), 6) AS mean, count(*) FILTER (WHERE n_chars > 3000) AS candidates FROM documents GROUP BY lang")
def class_summary(spark, sf_dir):
    return rounded(table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("clase")).agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"), F.count_if(F.col("n_chars") > 3000).alias("candidates")))


@query("""WITH g AS (SELECT lang AS clase, count(*) AS n, count(*) FILTER (WHERE n_chars > 3000) AS candidates FROM documents GROUP BY lang), s AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER () AS pp, 100.0::DOUBLE * candidates / nullif(sum(candidates) OVER (), 0) AS pc FROM g)
SELECT clase, n, candidates, round(pp, 6) AS percent_population, round(coalesce(pc, 0), 6) AS percent_candidates, round(coalesce(pc / pp, 0), 6) AS ratio FROM s""")
def over_representation(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("clase")).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 3000).alias("candidates"))
    whole = Window.partitionBy()
    share = lambda c: F.coalesce(F.try_divide(100.0 * F.col(c), F.sum(c).over(whole)), F.lit(0.0))
    g = g.withColumn("percent_population", share("n")).withColumn("percent_candidates", share("candidates"))
    return rounded(g.withColumn("ratio", F.coalesce(F.try_divide("percent_candidates", "percent_population"), F.lit(0.0))))


_BUCKET = "CASE WHEN n < 10 THEN '<10' WHEN n < 20 THEN '10-19' WHEN n < 30 THEN '20-29' ELSE '>=30' END"


@query(f"WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey), b AS (SELECT {_BUCKET} AS bucket, p_brand AS clase, n FROM c JOIN part ON p_partkey = l_partkey) SELECT bucket, clase, count(*) AS objects, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median FROM b GROUP BY ALL")
def obs_bucket_metrics(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") < 10, "<10").when(F.col("n") < 20, "10-19").when(F.col("n") < 30, "20-29").otherwise(">=30")
    b = c.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(bucket.alias("bucket"), F.col("p_brand").alias("clase"), "n")
    return rounded(b.groupBy("bucket", "clase").agg(F.count("*").alias("objects"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median")))


@query(f"""WITH {_LONG} SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'flag' ELSE 'status' END AS nivel, coalesce(l_returnflag, l_linestatus) AS clase, variable, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM x GROUP BY GROUPING SETS ((l_returnflag, variable), (l_linestatus, variable))""")
def describe_two_levels(spark, sf_dir):
    x = _numbers(spark, sf_dir)
    levels = F.array(*(F.struct(F.lit(name).alias("nivel"), F.col(c).alias("clase")) for name, c in (("flag", "l_returnflag"), ("status", "l_linestatus"))))
    x, keys = x.select(F.explode(levels).alias("x"), "variable", "value").select("x.*", "variable", "value"), ["nivel", "clase", "variable"]
    g = x.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = order.quantiles(x, "value", (0.25, 0.5, 0.75), keys).select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col("q")[i].alias(c) for i, c in enumerate(("q25", "median", "q75"))))
    g = g.join(q, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), "left")
    return rounded(g.select(*keys, "n", "mean", "median", "std", "min", "max", "q25", "q75"))


@query(f"WITH {_LONG} SELECT l_returnflag AS clase, variable, round(CASE WHEN abs(avg(value)) > 1e-12 THEN stddev_samp(value) / abs(avg(value)) END, 6) AS cv FROM x GROUP BY ALL HAVING count(*) >= 2")
def coefficient_of_variation(spark, sf_dir):
    mean = F.abs(F.avg("value"))
    g = _numbers(spark, sf_dir).groupBy(F.col("l_returnflag").alias("clase"), "variable").agg(F.count("*").alias("n"), F.when(mean > 1e-12, F.stddev_samp("value") / mean).alias("cv"))
    return rounded(g.where("n >= 2").drop("n"))


@query("SELECT r_name AS clase, count(s_suppkey) AS n, round(count(s_suppkey)::DOUBLE / sum(count(s_suppkey)) OVER (), 6) AS share FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name")
def class_share(spark, sf_dir):
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    j = r.join(n, r["r_regionkey"] == n["n_regionkey"], "left").join(s, s["s_nationkey"] == n["n_nationkey"], "left")
    g = j.groupBy(F.col("r_name").alias("clase")).agg(F.count("s_suppkey").alias("n"))
    return rounded(g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("WITH x AS (SELECT doc_id, n_chars, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT (floor(((i + 1) * 10 - 1)::DOUBLE / n))::INT AS decile, count(*) AS n_rows, round(avg(n_chars), 6) AS mean, round(avg((lang = 'en')::INT), 6) AS share_en FROM x GROUP BY decile")
def deciles_position(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    x = stats.ranked(d, "doc_id", "i").join(F.broadcast(d.agg(F.count("*").alias("n"))))
    x = x.withColumn("decile", F.floor((F.col("i") * 10 - 1) / F.col("n")).cast("int"))
    return rounded(x.groupBy("decile").agg(F.count("*").alias("n_rows"), F.avg("n_chars").alias("mean"), F.avg((F.col("lang") == "en").cast("int")).alias("share_en")))


# ---- vectors


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


_KNN = "d AS (SELECT q.vec_id AS id, c.vec_id AS neighbour, list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS distance FROM embeddings q JOIN embeddings c ON {on}), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d QUALIFY rank <= {k})"


@query(f"WITH {_KNN.format(on='q.vec_id % 5 = 0 AND c.vec_id % 5 <> 0', k=20)} SELECT id, neighbour, round(distance, 6) AS distance, rank::INT AS rank FROM k")
def knn_join(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(neighbours.nearest(v.where("id % 5 = 0").select("id", "v"), v.where("id % 5 <> 0").select("id", "v"), 20))


@query(f"WITH {_KNN.format(on='q.vec_id <> c.vec_id', k=5)} SELECT id, round(distance, 6) AS distance FROM k WHERE rank = 5")
def kth_neighbour_distance(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id", "v")
    return rounded(neighbours.nearest(v, v, 5, same=True).where("rank = 5").select("id", "distance"))


@query(f"""WITH {_KNN.format(on='q.vec_id <> c.vec_id AND q.vec_id % 5 <> 0 AND c.vec_id % 5 <> 0', k=20)}, r AS (SELECT id, max(distance) AS kd FROM k GROUP BY id),
t AS (SELECT k.id, 1 / (avg(greatest(kd, distance)) + 1e-10) AS lrd FROM k JOIN r ON r.id = k.neighbour GROUP BY k.id),
{_KNN.format(on='q.vec_id % 5 = 0 AND c.vec_id % 5 <> 0', k=20).replace('d AS', 'd2 AS', 1).replace('FROM d ', 'FROM d2 ').replace('k AS', 'k2 AS', 1)}
SELECT k2.id, round(avg(t.lrd) * (avg(greatest(kd, distance)) + 1e-10), 6) AS lof FROM k2 JOIN r ON r.id = k2.neighbour JOIN t ON t.id = k2.neighbour GROUP BY k2.id""")
def lof_exact(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(neighbours.local_outlier_factor(v.where("id % 5 <> 0").select("id", "v"), v.where("id % 5 = 0").select("id", "v")))


@query("""WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i)
SELECT a.label AS a, b.label AS b, round(sqrt(sum(power(a.x - b.x, 2))), 6) AS distance FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY ALL""")
def centroids_distances(spark, sf_dir):
    c = _vectors(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    b = c.select(F.col("label").alias("b"), "i", F.col("x").alias("y"))
    return rounded(c.join(b, "i").where("label < b").groupBy(F.col("label").alias("a"), "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("distance")))


# ---- detectors over the features of parts


def _part_features(spark, sf_dir):
    f = features.core_features(lc_part(spark, sf_dir), ["id_objeto"], passed=("clase",)).withColumn("id", F.col("id_objeto").cast("long"))
    set_checkpoints(spark)
    with tidied(spark):
        f = stats.stratified(f, "id", "clase").checkpoint()
    return f.where("is_train"), f.where("NOT is_train")


@query()
def iforest_lof_global(spark, sf_dir):
    return detect.detect_global(*_part_features(spark, sf_dir), features.CORE)


@query()
def ood_min_score(spark, sf_dir):
    return detect.detect_against_classes(*_part_features(spark, sf_dir), features.CORE).drop("scores")


@query()
def ood_class_scores(spark, sf_dir):
    return detect.class_scores(*_part_features(spark, sf_dir), features.CORE)


@query()
def per_class_detect(spark, sf_dir):
    return detect.detect_per_class(*_part_features(spark, sf_dir), features.CORE)


@query()
def full_pipeline(spark, sf_dir):
    return detect.detect(*_part_features(spark, sf_dir), features.CORE)


# ---- positions

_SKY = "SELECT c_custkey AS id, ((c_custkey * 7919) % 36000) / 100.0::DOUBLE AS ra, ((c_custkey * 104729) % 17000) / 100.0::DOUBLE - 85 AS dec FROM customer"


def _sky(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7919) % 36000 / 100.0).alias("ra"), ((k * 104729) % 17000 / 100.0 - 85).alias("dec"))


@query(f"""WITH s AS ({_SKY}), d AS (SELECT a.id, b.id AS cat_id, degrees(2 * asin(least(1.0, sqrt(power(sin(radians(a.dec - b.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * power(sin(radians(a.ra - b.ra) / 2), 2))))) AS distance
FROM s a JOIN s b ON a.id % 2 = 0 AND b.id % 2 = 1 AND abs(a.dec - b.dec) <= 2.1), m AS (SELECT * FROM d WHERE distance <= 2.0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cat_id) = 1)
SELECT s.id, cat_id, round(distance, 6) AS distance FROM s LEFT JOIN m ON m.id = s.id WHERE s.id % 2 = 0""")
def cone_join(spark, sf_dir):
    s = _sky(spark, sf_dir)
    return rounded(crossmatch.cone_join(s.where("id % 2 = 0"), s.where("id % 2 = 1").withColumnRenamed("id", "cat_id"), 2.0))


@query("""WITH s AS (SELECT s_suppkey AS k, 'CSS_J' || lpad((s_suppkey % 24)::VARCHAR, 2, '0') || lpad((s_suppkey % 60)::VARCHAR, 2, '0') || lpad((s_suppkey % 59)::VARCHAR, 2, '0') || '.5' || CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END || '103740' AS name FROM supplier)
SELECT k AS s_suppkey, round((k % 24 + (k % 60) / 60.0::DOUBLE + (k % 59 + 0.5) / 3600.0::DOUBLE) * 15, 6) AS ra, round(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * (10 + 37 / 60.0::DOUBLE + 40 / 3600.0::DOUBLE), 6) AS dec FROM s""")
def radec_from_designation(spark, sf_dir):
    k = F.col("s_suppkey")
    two = lambda n: F.lpad((k % n).cast("string"), 2, "0")
    ra, dec = crossmatch.position(F.concat(F.lit("CSS_J"), two(24), two(60), two(59), F.lit(".5"), F.when(k % 2 == 0, "+").otherwise("-"), F.lit("103740")))
    return rounded(table(spark, sf_dir, "supplier").select("s_suppkey", ra.alias("ra"), dec.alias("dec")))


# ---- matching, components, controls


@query("""WITH d AS (SELECT q.vec_id AS id, q.label AS label, c.label AS other, avg(list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[])) AS d FROM embeddings q JOIN embeddings c ON q.vec_id % 5 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL),
s AS (SELECT id, label, min(d) FILTER (WHERE label = other) AS a, min(d) FILTER (WHERE label <> other) AS b FROM d GROUP BY ALL)
SELECT id, label, round(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s""")
def silhouette_exact(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("label", F.col("label").cast("long"))
    return rounded(neighbours.silhouettes(v.where("id % 5 = 0"), v))


@query()
def greedy_match(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(matching.match_all(v.where("id % 2 = 0").select("id", "v"), v.where("id % 2 = 1").select("id", "v")))


@query("""WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
SELECT 1 AS component, round((1 + r) / 2, 6) AS ratio, round((1 + r) / 2, 6) AS cumulative FROM r UNION ALL SELECT 2, round((1 - r) / 2, 6), 1.0 FROM r""")
def pca_variance(spark, sf_dir):
    return rounded(models.explained_variance(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], 2))


def _labelled(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumnRenamed("label", "clase")
    return v.where("id % 5 <> 0"), v.where("id % 5 = 0")


@query()
def rf_control(spark, sf_dir):
    return models.forest_control(*_labelled(spark, sf_dir))


@query()
def logreg_control(spark, sf_dir):
    return models.logistic_control(*_labelled(spark, sf_dir))


@query("SELECT o_orderkey, o_totalprice, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING' WHERE o_totalprice IS NOT NULL AND c_acctbal IS NOT NULL")
def complete_cases(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left").select("o_orderkey", "o_totalprice", "c_acctbal").dropna("any")


@query("SELECT d.doc_id, l.quality AS score, coalesce(l.toxic = 1, false) AS flag FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_scores(spark, sf_dir):
    scores = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("score"), (F.col("toxic") == 1).alias("flag"))
    return table(spark, sf_dir, "documents").select("doc_id").join(scores, "doc_id", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


_RECALL = "SELECT o_orderpriority AS clase, round(avg((o_totalprice > {at})::INT), 6) AS recall FROM orders GROUP BY ALL"


@query(f"SELECT clase, a.recall AS recall_a, b.recall AS recall_b, round(b.recall - a.recall, 6) AS difference FROM ({_RECALL.format(at=50000)}) a JOIN ({_RECALL.format(at=30000)}) b USING (clase)")
def inner_join_recalls(spark, sf_dir):
    recall = lambda at, name: rounded(table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("clase")).agg(F.avg((F.col("o_totalprice") > at).cast("int")).alias(name)))
    both = recall(50000, "recall_a").join(recall(30000, "recall_b"), "clase")
    return rounded(both.withColumn("difference", F.col("recall_b") - F.col("recall_a")))


@query("SELECT o_custkey * 1000000000000 + o_orderkey AS oid, (o_custkey * 1000000000000 + o_orderkey) // 1000000000000 AS field FROM orders")
def field_from_oid(spark, sf_dir):
    oid = F.col("o_custkey") * F.lit(10**12) + F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(oid.alias("oid"), F.expr("(o_custkey * 1000000000000L + o_orderkey) div 1000000000000L").alias("field"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main-band features of every object, in order of object."""
    return core12_main_band(spark, sf_dir).orderBy("id_objeto")
