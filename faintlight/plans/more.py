"""More registered queries: feature packs, cleaning, samples, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faintlight.functions import packs
from faintlight.operators import cleaning, quality, sampling, stats
from faintlight.plans.queries import LINEITEM, lc_lineitem, query, rounded, table

CURVE, OBJECT = ["id_objeto", "banda"], ["id_objeto"]


def _steps_sql(keys: str, order: str = "t, m, e NULLS FIRST") -> str:
    return f"""{LINEITEM}, s AS (SELECT *, quantile_cont(m, 0.5) OVER k AS med, avg(m) OVER k AS mu, count(*) OVER k AS c, 1 / power(greatest(abs(e), 1e-6), 2) AS w,
    t - lag(t) OVER o AS dt, m - lag(m) OVER o AS dm, max(t) OVER k AS last FROM p WINDOW k AS (PARTITION BY {keys}), o AS (PARTITION BY {keys} ORDER BY {order}))"""


def _r(**columns: str) -> str:
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in columns.items())


def _quantile(q: float, c: str = "m") -> str:
    return f"quantile_cont({c}, {q})"


# ---- feature packs


@query(f"WITH {_steps_sql('id_objeto, banda')} SELECT id_objeto, banda, count(*) AS n, " + _r(
    mean="avg(m)", std="stddev_pop(m)", median=_quantile(0.5), mad="quantile_cont(abs(m - med), 0.5)", min="min(m)", max="max(m)", amplitude=f"{_quantile(0.95)} - {_quantile(0.05)}",
    iqr=f"{_quantile(0.75)} - {_quantile(0.25)}", p10=_quantile(0.1), p90=_quantile(0.9), slope="CASE WHEN count(*) >= 3 THEN regr_slope(m, t) END", error_mean="avg(e)", error_std="stddev_pop(e)",
    cadence_mean="avg(dt)", cadence_std="stddev_pop(dt)") + " FROM s GROUP BY ALL")
def feature_pack_12(spark, sf_dir):
    return rounded(packs.band_pack(lc_lineitem(spark, sf_dir), CURVE))


@query(f"WITH {_steps_sql('id_objeto, banda')} SELECT id_objeto, banda, count(*) AS n, " + _r(
    mean="avg(m)", std="stddev_pop(m)", amplitude="(max(m) - min(m)) / 2", q05=_quantile(0.05), q25=_quantile(0.25), q75=_quantile(0.75), q95=_quantile(0.95), iqr=f"{_quantile(0.75)} - {_quantile(0.25)}",
    time_span="max(t) - min(t)", mean_error="avg(e)", snr="stddev_pop(m) / avg(e)", std_diff="stddev_pop(dm)") + " FROM s GROUP BY ALL")
def feature_pack_13(spark, sf_dir):
    return rounded(packs.strict_pack(lc_lineitem(spark, sf_dir), CURVE))


@query(f"WITH {_steps_sql('id_objeto', 'banda, t, m, e NULLS FIRST')}, a AS (SELECT *, abs(dm) AS ad FROM s) SELECT id_objeto, count(*) AS n, " + _r(
    mean="avg(m)", median=_quantile(0.5), weighted_mean="sum(w * m) / sum(w)", std="stddev_pop(m)", q25=_quantile(0.25), q75=_quantile(0.75), range="max(m) - min(m)", change_mean="avg(ad)", change_max="max(ad)",
    change_std="stddev_pop(ad)", percent_amplitude=f"(max(m) - min(m)) / 2 / abs({_quantile(0.5)})", change_ratio="avg(ad) / stddev_pop(m)", iqr_ratio=f"({_quantile(0.75)} - {_quantile(0.25)}) / stddev_pop(m)")
    + " FROM a GROUP BY ALL")
def feature_pack_15(spark, sf_dir):
    return rounded(packs.concatenated_pack(lc_lineitem(spark, sf_dir), OBJECT))


@query(f"""WITH {_steps_sql('id_objeto, banda')}, d AS (SELECT id_objeto, banda, m - med AS c, quantile_cont(abs(m - med), 0.5) OVER k AS mad, stddev_pop(m) OVER k AS sd FROM s WINDOW k AS (PARTITION BY id_objeto, banda)),
x AS (SELECT id_objeto, banda, c / CASE WHEN mad > 1e-12 THEN mad WHEN sd > 1e-12 THEN sd ELSE 1 END AS x FROM d), y AS (SELECT *, avg(x) OVER (PARTITION BY id_objeto, banda) AS mu FROM x)
SELECT id_objeto, banda, """ + _r(
    mean="avg(x)", std="stddev_pop(x)", q10=_quantile(0.1, "x"), q25=_quantile(0.25, "x"), q75=_quantile(0.75, "x"), q90=_quantile(0.9, "x"), range="max(x) - min(x)",
    skew="CASE WHEN stddev_pop(x) > 1e-12 THEN avg(power(x - mu, 3)) / power(stddev_pop(x), 3) ELSE 0 END") + ", round(quantile_cont(x, 0.5), 6) + 0.0 AS q50 FROM y GROUP BY ALL")
def feature_pack_16(spark, sf_dir):
    # A median of 0 may come out as -0 in either engine.
    return rounded(packs.centred_pack(lc_lineitem(spark, sf_dir), CURVE)).withColumn("q50", F.col("q50") + 0.0)


@query(f"""WITH {_steps_sql('id_objeto, banda')}, x AS (SELECT *, sum(w * m) OVER k / sum(w) OVER k AS wm FROM s WINDOW k AS (PARTITION BY id_objeto, banda)),
y AS (SELECT *, sqrt(c / nullif(c - 1, 0)::DOUBLE) * (m - wm) / greatest(abs(e), 1e-6) AS d FROM x)
SELECT id_objeto, banda, count(*) AS n, """ + _r(
    std="stddev_samp(m)", ipr=f"{_quantile(0.75)} - {_quantile(0.25)}", p80_p20=f"{_quantile(0.8)} - {_quantile(0.2)}", chi2="avg(power((m - wm) / greatest(abs(e), 1e-6), 2))",
    stetson_k="avg(abs(d)) / sqrt(avg(d * d))", eta="CASE WHEN sum(power(m - mu, 2)) > 1e-12 THEN sum(dm * dm) / sum(power(m - mu, 2)) END",
    maximum_slope="coalesce(max(abs(dm / dt)) FILTER (WHERE dt <> 0), 0)") + " FROM y GROUP BY ALL")
def feature_pack_18(spark, sf_dir):
    return rounded(packs.weighted_pack(lc_lineitem(spark, sf_dir), CURVE))


@query(f"""WITH {_steps_sql('id_objeto, banda')}, g AS (SELECT id_objeto, banda, t, count(*) AS c, count(DISTINCT m) AS d, max(last) AS last FROM s GROUP BY ALL),
h AS (SELECT *, t - lag(t) OVER (PARTITION BY id_objeto, banda ORDER BY t) AS step, c > 1 AND t < last AS tied FROM g)
SELECT id_objeto, banda, count(*) FILTER (WHERE tied) AS groups, count(*) FILTER (WHERE tied AND d = 1) AS constant, count(*) FILTER (WHERE tied AND d > 1) AS differing,
    coalesce(sum(c - 1) FILTER (WHERE tied), 0)::BIGINT AS repeated, round(min(step), 6) AS least_step FROM h GROUP BY ALL""")
def tie_characterisation(spark, sf_dir):
    return rounded(packs.ties_of_object(lc_lineitem(spark, sf_dir), CURVE))


# ---- cleaning

_ODD = "x AS (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 3 THEN NULL WHEN 4 THEN 'NaN'::DOUBLE WHEN 5 THEN 'Infinity'::DOUBLE ELSE o_totalprice END AS v, o_shippriority_ AS w, o_orderkey % 4 <> 0 AS tr FROM (SELECT *, o_custkey::DOUBLE AS o_shippriority_ FROM orders))"
_OK = "CASE WHEN isfinite(v) THEN v END"


def _odd(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.when(k % 10 == 3, None).when(k % 10 == 4, float("nan")).when(k % 10 == 5, float("inf")).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"), F.col("o_custkey").cast("double").alias("w"), (k % 4 != 0).alias("tr"))


@query(f"WITH {_ODD}, f AS (SELECT o_orderkey, CASE WHEN v IS NULL OR isnan(v) THEN (SELECT quantile_cont(v, 0.5) FROM x WHERE tr AND v IS NOT NULL AND NOT isnan(v)) ELSE v END AS v FROM x) SELECT o_orderkey, round(CASE WHEN isfinite(v) THEN v ELSE 0 END, 6) AS v FROM f")
def fill_then_zero(spark, sf_dir):
    return rounded(cleaning.fill_then_zero(_odd(spark, sf_dir), ["v"], F.col("tr")).select("o_orderkey", "v"))


@query(f"WITH {_ODD} SELECT o_orderkey, round(coalesce({_OK}, (SELECT quantile_cont(v, 0.5) FROM x WHERE isfinite(v)), 0), 6) AS v FROM x")
def fill_own_medians(spark, sf_dir):
    return rounded(cleaning.fill_by_own_medians(_odd(spark, sf_dir), ["v"]).select("o_orderkey", "v"))


@query(f"WITH {_ODD} SELECT o_orderkey, coalesce({_OK}, 0) AS v FROM x")
def zero_fill(spark, sf_dir):
    return cleaning.zero_filled(_odd(spark, sf_dir), ["v"]).select("o_orderkey", "v")


@query(f"WITH {_ODD} SELECT o_orderkey, round(CASE WHEN v IS NULL OR isnan(v) THEN (SELECT quantile_cont(v, 0.5) FROM x WHERE tr AND isfinite(v)) ELSE v END, 6) AS v FROM x WHERE v IS NULL OR isnan(v) OR isfinite(v)")
def median_fill_train(spark, sf_dir):
    return rounded(cleaning.median_filled(_odd(spark, sf_dir), ["v"], F.col("tr")).where(F.abs("v") < float("inf")).select("o_orderkey", "v"))


@query(f"WITH {_ODD} SELECT o_orderkey, {_OK} AS v FROM x")
def unfinite_to_null(spark, sf_dir):
    return cleaning.nulled(_odd(spark, sf_dir), ["v"]).select("o_orderkey", "v")


@query("SELECT o_orderkey, o_custkey::DOUBLE AS w FROM orders")
def whole_columns_only(spark, sf_dir):
    x = _odd(spark, sf_dir)
    return x.select("o_orderkey", *cleaning.whole_columns(x, ["v", "w"]))


@query("SELECT NULL::DOUBLE AS absent, o_custkey::DOUBLE AS w, o_orderkey FROM orders")
def align_columns(spark, sf_dir):
    return cleaning.aligned(_odd(spark, sf_dir), ["absent", "w", "o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN (SELECT quantile_cont(o_totalprice, 0.01) FROM orders) AND (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)")
def clip_p1_p99(spark, sf_dir):
    return cleaning.clipped_out(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("SELECT vec_id, len(embedding) - (vec_id % 3)::BIGINT AS n, embedding[len(embedding) - vec_id % 3]::DOUBLE AS last FROM embeddings")
def truncate_arrays(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    short = F.slice("embedding", 1, (F.size("embedding") - F.col("vec_id") % 3).cast("int"))
    a, b = cleaning.truncated(F.col("embedding"), short)
    return e.select("vec_id", F.size(a).cast("long").alias("n"), F.element_at(b, -1).cast("double").alias("last"))


@query(f"WITH {_ODD}" + " UNION ALL ".join(f""" SELECT '{c}' AS variable, count(*) FILTER (WHERE isfinite({c})) AS n, count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS n_nan, count(*) FILTER (WHERE isinf({c})) AS n_inf, round(min({c}) FILTER (WHERE isfinite({c})), 6) AS min,
    round(max({c}) FILTER (WHERE isfinite({c})), 6) AS max, round(avg({c}) FILTER (WHERE isfinite({c})), 4) AS mean, round(stddev_pop({c}) FILTER (WHERE isfinite({c})), 4) AS std, min({c}) FILTER (WHERE isfinite({c})) = max({c}) FILTER (WHERE isfinite({c})) AS constant FROM x""" for c in ("v", "w")))
def scan_quality(spark, sf_dir):
    x = cleaning.scan_quality(_odd(spark, sf_dir), ["v", "w"])
    return rounded(x.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4)))


# ---- samples and permutations


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || '42'), o_orderkey LIMIT 500")
def sample_n(spark, sf_dir):
    return sampling.sampled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("SELECT event_id, user_id, ('0x' || substr(md5(user_id::VARCHAR || '42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 AS is_test FROM events")
def group_shuffle_split(spark, sf_dir):
    return sampling.group_split(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id")


_PERMUTED = """a AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
b AS (SELECT user_id, value AS dealt, row_number() OVER (PARTITION BY user_id ORDER BY md5(event_id::VARCHAR || '42'), event_id) AS n FROM events)"""


@query(f"WITH {_PERMUTED} SELECT user_id, event_id, dealt AS value FROM a JOIN b USING (user_id, n)")
def permute_within_curve(spark, sf_dir):
    return sampling.permuted(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "event_id", "value", ["user_id"])


_CONTROL = """x AS (SELECT doc_id, lang, n_chars, toxic FROM documents JOIN labels USING (doc_id)), a AS (SELECT s AS seed, lang, n_chars, row_number() OVER (PARTITION BY s, lang ORDER BY doc_id) AS n FROM x, range(42, 47) t(s)),
b AS (SELECT s AS seed, lang, toxic, row_number() OVER (PARTITION BY s, lang ORDER BY md5(doc_id::VARCHAR || s), doc_id) AS n FROM x, range(42, 47) t(s))"""


@query(f"WITH {_CONTROL} SELECT seed::INTEGER AS seed, round(avg(n_chars) FILTER (WHERE toxic = 1) - avg(n_chars) FILTER (WHERE toxic = 0), 6) AS agreement FROM a JOIN b USING (seed, lang, n) GROUP BY seed")
def label_permutation_control(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return rounded(sampling.permutation_control(x, "doc_id", "n_chars", "toxic", "lang"))


@query(f"WITH {_CONTROL}, m AS (SELECT seed, avg(n_chars) FILTER (WHERE toxic = 1) - avg(n_chars) FILTER (WHERE toxic = 0) AS v FROM a JOIN b USING (seed, lang, n) GROUP BY seed) SELECT count(*) AS runs, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM m")
def multi_seed_summary(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return rounded(stats.run_summary(sampling.permutation_control(x, "doc_id", "n_chars", "toxic", "lang"), "agreement"))


# ---- counts, comparisons, orders


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_distinct, count(*) - count(DISTINCT o_custkey) AS n_repeated FROM orders")
def distinct_counts(spark, sf_dir):
    return quality.repeats(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT source, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY source")
def field_histogram(spark, sf_dir):
    return rounded(stats.histogram(table(spark, sf_dir, "documents"), "source"))


@query("SELECT o_custkey AS id, count(*) AS n, count(DISTINCT (o_orderstatus, o_orderpriority)) AS n_contents, count(DISTINCT (o_orderstatus, o_orderpriority)) = 1 AS identical FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def repeated_ids(spark, sf_dir):
    return quality.repeated_ids(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"]).withColumnRenamed("o_custkey", "id")


@query("SELECT user_id, event_type, min(event_id) AS first, count(*) AS n FROM events GROUP BY ALL")
def unique_with_first(spark, sf_dir):
    return quality.unique_with_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)) AS n_shared, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)) = 0 AS disjoint")
def sets_disjoint(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return quality.disjoint(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey")


@query("SELECT o_orderstatus, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 15")
def top_of_each_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    place = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    return o.withColumn("place", place).where("place <= 15")


@query("WITH p AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS v FROM part GROUP BY p_brand) SELECT p_brand, n, round(v, 6) AS v, row_number() OVER (ORDER BY n DESC, v DESC, p_brand) AS place FROM p")
def ordinal_ranks(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("v"))
    # A row for each brand: the result of an aggregate, not a table.
    return rounded(p.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("v"), "p_brand")).cast("long")))


@query("""WITH d AS (SELECT abs(l_extendedprice - l_quantity * p_retailprice) AS d FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT count(*) AS n, round(avg(d), 4) AS mean, round(quantile_cont(d, 0.5), 6) AS median, round(max(d), 6) AS max, count(*) FILTER (WHERE d > 1e-9) AS n_differ, round(100.0::DOUBLE * count(*) FILTER (WHERE d > 1e-9) / count(*), 6) AS percent_differ FROM d""")
def paired_compare(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    found = stats.differences(pairs, F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"))
    return rounded(found.withColumn("mean", F.round("mean", 4)))


@query("SELECT l_returnflag AS g, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY l_returnflag")
def quantiles_by_group(spark, sf_dir):
    q = F.percentile("l_extendedprice", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return rounded(table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(q[0].alias("p10"), q[1].alias("median"), q[2].alias("p90")))


@query(f"WITH {LINEITEM}, c AS (SELECT id_objeto, count(*) AS n, avg(m) AS mean, stddev_pop(m) AS std FROM p GROUP BY id_objeto) SELECT CASE WHEN n < 50 THEN '<50' WHEN n < 500 THEN '50-499' ELSE '>=500' END AS bucket, count(*) AS objects, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std FROM c GROUP BY bucket")
def bucket_means(spark, sf_dir):
    c = lc_lineitem(spark, sf_dir).groupBy("id_objeto").agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))
    bucket = stats.bucket(F.col("n"), [50, 500], ["<50", "50-499", ">=500"])
    return rounded(c.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("objects"), F.avg("mean").alias("mean"), F.avg("std").alias("std")))


@query("SELECT doc_id FROM labels WHERE toxic = 1")
def truthy_filter(spark, sf_dir):
    return cleaning.truthy(table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "True").otherwise("False").alias("flag")), "flag").select("doc_id")
