"""Queries on places of rows, observed drops, correlations and components, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from faintlight import curves
from faintlight.operators import linear, quality
from faintlight.plans.queries import LINEITEM, lc_lineitem, query, rounded, table
from faintlight.sources import scans


@query("SELECT o_orderkey, position FROM (SELECT o_orderkey, row_number() OVER () - 1 AS position FROM orders) WHERE position < 5000")
def positional_head(spark, sf_dir):
    return scans.first_rows(spark, f"{sf_dir}/orders.parquet", 5000).select("o_orderkey", "position")


_AT = "SELECT {key} AS id, row_number() OVER () - 1 AS position FROM {name}"


@query(f"""SELECT 'train' AS split, id, position FROM (SELECT id, position FROM ({_AT.format(key="c_custkey", name="customer")})
UNION ALL SELECT id, position + (SELECT count(*) FROM customer) FROM ({_AT.format(key="p_partkey", name="part")})) WHERE position < 2000
UNION ALL SELECT 'test', id, position FROM ({_AT.format(key="o_orderkey", name="orders")}) WHERE position < 800""")
def train_test_truncated(spark, sf_dir):
    train, test = scans.train_and_test(spark, [f"{sf_dir}/customer.parquet", f"{sf_dir}/part.parquet"], f"{sf_dir}/orders.parquet", 2000, 800)
    return train.select(F.lit("train").alias("split"), F.coalesce("c_custkey", "p_partkey").alias("id"), "position").union(test.select(F.lit("test"), "o_orderkey", "position"))


@query("""WITH p AS (SELECT lang, row_number() OVER () <= 300 AS part FROM documents), g AS (SELECT lang, count(*) AS n_all, count(*) FILTER (WHERE part) AS n_part FROM p GROUP BY lang)
SELECT lang, n_all, n_part, round(n_all::DOUBLE / sum(n_all) OVER (), 6) AS share_all, round(n_part::DOUBLE / sum(n_part) OVER (), 6) AS share_part FROM g""")
def truncated_shares(spark, sf_dir):
    rows = scans.positioned(spark, f"{sf_dir}/documents.parquet").select("lang", "position")
    return rounded(scans.shares(rows, F.col("position") < 300, "lang"))


def _array_curves(spark, sf_dir):
    """Curves of events as arrays, some of them broken by a rule."""
    e = table(spark, sf_dir, "events").where("value < 250")
    rows = F.array_sort(F.collect_list(F.struct(curves.days(F.col("ts")).alias("t"), "event_id", F.col("value").alias("m"))))
    c = e.groupBy(F.col("user_id").alias("id_objeto"), F.col("event_type").alias("banda")).agg(rows.alias("p"))
    t, m, u = F.col("p.t"), F.col("p.m"), F.col("id_objeto")
    c = c.select(
        F.col("id_objeto").cast("string").alias("id_objeto"), "banda",
        F.when(u % 7 == 0, F.slice(t, 1, F.size(t) - 1)).otherwise(t).alias("t"),
        F.when(u % 11 == 0, F.transform(m, lambda x: x + float("nan"))).otherwise(m).alias("m"),
        F.when(u % 13 == 0, F.slice(m, 1, F.size(m) - 1)).when(u % 2 == 0, m).alias("e"),
        F.lit(None).cast("string").alias("clase"), F.create_map(F.lit("period"), u.cast("double")).alias("metadata"),
    )
    return c


_BROKEN = """c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value < 250 GROUP BY ALL), r AS (SELECT *, CASE WHEN user_id % 7 = 0 THEN 'times and magnitudes differ in number'
    WHEN user_id % 13 = 0 THEN 'errors differ in number' WHEN user_id % 11 = 0 OR n < 2 THEN 'too few finite points' END AS reason FROM c)"""


@query(f"WITH {_BROKEN} SELECT reason, count(*) AS curves FROM r WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'kept', count(*) FROM r WHERE reason IS NULL")
def observed_drops(spark, sf_dir):
    scan = scans.checked(_array_curves(spark, sf_dir))
    kept = scan.curves.agg(F.count("*").alias("curves")).select(F.lit("kept").alias("reason"), "curves")
    return scan.rejected.groupBy("reason").agg(F.count("*").alias("curves")).union(kept)


@query(f"""WITH {_BROKEN} SELECT e.user_id::VARCHAR AS id_objeto, e.event_type AS banda, count(*) AS n, round(sum(value), 6) AS total, round(max(e.user_id)::DOUBLE, 6) AS period
FROM events e JOIN r USING (user_id, event_type) WHERE reason IS NULL AND value < 250 GROUP BY ALL""")
def curve_points_with_metadata(spark, sf_dir):
    p = scans.points(scans.checked(_array_curves(spark, sf_dir)).curves)
    return rounded(p.groupBy("id_objeto", "banda").agg(F.count("*").alias("n"), F.sum("m").alias("total"), F.max(F.col("metadata")["period"]).alias("period")))


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]
_R = "r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in _PAIRS) + ")"


@query(f"WITH {_R} SELECT a, b, round(r, 6) AS r, (abs(r) >= 0.75)::INT + (abs(r) >= 0.9)::INT AS band FROM r")
def correlation_matrix(spark, sf_dir):
    return rounded(linear.correlations(table(spark, sf_dir, "lineitem"), _NUMBERS))


_MATRIX = f"""WITH {_R}, m AS (SELECT a, b, r FROM r UNION ALL SELECT b, a, r FROM r UNION ALL SELECT unnest({_NUMBERS}), unnest({_NUMBERS}), 1.0),
m2 AS (SELECT x.a, y.b, sum(x.r * y.r) AS r FROM m x JOIN m y ON x.b = y.a GROUP BY ALL), m3 AS (SELECT x.a, y.b, sum(x.r * y.r) AS r FROM m2 x JOIN m y ON x.b = y.a GROUP BY ALL),
m4 AS (SELECT x.a, y.b, sum(x.r * y.r) AS r FROM m3 x JOIN m y ON x.b = y.a GROUP BY ALL)"""


@query(_MATRIX + " UNION ALL ".join(f" SELECT {p} AS power, round(sum(r), 6) AS total FROM m{p if p > 1 else ''} WHERE a = b" for p in (1, 2, 3, 4)))
def component_power_sums(spark, sf_dir):
    """Sums of powers of all eigenvalues, which determine them, against traces of powers of the matrix."""
    values = linear.components(table(spark, sf_dir, "lineitem"), _NUMBERS).values
    return rounded(spark.createDataFrame([(p, float((values**p).sum())) for p in (1, 2, 3, 4)], "power int, total double"))


@query("""SELECT l_orderkey, l_linenumber, round(abs((z(l_quantity) + z(l_extendedprice)) / sqrt(2)), 5) AS first, round(abs((z(l_quantity) - z(l_extendedprice)) / sqrt(2)), 5) AS second FROM lineitem"""
       .replace("z(l_quantity)", "(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()").replace("z(l_extendedprice)", "(l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER ()"))
def pca_scores(spark, sf_dir):
    """Scores up to sign: the components of two columns are their sum and difference, whichever explains more."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    found = linear.components(li, ["l_quantity", "l_extendedprice"])
    scored = found.scores(li, 2)
    same = (found.vectors[0, 0] > 0) == (found.vectors[1, 0] > 0)
    first, second = ("pc1", "pc2") if same else ("pc2", "pc1")
    return scored.select("l_orderkey", "l_linenumber", F.round(F.abs(first), 5).alias("first"), F.round(F.abs(second), 5).alias("second"))


_DIGEST = f"""WITH {LINEITEM}, d AS (SELECT id_objeto, banda, count(*) AS n, list((round(t, 4), round(m, 2)) ORDER BY t, m, e) AS content FROM p GROUP BY ALL)"""


@query(_DIGEST + " SELECT count(*) AS curves, count(DISTINCT content) AS contents FROM d")
def curve_digests(spark, sf_dir):
    found = quality.curve_hash(lc_lineitem(spark, sf_dir).withColumn("e", F.lit(None).cast("double")), decimals=4)
    return found.agg(F.count("*").alias("curves"), F.count_distinct("content").alias("contents"))


@query(f"""WITH {LINEITEM}, l AS (SELECT * FROM p WHERE id_objeto::INT % 3 <> 0 UNION ALL SELECT 'copy of ' || id_objeto, banda, t, m, e, clase FROM p WHERE id_objeto::INT % 6 = 0)
SELECT id_objeto, banda FROM p WHERE id_objeto::INT % 3 = 0 AND id_objeto::INT % 6 <> 0 GROUP BY ALL""")
def leakless_curves(spark, sf_dir):
    p = lc_lineitem(spark, sf_dir)
    key = F.col("id_objeto").cast("int")
    copies = p.where(key % 6 == 0).withColumn("id_objeto", F.concat(F.lit("copy of "), "id_objeto"))
    return quality.without_known_curves(p.where(key % 3 != 0).union(copies), p.where(key % 3 == 0)).select("id_objeto", "banda")


@query(f"""WITH {LINEITEM}, l AS (SELECT id_objeto, banda, e >= 25 AS late, t, m FROM p), c AS (SELECT id_objeto, banda, late, count(*) AS n FROM l GROUP BY ALL),
w AS (SELECT id_objeto, banda, max(late::INT) = 1 AS late FROM c GROUP BY ALL) SELECT l.id_objeto, l.banda, count(*) AS n, round(sum(m), 6) AS total FROM l JOIN w USING (id_objeto, banda, late) GROUP BY ALL""")
def last_duplicate_wins(spark, sf_dir):
    p = lc_lineitem(spark, sf_dir).withColumn("late", (F.col("e") >= 25).cast("int"))
    return rounded(curves.last_duplicate(p, "late").groupBy("id_objeto", "banda").agg(F.count("*").alias("n"), F.sum("m").alias("total")))
