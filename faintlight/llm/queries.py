"""The registered queries of the operators, with SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faintlight.llm import langid, packing, toxicity
from faintlight.llm.chat import perspectives
from faintlight.llm.decontamination import contaminated
from faintlight.llm.mixing import mixed
from faintlight.llm.neardup import near_duplicates
from faintlight.llm.negatives import hard_negatives
from faintlight.llm.sharding import hash60, rendezvous, with_slots
from faintlight.llm.substrings import without_repeats
from faintlight.llm.suffixes import without_repeated_bytes
from faintlight.llm.topk import nearest
from faintlight.llm.whitening import whitened


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = docs.withColumn("shard", rendezvous(F.col("doc_id"), {s: 1.0 for s in range(24)}))
    placed = placed.withColumn("grown_shard", rendezvous(F.col("doc_id"), {s: 1.0 for s in range(25)}))
    slots = with_slots(placed, "shard", "doc_id", spread=hash60(F.col("doc_id"), F.col("text_crc32"), F.lit("slot")))
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_matched", "n_windows", "n_slots")


def remainder(modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder(3) == 1
    model = toxicity.learned(docs, table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.scored(docs, model, keep=("doc_id", held_out.alias("held_out")), passages=False)
    return found.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), digest=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder(5) == 0
    model = langid.learned(docs.where(~held_out))
    return langid.identified(docs, model, keep=("doc_id", held_out.alias("held_out")))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_bytes(table(spark, sf_dir, "documents"), digest=True)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, vec_id % 100 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    parts = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_sharding, op3_mixing, op4_exact_topk, op5_chat_formatting, op6_decontamination,
        op7_toxicity, op8_substring_dedup, op9_language_id, op10_suffix_array_dedup, op11_hard_negatives,
        op12_whitening, op13_best_fit_packing,
    )
}

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
LOWER_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({LOWER_WORDS}, []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op2_sharding": """
WITH RECURSIVE steps AS (SELECT i AS c, i, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i, k + 1 FROM steps WHERE k < 8),
m AS (SELECT list(c ORDER BY i) AS m FROM steps WHERE k = 8),
x AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, hex(encode(text)) AS h FROM documents),
y AS (SELECT doc_id, k, h, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM x),
d AS (SELECT doc_id, k, coalesce(length(h) // 2, 0)::BIGINT + 8 AS size,
    xor(list_reduce(b, lambda c, v: xor(c >> 8, m[(xor(c, v) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32 FROM y, m),
u AS (SELECT k, s::INTEGER AS s, (('0x' || substr(md5(k || ':' || s), 1, 15))::BIGINT::DOUBLE + 1.0::DOUBLE) / 1152921504606846978.0::DOUBLE AS u
    FROM (SELECT DISTINCT k FROM d), range(25) t(s)),
r AS (SELECT k, first(s ORDER BY -1.0::DOUBLE / ln(u) DESC, s) FILTER (WHERE s < 24) AS shard, first(s ORDER BY -1.0::DOUBLE / ln(u) DESC, s) AS grown_shard FROM u GROUP BY k),
p AS (SELECT doc_id, size, text_crc32, shard, grown_shard,
    (('0x' || substr(md5(k || ':' || coalesce(text_crc32::VARCHAR, 'null') || ':slot'), 1, 15))::BIGINT >> 48) % least(4096, ceil((SELECT count(*) FROM d) / 50000.0)::BIGINT) AS bucket
    FROM d JOIN r USING (k))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
    row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS slot FROM p""",
    "op3_mixing": """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS lim,
    1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM s) AS budget FROM s),
v AS (SELECT *, (budget - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, lim / weight AS ratio FROM w),
t AS (SELECT source, source_size, least(lim, coalesce(weight * (SELECT arg_min(level, ratio) FROM v WHERE level * weight < lim), lim)) AS target FROM v),
q AS (SELECT d.*, source_size, target, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 15))::BIGINT AS h FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id) AS ends FROM q WHERE size > 0),
f AS (SELECT *, (ends + (nth - 1) * source_size)::DOUBLE / target AS finish FROM e, (VALUES (1), (2)) n(nth)),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, nth, h, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM f),
k AS (SELECT doc_id, count(*) AS copies FROM g WHERE total <= (SELECT sum(target) FROM t) GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id""",
    "op4_exact_topk": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v, c.v))::BIGINT AS score FROM v q JOIN v c
    ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_chat_formatting": """
WITH t AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
p AS (SELECT conv_id, speaker, place, coalesce(role = speaker, false) AS own, ((place - 1) // 128)::INTEGER AS part, text || '<|end|>' || chr(10) AS body,
    CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
    ELSE '<|user:' || coalesce(replace(role, '<|', '< |'), '?') || '|>' END || chr(10) AS head FROM t JOIN s USING (conv_id)),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY place) - length(body) AS pos FROM p)
SELECT conv_id, speaker, part, count(*)::INTEGER AS n_turns, string_agg(head || body, '' ORDER BY place) AS text,
    coalesce(list(pos::INTEGER ORDER BY place) FILTER (WHERE own), []) AS mask_start,
    coalesce(list(length(body)::INTEGER ORDER BY place) FILTER (WHERE own), []) AS mask_length
FROM o GROUP BY conv_id, speaker, part""",
    "op8_substring_dedup": f"""
WITH w AS (SELECT doc_id, coalesce({WORDS}, []) AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS first FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM f WHERE first < doc_id),
k AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
j AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS r,
    array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: ws[i]), ' ') AS kept
    FROM w LEFT JOIN k USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM j""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
q AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM p WHERE same),
r AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
    FROM q JOIN p USING (anchor_id) WHERE nth <= 5 AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5""",
}
