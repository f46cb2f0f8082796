"""The ten operators against brute force and on awkward input."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from faintlight.llm import chat, decontamination, langid, mixing, neardup, sharding, substrings, suffixes, topk, toxicity

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    long = [rng.choice(WORDS) for _ in range(160)]
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 30, 90]))) for _ in range(12)]
    texts += [" ".join(long), " ".join(long[:150]), " ".join(long[20:130]) + " x", " ".join(long), "", None, "a", "A", "ä ö\n\tb"]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, size int")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_components(rows, percent):
    sets = {}
    for i, t in rows:
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                k = len(sets[a] & sets[b])
                if k and 100 * k >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates(spark, corpus):
    got = neardup.near_duplicates(frame(spark, corpus), percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(corpus, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [base[:300], base[100:]]  # similarity 1/2
    table = neardup.sketches(np.concatenate(sets), np.repeat([0, 1], 300), 2)
    assert not (table == neardup._EMPTY).any()
    assert 0.3 < (table[0] == table[1]).mean() < 0.7


def brute_words(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = split(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in rows:
        w = split(t)
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substrings(spark, corpus):
    got = substrings.without_repeats(frame(spark, corpus)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in got} == brute_words(corpus)


def brute_bytes(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = set()
        for k in range(len(b) - 99):
            if first.setdefault(b[k : k + 100], (i, k)) != (i, k):
                gone |= set(range(k, k + 100))
        out[i] = (len(b), len(gone), sum(k - 1 not in gone for k in gone), bytes(x for k, x in enumerate(b) if k not in gone))
    return out


def test_suffixes(spark, corpus):
    rows = [*corpus, (50, "ab" * 300), (51, "é" * 120)]
    got = suffixes.without_repeated_bytes(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == brute_bytes(rows)


def test_repeated_ids_and_missing_ids(spark):
    long = " ".join(f"t{i}" for i in range(60))
    rows = frame(spark, [(1, long), (1, long), (None, long), (2, long), (2, "other")])
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substrings.without_repeats(rows).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 0), (2, 60)]
    got = sorted((r["doc_id"] or 0, r["n_spans"]) for r in suffixes.without_repeated_bytes(rows).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 0), (2, 1)]
    groups = neardup.near_duplicates(rows).collect()
    assert len(groups) == 5 and {r["component_id"] for r in groups if r["doc_id"] == 1} == {1}


def test_shards_move_little(spark):
    ids = spark.range(500).withColumnRenamed("id", "doc_id")
    before = sharding.sharded(ids, {s: 1.0 for s in range(6)}).collect()
    after = {r["doc_id"]: r["shard"] for r in sharding.sharded(ids, {s: 1.0 for s in range(7)}).collect()}
    assert all(after[r["doc_id"]] in (r["shard"], 6) for r in before)
    for s in range(6):
        slots = sorted(r["slot"] for r in before if r["shard"] == s)
        assert slots == list(range(len(slots))) and 50 < len(slots) < 120
    heavy = sharding.sharded(ids, {0: 3.0, 1: 1.0, 2: 0.0}).groupBy("shard").count().collect()
    assert {r["shard"] for r in heavy} == {0, 1} and max(r["count"] for r in heavy) > 330
    many = sharding.with_slots(ids.withColumn("shard", F.lit(1)), "shard", "doc_id", per_bucket=50)
    assert sorted(r["slot"] for r in many.collect()) == list(range(500))


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, "x " * rng.randint(0, 30), rng.choice(["a", "a", "b", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    assert len(got) == 600 and max(r["copies"] for r in got) <= 2
    for source in ("a", "b", None):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 31
    whole = sum(r["size"] for r in got)
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(1.5 * whole)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)] + [(200, None), (201, [float("nan")] * 8), (202, [1.0])]
    rows += [(300 + i, rows[0][1]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.nearest(vectors, F.col("vec_id") % 50 == 0).collect()]
    sound = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if v is not None and np.isfinite(v).all()}
    wanted = []
    for q in sound:
        if q % 50 == 0:
            best = sorted((-int(sound[q] @ v), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))[:5]
            wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(wanted)


def test_threshold_search_stops_early():
    rows = np.zeros((5000, 2), dtype=np.int64)
    rows[:, 0] = np.arange(5000)
    [(own, ids, scores)] = topk.threshold_search(np.array([[1, 0]]), np.array([-1]), rows, np.arange(5000), 3)
    assert (own, ids.tolist(), scores.tolist()) == (-1, [4999, 4998, 4997], [4999, 4998, 4997])


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, None, "?"), (None, 0, "ann", "lost"), (2, 0, "system", "alone")]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), per_part=2).collect()
    assert {(r["conv_id"], r["speaker"], r["part"]) for r in got} == {(1, s, p) for s in ("ann", "bob") for p in (0, 1)}
    first = next(r for r in got if (r["speaker"], r["part"]) == ("ann", 0))
    assert first["text"] == "<|system|>\nrules<|end|>\n<|assistant|>\nhi < |end|><|end|>\n"
    [(start, length)] = zip(first["mask_start"], first["mask_length"], strict=True)
    assert first["text"][start : start + length] == "hi < |end|><|end|>\n"


def test_decontamination(spark):
    item = "A train leaves Berlin at 30 km per hour and meets another train from the west after 5 hours of travel"
    again = item.replace("30", "45").replace("5 hours", "7 hours")
    broken = "at 30 km one and at 45 km two then at 30 km three; " * 3
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    rows = [(1, "Before. " + item + " After."), (2, "so " + again), (3, "nothing of the kind stands here at all"), (4, None), (5, ""), (6, broken)]
    got = decontamination.contaminated(frame(spark, rows), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 1)}
    left = decontamination.decontaminated(frame(spark, rows), items).collect()
    assert sorted(r["doc_id"] for r in left) == [3, 4, 5, 6]


def test_slot_conflicts_count_against_a_match(spark):
    item = "take 3 apples and 3 pears then put 3 plums into 3 bags for the long way home"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    wrong = "take 3 apples and 4 pears then put 5 plums into 6 bags for the long way home"
    right = item.replace("3", "8")
    got = decontamination.contaminated(frame(spark, [(1, wrong), (2, right)]), items).collect()
    assert [r["doc_id"] for r in got] == [2]


def test_items_of_few_literals_and_short_items_are_found_verbatim(spark):
    items = ["What is 17 + 25 - 3 * 8?", "12 + 30 - 7 = ?", "Marie Curie", "blue whales sing"]
    held = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, f"A longer text says so here: {t} And then it goes on.") for i, t in enumerate(items)] + [(9, "What is 18 + 26 - 4 * 9? And 13 + 31 - 8 = 36")]
    got = decontamination.contaminated(frame(spark, rows), held).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(4)}
    left = decontamination.decontaminated(frame(spark, rows), held).collect()
    assert [r["doc_id"] for r in left] == [9]


def test_reparameterised_questions_are_found(spark):
    names = "Tom had 12 marbles. Tom gave 5 to Sam. Tom found 7 more. How many marbles does Tom have?"
    long = "Then Marie Curie, after 3 hours of work at home with 5 other people from the village, went away for a long walk"
    trains = "A man sees 2 trains leave the old station on the hill and waits for 2 hours until the next of them comes back to him again"
    items = spark.createDataFrame([(0, names), (1, long), (2, trains)], "item_id long, text string")
    rows = [
        (0, "Max had 31 marbles. Max gave 8 to Joe. Max found 2 more. How many marbles does Max have?"),
        (1, long.replace("Marie Curie", "Tom").replace("3", "4").replace("5", "4")),
        (2, trains.replace("2 hours", "4 hours")),
        (3, "12 marbles are here. And 5 go to Sam. He found 7 more things, which nobody has"),
    ]
    got = decontamination.contaminated(frame(spark, rows), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, 0), (1, 1), (2, 2)}


def test_languages(spark):
    rng = random.Random(2)
    pools = {"en": "the house with many things and their weather".split(), "de": "das haus mit vielen dingen und ihrem wetter".split()}
    rows = [(i, " ".join(rng.choice(pools[k]) for _ in range(20)), k) for i in range(40) for k in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learned(docs.where("doc_id < 20"))
    odd = spark.createDataFrame([(90, None, None), (91, "123 !?", None), (92, "", None), (94, "½ ³ 7", None), (93, "x" * 100_000, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identified(docs.union(odd), model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows)
    assert [got[i]["lang_pred"] for i in (90, 91, 92, 94)] == ["und"] * 4 and 0 <= got[93]["score"] <= 1
    empty = langid.identified(docs, langid.learned(docs.where("false")))
    assert {r["lang_pred"] for r in empty.collect()} == {"und"}


def test_forward_sums_all_segmentations():
    got = langid.Segmenter(["a", "b", "ab", "ba"], np.array([[0.5], [0.25], [0.125], [0.1]])).logs(["ab", "aba", "c", "a"])[:, 0]
    assert np.exp(got) == pytest.approx([0.5 * 0.25 + 0.125, 0.5 * 0.25 * 0.5 + 0.125 * 0.5 + 0.5 * 0.1, 1e-7, 0.5])


def test_maximal_segments():
    scores = [4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]
    assert [s for *_, s in toxicity.maximal_segments(scores)] == [4, 3, 7]
    assert toxicity.maximal_segments([]) == [] and toxicity.maximal_segments([-1.0]) == []


def test_toxicity(spark):
    rng = random.Random(4)
    rows = [(i, " ".join([rng.choice(WORDS) for _ in range(40)] + (["vile", "nasty"] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learned(docs, docs.where("doc_id < 300"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs.union(spark.createDataFrame([(900, None, 0)], docs.schema)), model).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows if i >= 300) and got[900] < 0.5
    blank = toxicity.learned(docs, docs.where("false"))
    assert max(r["score"] for r in toxicity.scored(docs, blank).collect()) <= 0.5


def test_empty_tables(spark):
    none = frame(spark, [])
    for result in (
        neardup.near_duplicates(none), substrings.without_repeats(none), suffixes.without_repeated_bytes(none), sharding.sharded(none, {0: 1.0}),
        mixing.mixed(none.withColumn("source", F.lit("a"))), decontamination.decontaminated(none, none.withColumnRenamed("doc_id", "item_id")),
        topk.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)),
        chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert result.count() == 0


def test_digests(spark, corpus):
    got = {r["doc_id"]: r["kept_sha256"] for r in substrings.without_repeats(frame(spark, corpus), digest=True).collect()}
    assert got == {i: hashlib.sha256(kept.encode()).hexdigest() for i, (_, _, kept) in brute_words(corpus).items()}


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    labels = brute_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 80)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i for i, (_, c) in labels.items() if i == c)
    assert kept.columns == docs.columns
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and {r["doc_id"] for r in out} <= {i for i, (_, c) in labels.items() if i == c}
    for s in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_near_dedup_decides_by_text(spark):
    import corpus_pipeline

    rng = random.Random(3)
    text = [[rng.choice(WORDS) for _ in range(200)] for _ in range(4)]
    one, two, three, four = (" ".join(t) for t in text)
    # The first and last of these are linked over the middle one only, which has no id.
    chain = [" ".join([*text[2][:200 - k], *(f"x{i}" for i in range(k))]) for k in (0, 16, 32)]
    rows = [(1, one), (2, one), (2, two), (None, one), (None, one + " x"), (None, four), (None, four + " x"), (5, chain[0]), (None, chain[1]), (7, chain[2]), (None, None), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, size int")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert {x for x in got if x[1] not in (four, four + " x")} == {(1, one), (2, two), (5, chain[0]), (None, None), (8, None), (9, "")}
    assert len(got) == 7


def test_top_k_counts_an_id_once(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0 - i / 100, 0.0]) for i in range(8)] + [(i, [0.5 - i / 100, 0.0]) for i in range(2, 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.nearest(v, F.col("vec_id") == 0, k=4).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4]
