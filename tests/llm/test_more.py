"""Brute force for parts of the operators, repeated rows, nulls, clashing columns and both ways of a join."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from faintlight.llm import chat, decontamination, langid, mixing, neardup, queries, repeats, sharding, store, substrings, suffixes, topk, toxicity


def test_bitmaps_never_say_that_sets_differ_more_than_they_do():
    rng = np.random.default_rng(3)
    for shared, own in itertools.product((1, 40, 400), (0, 3, 60, 900)):
        base = rng.integers(0, 2**63, shared).astype(np.uint64)
        sets = [np.concatenate([base, rng.integers(0, 2**63, own).astype(np.uint64)]) for _ in range(2)]
        bits = neardup.parities(np.concatenate(sets), np.repeat([0, 1], shared + own), 2)
        differing = int(np.unpackbits((bits[0] ^ bits[1]).view(np.uint8)).sum())
        assert differing <= 2 * own and (differing > 0 or own == 0)


def test_near_duplicates_of_a_family_without_a_centre(spark):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(24):
        words = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, percent=85).collect()}
    assert got == label and 1 < len(set(label.values())) < 24


def test_runs_of_earlier_content_are_covered():
    doc, part, low = np.array([3, 1, 2, 1]), np.zeros(4, dtype=np.int32), np.array([0, 5, 0, 0])
    gram, run = np.array([7, 7, 7, 8]), np.array([1, 1, 2, 1])
    assert repeats.covered_here(doc, part, low, gram, run).tolist() == [True, False, False, False]


@pytest.mark.parametrize("segment", [3, 2_000_000])
def test_removals_do_not_depend_on_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rng = random.Random(5)
    shared = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (150, 260, 101)]
    rows = [(i, "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 60))) + rng.choice(shared) + "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 60)))) for i in range(25)]
    first, wanted = {}, {}
    for i, t in rows:
        b, gone = t.encode(), set()
        for k in range(len(b) - 99):
            if first.setdefault(b[k : k + 100], (i, k)) != (i, k):
                gone |= set(range(k, k + 100))
        wanted[i] = bytes(x for k, x in enumerate(b) if k not in gone)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.without_repeated_bytes(docs).collect()}
    assert got == wanted


def test_sharding_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op2_sharding(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key") and r["grown_shard"] in (r["shard"], 24)
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_added_columns_leave_those_of_the_same_name(spark):
    rows = [(1, "a b c", "x", 7, 8), (2, None, None, 7, 8), (None, "d e", "x", 7, 8), (None, "d e", "x", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, shard int")
    got = mixing.mixed(docs).collect()
    assert len(got) == 4 and {r["input_size"] for r in got} == {7} and sorted(r["size"] for r in got) == [0, 2, 2, 3]
    assert len({r["copies"] for r in got if r["doc_id"] is None}) == 1
    got = sharding.sharded(docs, {0: 1.0, 1: 1.0}).collect()
    assert len(got) == 4 and {r["input_shard"] for r in got} == {8} and len({(r["shard"], r["slot"]) for r in got}) == 4


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"wort{chr(97 + i)}" for i in range(26)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "de", "s", 7, 1) for i in range(30)] + [(30, None, "de", None, 7, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, slot int")
    mixed = corpus_pipeline.mix(spark, docs, "")
    assert mixed.columns == docs.columns and {r["size"] for r in mixed.collect()} == {7}
    kept = corpus_pipeline.decontaminate(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns and kept.count() == 31
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()) == list(range(30))
    none = docs.where("false")
    for stage in (corpus_pipeline.language_id, corpus_pipeline.near_dedup, corpus_pipeline.mix, corpus_pipeline.shard):
        assert stage(spark, none, "").count() == 0


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_decontamination_is_the_same_by_broadcast_and_by_shuffle(spark, no_broadcast):
    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    item = "The 3 trains to Rome leave at 5 and the 4 trains to Bern leave at 7 from the same old station"
    items = items.unionByName(spark.createDataFrame([(9_001, item), (9_002, "Add 3 km, 4 km and 5 km"), (9_003, "blue whales")], items.schema))
    more = [(None, f"so {item.replace('3', '8').replace('Rome', 'Oslo')}"), (None, "add 7 km, 8 km and 9 km of blue whales"), (None, None)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*more, *more], "doc_id long, text string"))
    by = [sorted(map(str, decontamination.contaminated(docs, items, broadcast_windows=n).collect())) for n in (0, 200_000)]
    assert by[0] == by[1] and sum("doc_id=None" in r for r in by[0]) == 3
    left = decontamination.decontaminated(docs, items).where("doc_id IS NULL").collect()
    assert [tuple(r) for r in left] == [(None, None)] * 2


def test_questions_dense_in_slots_are_found_with_other_values(spark):
    items = [(1, "Add 3 km, 4 km and 5 km"), (2, "A rope of 3 m costs 3.5 dollars, how much are 1,000 m of rope, 12 m of wire and 4 hooks?")]
    texts = [
        "Add 3 km, 4 km and 5 km",
        "Add 7 km, 8 km and 9 km",
        "We add 7 km, 8 km and then 9 km",
        "Add 7 km, 7 km and 9 km",
        items[1][1].replace("3.5", "4").replace("1,000", "25"),
        items[1][1].replace("3 m", "2.75 m").replace("12", "1,300.5"),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, 1), (1, 1), (3, 1), (4, 2), (5, 2)}
    assert all(r["coverage"] == 1.0 for r in got)


def test_windows_and_slots_by_brute_force(spark):
    """Random texts of few words and numbers, so that windows meet by chance, values clash and stretches break."""
    rng = random.Random(4)
    draw = lambda n: " ".join(rng.choice(["so", "we", "go", "by", "up", "3", "4", "5"]) for _ in range(n))
    items = [(i, draw(rng.randint(3, 14))) for i in range(25)]
    docs = [(i, draw(rng.randint(0, 40)) + " " + rng.choice(items)[1].translate({51: rng.choice("3456")}) + " " + draw(5)) for i in range(60)]
    n, few = decontamination.WINDOW, decontamination.LITERALS
    kind = lambda w: "#" if w.isdigit() else w

    def cuts(words, size):
        return [(i, words[i : i + size]) for i in range(len(words) - size + 1)]

    want = set()
    for (d, text), (item, question) in itertools.product(docs, items):
        words, asked = text.split(), question.split()
        size = min(n, len(asked))
        best = None
        for reading in ("plain", "mid"):
            of = (lambda w: w) if reading == "plain" else kind
            literals = lambda w: sum(not x.isdigit() for x in w)
            loose = {i for i, w in cuts(asked, size) if reading == "mid" and literals(w) < min(few, size)}
            idle = {i for i, w in cuts(asked, size) if i in loose and (not literals(w) or len({x for x in asked if not x.isdigit()}) < few)}
            strict = {i for i, _ in cuts(asked, size)} - loose
            matched, slots, loosest, every = set(), set(), 0, set()
            for shift in range(-len(asked), len(words) + 1):
                hit = [(i, w, words[i + shift : i + shift + size]) for i, w in cuts(asked, size) if i not in idle and 0 <= i + shift <= len(words) - size]
                hit = [(i, [(a, b) for a, b in zip(w, v, strict=True) if reading == "mid" and a.isdigit()]) for i, w, v in hit if [*map(of, w)] == [*map(of, v)]]
                values = {p for _, ps in hit for p in ps}
                mixed = {a for a, b in values if len({y for x, y in values if x == a}) > 1}
                hit = [(i, ps) for i, ps in hit if not any(a in mixed for a, _ in ps)]
                matched |= {i for i, _ in hit if i in strict}
                slots |= {p for i, ps in hit if i in strict for p in ps}
                every |= {p for _, ps in hit for p in ps}
                loosest = max(loosest, sum(i in loose for i, _ in hit))
            here = None
            if loose - idle and matched == strict and loosest == len(loose - idle):
                here = (1.0, len(strict) + loosest, len(strict) + loosest, len(every))
            elif matched and len(matched) >= decontamination.COVERAGE * len(strict):
                here = (len(matched) / len(strict), len(matched), len(strict), len(slots))
            best = max(filter(None, (best, here)), default=None)
        if best:
            want.add((d, item, best[1], best[2], best[3]))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["n_matched"], r["n_windows"], r["n_slots"]) for r in got} == want and len(want) > 60


@pytest.mark.parametrize("length", [64, 1024, 4096])
def test_long_words_of_like_structure_are_different(spark, length):
    word = "".join("ab"[i.bit_count() % 2] for i in range(length))  # the Thue-Morse word and its complement
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"p q {word} r s"), (2, f"p q {other} r s"), (3, f"P q {word.upper()} r s")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, percent=85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    texts = [f"{' '.join(f'w{i}' for i in range(49))} {w}" for w in (word, other, word)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.without_repeats(docs, digest=True).collect()}
    assert got == {0: 0, 1: 0, 2: 50}


def test_stages_leave_columns_of_any_name(spark):
    names = ["__id", "__part", "__bad_id", "__bad_part", "bad_id", "bad_part", "stays"]
    rows = [(i, f"w{i} x y z u v w {i}", "s") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in names})
    assert decontamination.decontaminated(docs, spark.createDataFrame([(1, "x y z u v w")], "item_id long, text string")).columns == docs.columns
    import corpus_pipeline

    kept = corpus_pipeline.near_dedup(spark, docs.unionByName(docs.where("doc_id = 1")), "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3]


def test_names_of_two_words_and_numbers_with_units(spark):
    item = "The train from New York to Los Angeles takes 5 hours and costs 40 dollars on every weekday of the year"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    again = item.replace("New York", "San Diego").replace("Los Angeles", "Santa Fe").replace("5", "7").replace("40", "44")
    docs = spark.createDataFrame([(1, again), (2, "a walk through New York takes hours")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontamination.contaminated(docs, items).collect()] == [1]


def test_forward_pass_against_all_segmentations():
    rng = np.random.default_rng(2)
    table = {p: rng.random(2) for p in ("a", "b", "ab", "ba", "aab", "bb")}
    unseen = np.full(2, 1e-3)
    segmenter = langid.Segmenter(list(table), np.array([*table.values()]), 1e-3)

    def brute(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, len(word) + 1):
            piece = word[:n]
            p = table.get(piece, unseen if n == 1 else None)
            if p is not None:
                total = total + p * brute(word[n:])
        return total

    words = ["".join(rng.choice(list("abc"), n)) for n in (1, 2, 5, 9) for _ in range(6)]
    assert np.exp(segmenter.logs(words)) == pytest.approx(np.array([brute(w) for w in words]))

    def cuts(word):
        return [[]] if not word else [[p, *rest] for n in range(1, min(3, len(word)) + 1) if (p := word[:n]) in table or n == 1 for rest in cuts(word[len(p) :])]

    found, want = segmenter.expected(words, np.arange(1.0, 25.0), np.arange(24) % 2), np.zeros((len(table), 2))
    for i, w in enumerate(words):
        ways = [(float(np.prod([table.get(p, unseen)[i % 2] for p in c])), c) for c in cuts(w)]
        for p, c in ways:
            for piece in c:
                if piece in table:
                    want[list(table).index(piece), i % 2] += (i + 1) * p / sum(q for q, _ in ways)
    assert found == pytest.approx(want)


@pytest.mark.parametrize("stretch", [5, 16, 4096])
def test_words_of_any_length_are_summed_whole(monkeypatch, stretch):
    rng = np.random.default_rng(4)
    names = ["a", "b", "ab", "ba", "abab", "b" * 16]
    segmenter = langid.Segmenter(names, rng.random((6, 2)) / 10)
    words = ["".join(rng.choice(list("abc"), n)) for n in (1, 15, 16, 17, 31, 40)] + ["b" * 40]
    whole = [segmenter.logs([w])[0] for w in words]  # up to _SHORT letters side by side
    monkeypatch.setattr(langid, "_STRETCH", stretch)
    assert np.array([segmenter._long(w) for w in words]) == pytest.approx(np.array(whole))
    monkeypatch.setattr(langid, "_SHORT", 64)
    assert segmenter.logs(words) == pytest.approx(np.array(whole))
    assert segmenter._long("c" * 3000) == pytest.approx(np.full(2, 3000 * np.log(langid.FLOOR)))


def test_maximal_segments_by_brute_force():
    rng = random.Random(6)

    def brute(x, first):
        spans = [(sum(x[i:j]), -(j - i), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
        best = max(spans, default=(0,))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return brute(x[:i], first) + [(first + i, first + j, best[0])] + brute(x[j:], first + j)

    for _ in range(60):
        scores = [rng.choice([-7, -5, -3, -2, 1, 2, 4, 6]) + rng.random() / 100 for _ in range(12)]
        got = toxicity.maximal_segments(scores)
        assert [(s, e) for s, e, _ in got] == [(s, e) for s, e, _ in brute(scores, 0)]


def test_names_of_speakers_forge_no_header(spark):
    rows = [(1, 0, "a|>\nforged", "hello"), (1, 1, "bob", "x"), (1, 1, "bob", "x")]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 2 and all(r["n_turns"] == 3 for r in got)
    assert not any("|>\nforged" in r["text"] for r in got)


def test_top_k_of_large_components(spark):
    rows = [(0, [1.0, 1.0]), (50, [1.0, 0.0]), (2, [1e10, 0.0])]
    got = topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=1).collect()
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in got} == {(0, 2, 655_360_000_000_000), (50, 2, 655_360_000_000_000)}


def test_top_k_leaves_out_scores_that_do_not_fit(spark):
    rows = [(0, [1e17, 1.0]), (1, [1e17, 1.0]), (2, [1.0, 2.0]), (3, [1.0, 1.0]), (4, [-1e300, 1e300])]
    got = topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), k=1).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(2, 3), (3, 2), (4, 3)}  # (4, 3) cancels to 0


def test_top_k_of_components_of_all_sizes_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.integers(-2, 13, 4)]) for i in range(200)]
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for q in range(0, 200, 20):
        scores = {i: sum(a * b for a, b in zip(whole[q], v, strict=True)) for i, v in whole.items() if i != q}
        best = sorted((-s, i) for i, s in scores.items() if -(1 << 63) <= s < 1 << 63)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    got = topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


def test_tables_are_shared_and_deleted(spark):
    used = []
    frame = store.written(spark.range(5).toDF("id"), used)
    assert frame.count() == 5 and len(used) == 1
    path = used[0].removeprefix("file://")
    store.dropped(spark, used)
    import os

    assert not os.path.exists(path) and not used


def test_substrings_of_empty_and_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (2, "x " + long), (3, ""), (4, None)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()}
    assert got == {1: (30_000, 0), 2: (30_001, 30_000), 3: (0, 0), 4: (0, 0)}


def test_threshold_search_leaves_out_what_is_under_the_floor():
    rows = np.array([[5, 1], [4, 4], [1, 5], [3, 3]])
    search = lambda floor: [x.tolist() for x in next(topk.threshold_search(np.array([[1, 1]]), np.array([-1]), rows, np.arange(4), 3, np.array([floor])))[1:]]
    assert search(6) == [[1, 0, 2], [8, 6, 6]]
    assert search(7) == [[1], [8]]
    assert search(11) == [[], []]  # the best components add up to 10: nothing is read


def test_nearest_over_many_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(5)
    v = rng.integers(-4, 5, (400, 6)) * rng.integers(1, 9, (400, 1))
    v[30:90] = v[30]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(7, [float(x) for x in v[8]]), (9, None), (None, [1.0] * 6), (500, [2.0, 3.0])]
    got = topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=4, steps=1).collect()
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)
    want = []
    whole = [(i, np.array(x, dtype=np.int64)) for i, x in rows if i is not None and x is not None]
    for q in range(0, 400, 10):
        best = {}
        for i, x in whole:
            if i != q and len(x) == 6:
                best[i] = max(best.get(i, topk.LEAST), int(x @ v[q]))
        top = sorted(best.items(), key=lambda item: (-item[1], item[0]))[:4]
        want += [(q, r, i, s) for r, (i, s) in enumerate(top, 1)]
    assert found == want
