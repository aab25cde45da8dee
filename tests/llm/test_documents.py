"""Operators on documents: brute-force versions and odd input."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mesoflux.llm import fuzzy_lines, importance_sampling, language_id, packing, quality_rules, queries, simhash, toxicity, winnowing
from mesoflux.llm._common import materialize

# -- quality rules --------------------------------------------------------------------------------------------------------------


def quality_brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_brute_force(spark, sf, odd):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        for r in quality_rules.annotate(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_brute(r.text)
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert r.kept == (not r.base_failed and not r.failed_rules)


def test_quality_keeps_good_and_rejects_bad(spark):
    d = "/root/testdata/sf0.01"
    rows = quality_rules.annotate(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.05


def test_quality_on_an_empty_table_and_filter_plan(spark, empty, odd):
    assert quality_rules.annotate(empty).count() == 0
    assert {r.doc_id for r in quality_rules.annotate(odd).where("kept").collect()} == {1, None}  # a filter on the verdict runs as fast as none


# -- language -------------------------------------------------------------------------------------------------------------------


def test_language_code_lengths_match_a_plain_walk():
    texts = {"en": "the cat and the hat that the man had", "de": "der hund und das haus der mann hat"}
    rows = []
    for lang, t in texts.items():
        data = b" " * language_id.ORDER + t.encode()
        for order in range(language_id.ORDER + 1):
            counts = collections.Counter()
            for i in range(language_id.ORDER, len(data)):
                counts[bytes(data[i - order : i + 1][::-1])] += 1
            rows += [(lang, order, int.from_bytes(k, "little"), n) for k, n in counts.items()]
    model = language_id.build(rows)

    def plain(lang, text):
        table = collections.defaultdict(dict)
        for g, order, code, n in rows:
            if g == lang:
                b = code.to_bytes(language_id.ORDER + 1, "little")
                table[b[1 : order + 1]][b[0]] = n
        data, bits = b" " * language_id.ORDER + text.encode(), 0.0
        for i in range(language_id.ORDER, len(data)):
            for order in range(language_id.ORDER, -2, -1):
                if order < 0:
                    bits += 8
                    break
                t = table.get(bytes(data[i - order : i][::-1]))
                if not t:
                    continue
                total, kinds = sum(t.values()), len(t)
                if data[i] in t:
                    bits -= np.log2(t[data[i]] / (total + kinds))
                    break
                bits -= np.log2(kinds / (total + kinds))
        return bits

    probes = ["the man", "das haus", "zzz", "the der"]
    got = model.code_lengths([p.encode() for p in probes])
    for i, p in enumerate(probes):
        for k, lang in enumerate(model.langs):
            assert got[i, k] == pytest.approx(plain(lang, p), rel=1e-5)


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op3_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_texts_without_a_letter(spark, odd):
    docs = spark.createDataFrame([(1, "²½①"), (2, "12 _ ٣"), (3, "x²"), (4, "字")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in language_id.predict(docs, language_id.train(odd)).collect()}
    assert got == {1: ("und", False), 2: ("und", False), 3: ("en", True), 4: ("en", True)}


def test_language_learns_from_few_long_texts(spark):
    rows = [("xx", "zuqo wemi lana " * 40_000), *[("en", f"the house of the {k} hats and the rest of it") for k in range(500)]]
    model = language_id.train(spark.createDataFrame(rows, "lang string, text string"), train_bytes=60_000, all_bytes=100_000)
    assert model.langs == ["en", "xx"] and model.predict(["lana zuqo", "of the house"])[0] == ["xx", "en"]


def test_language_odd_input(spark, odd, empty):
    model = language_id.train(odd)
    got = language_id.predict(odd, model).collect()
    assert len(got) == odd.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if not r.text or not r.text.strip())
    assert all(r.lang_pred == "en" for r in got if r.text and r.text.strip())
    assert language_id.predict(empty, language_id.train(empty)).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, language_id.train(empty)).collect()} == {"und"}


# -- importance resampling --------------------------------------------------------------------------------------------------------


def test_resample_weights_and_selection(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma"] if k % 2 else ["one", "two", "three"]) for _ in range(30))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = docs.where("doc_id % 2 = 1").select("doc_id")
    got = importance_sampling.resample(docs, target, share=0.25).collect()
    assert sum(r.selected for r in got) == 50
    bar = sorted((r.gumbel_key for r in got), reverse=True)[49]
    assert all(r.selected == (r.gumbel_key >= bar) for r in got)
    assert all(r.doc_id % 2 == 1 for r in got if r.selected)
    ratios = importance_sampling.log_ratios(docs.withColumn("is_target", F.col("doc_id") % 2 == 1))
    for r, (_, text) in list(zip(sorted(got, key=lambda r: r.doc_id), rows))[:20]:
        words, _ = winnowing.word_hashes([text])
        grams = np.concatenate([words, winnowing.grams(words, 2)])
        assert r.log_weight == pytest.approx(sum(ratios[int(g % np.uint64(importance_sampling.BUCKETS))] for g in grams))


def resample_brute(rows, target, share=0.5, buckets=10_000, seed=7):
    """Counts, ratios, Gumbel keys and choice in plain Python; (doc_id, key, chosen)."""
    big = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & big
        x = (x ^ x >> 27) * 0x94D049BB133111EB & big
        return x ^ x >> 31

    def word(w):
        return mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w.encode())) + len(w.encode()) & big)

    def found(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        ws = [word(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
        return [h % buckets for h in [*ws, *[mix((a * 0xC2B2AE3D27D4EB4F + b) + 2 & big) for a, b in zip(ws, ws[1:])]]]

    grams = [found(t) for _, t in rows]
    raw, good = collections.Counter(), collections.Counter()
    for (i, _), g in zip(rows, grams):
        raw.update(g)
        good.update(g if i in target else ())
    weight = lambda b: math.log((good[b] + 1) / (good.total() + buckets)) - math.log((raw[b] + 1) / (raw.total() + buckets))
    keys = []
    for (i, t), g in zip(rows, grams):
        h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
        h = xxhash.xxh64_intdigest(i.to_bytes(8, "little"), h)
        h = xxhash.xxh64_intdigest((t or "").encode(), h) if t is not None else h
        u = ((h - (1 << 64) if h >> 63 else h) % (1 << 53) + 0.5) / (1 << 53)
        keys.append((sum(map(weight, g)) - math.log(-math.log(u)), i))
    chosen = {i for _, i in sorted(keys, reverse=True)[: math.ceil(share * len(rows))]}
    return {i: (k, i in chosen) for k, i in keys}


def test_resample_query_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    want = resample_brute(docs, target)
    got = {r.doc_id: r for r in queries.op4_resample(spark, sf).collect()}
    assert set(got) == set(want)
    for i, (key, chosen) in want.items():
        assert got[i].gumbel_key == pytest.approx(key, abs=1e-5) and got[i].selected == chosen


def test_resample_shuffles_no_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = importance_sampling.mark(docs, docs.select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@settings(max_examples=8, deadline=None)
@given(values=st.lists(st.integers(-(10**12), 10**12), min_size=1, max_size=40), k=st.integers(1, 45))
def test_kth_largest(spark, values, k):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert importance_sampling.kth_largest(df, "v", k) == sorted(values, reverse=True)[min(k, len(values)) - 1]


def test_resample_odd_input(spark, odd, empty):
    target = spark.createDataFrame([(1,), (None,), (1,)], "doc_id long")
    got = importance_sampling.resample(odd, target).collect()
    assert len(got) == odd.count() and len({r.selected for r in got if r.doc_id == 1}) == 1
    assert importance_sampling.resample(empty, target).count() == 0


# -- SimHash ----------------------------------------------------------------------------------------------------------------------


def fingerprint_brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(fps, ids, radius=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    low = {}
    for i in range(len(fps)):
        low.setdefault(root(i), []).append(ids[i])
    return [min((x for x in low[root(i)] if x is not None), default=None) for i in range(len(fps))]


def check_components(spark, rows, got):
    key = lambda p: (p[0] is None, p[0] or 0, p[1])
    fps = [fingerprint_brute(t) for _, t in rows]
    want = collections.Counter((i, f, c) for (i, _), f, c in zip(rows, fps, components_brute(fps, [i for i, _ in rows])))
    have = collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got)
    assert want == have, key


def test_simhash_matches_brute_force(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_components(spark, rows, simhash.near_duplicates(docs).collect())
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check_components(spark, rows, simhash.near_duplicates(odd).collect())


def test_simhash_splits_large_buckets_without_losing_links(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 160:
        f = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.randint(1, 3)):
            f ^= 1 << b
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(40)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from mesoflux.llm._common import connected_components

    for chunk in (16, 2048):
        found = {r.node: r.component for r in connected_components(simhash.links(df, chunk=chunk), "a", "b").collect()}
        want = components_brute(sorted(fps), signed)
        groups = collections.defaultdict(set)
        for f, c in zip(signed, want):
            groups[c].add(f)
        for members in groups.values():
            assert len({found.get(f, f) for f in members}) == 1
        assert len({found.get(f, f) for f in signed}) == len(groups)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=70), st.integers(0, 3), st.data())
def test_carry_save_counters_hold_exact_distances(values, radius, data):
    near = [v ^ (1 << data.draw(st.integers(0, 63))) for v in values[:5]]
    fps = np.array(values + near, np.uint64)
    q, lane = simhash._within(simhash._planes(fps), fps, radius)
    have = {(a, b) for a, b in zip(q.tolist(), lane.tolist()) if b < len(fps)}
    assert have == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}


def test_simhash_keep_one(spark, odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 6, 7] and None not in ids
    assert simhash.keep_one(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "x y z w v")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one(nulls).collect()) == ["a b c d", "x y z w v"]


def test_near_dedup_stage_links_word_shingles_at_080(spark, sf):
    import corpus_pipeline

    rng, rows = random.Random(9), []
    voc = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(5000)]
    for k in range(60):
        words = rng.choices(voc, k=200)
        other = list(words)
        for j in (30, 90, 150):
            other[j] = rng.choice(voc)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()}
    assert all(2 * k in kept for k in range(60)) and sum(2 * k + 1 not in kept for k in range(60)) >= 57, len(kept)


# -- winnowing --------------------------------------------------------------------------------------------------------------------


def test_simhash_keep_one_of_a_shared_id_in_two_components(spark):
    rows = [(1, "a b c d e f g h"), (1, "p q r s t u v w x y"), (2, "a b c d e f g h"), (None, "k l m n o"), (None, "z y x w v u")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "k l m n o"), (0, "z y x w v u"), (1, "a b c d e f g h"), (1, "p q r s t u v w x y")]


def contamination_brute(text, items):
    low = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = low(text), set(), set()
    for item_id, t in items:
        iw = low(t)
        if not iw:
            continue
        n = min(13, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item_id))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("bound", [16_000_000, 0])
def test_winnowing_matches_brute_force(spark, sf, bound):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").limit(120), spark.read.parquet(f"{sf}/benchmark.parquet")
    rng = random.Random(1)
    words = [w for r in bench.collect() for w in r.text.split()]
    odd = [(9001, " ".join(rng.choices(words, k=50)) + " " + bench.first().text.upper() + " tail"), (9002, None), (9003, ""), (9004, "Alpha beta!"), (9005, "x alpha, BETA y " * 9), (9001, "alpha beta")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    items = bench.select("item_id", "text").unionByName(spark.createDataFrame([(700, "alpha beta"), (700, "alpha beta"), (701, None), (702, " .. "), (703, "one")], "item_id long, text string"))
    known = [(r.item_id, r.text) for r in items.collect()]
    got = winnowing.judge(winnowing.spans(docs, items, broadcast_chars=bound)).collect()
    assert len(got) == docs.count()
    for r in got:
        n, h, ids = contamination_brute(r.text, known)
        assert (r.n_words, r.n_hit, list(r["items"])) == (n, h, ids)
        assert r.contaminated == (h > 0 and 20 * h >= n)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=13, max_size=40), st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30), st.data())
def test_winnowing_finds_every_shared_span(item, before, after, data):
    start = data.draw(st.integers(0, len(item) - 13))
    doc = before + item[start : start + 13] + after
    items = winnowing.Items.build([(1, " ".join(item))])
    words, _ = winnowing.word_hashes([" ".join(doc)])
    mask, _ = items.hits(words)
    n, h, ids = contamination_brute(" ".join(doc), [(1, " ".join(item))])
    assert int(mask.sum()) == h and h >= 13


def test_winnowing_of_repeated_words_stays_linear():
    items = winnowing.Items.build([(1, "a " * 500), (2, "b a " * 40)])
    words, _ = winnowing.word_hashes(["a " * 20_000 + "b a " * 20])
    began = time.time()
    mask, found = items.hits(words)
    assert time.time() - began < 20 and mask.all() and found == {0, 1}


def test_winnowing_odd_input(spark, odd, empty):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and it was a good day for all of them", "x")], "item_id long, text string, items string")
    got = winnowing.spans(odd, bench).collect()
    assert len(got) == odd.count() and sum(r.n_hit == 16 for r in got) == 3
    assert winnowing.spans(empty, bench).count() == 0
    assert winnowing.spans(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    clean = winnowing.decontaminate(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 3


# -- toxicity ---------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chars(spark):
    return toxicity.char_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize(("raw", "plain"), [("d1sgust1ng", "disgusting"), ("w0rthl3ss", "worthless"), ("tr@sh", "trash"), ("l.o.s.e.r", "loser"), ("stuuuupid", "stupid"), ("$tupid", "stupid"), ("plain", "plain"), ("2024", "2024"), ("(word),", "word")])
def test_deobfuscation(chars, raw, plain):
    assert toxicity.Restorer(chars).token(raw) == plain


def test_deobfuscation_of_spaced_letters(chars):
    assert "idiot" in toxicity.Restorer(chars).words("what an i d i o t here")
    assert toxicity.Restorer(chars).text("an i d i o t") == "an idiot"


def test_viterbi_matches_enumeration(chars):
    import itertools

    lattice = toxicity.lattice_of("s1l1y!")
    best = {}
    for parts in itertools.product(*lattice, [(" ", 0.0)]):
        a = b = 0
        cost, out = 0.0, "".join(t for t, _ in parts)
        for text, price in parts:
            cost += price
            for ch in text:
                s = toxicity._symbol(ch)
                cost += chars.cost[(a * toxicity._CLASSES + b) * toxicity._CLASSES + s]
                a, b = b, s
        best[out.strip()] = min(cost, best.get(out.strip(), 1e9))
    assert chars.decode(lattice) == min(best, key=best.get)


def test_toxicity_learns_and_generalises_to_obfuscation(spark):
    rng = random.Random(2)
    clean = ["the", "and", "house", "tree", "river", "stone", "walk", "green", "light", "paper", "window", "morning"]
    rows, labels = [], []
    for k in range(900):
        words = [rng.choice(clean) + rng.choice(["", "s", "ed"]) for _ in range(40)]
        if k % 5 == 0:
            words[rng.randrange(40)] = rng.choice(["grumble", "snarkface"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks.where("doc_id < 600"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[k].predicted == int(k % 5 == 0) for k in range(600, 900))
    probe = spark.createDataFrame([(1, "a gr9mble no"), (2, "such a g r u m b l e"), (3, "snarkf@ce walks"), (4, "the river"), (5, None), (6, "")], "doc_id long, text string")
    res = {r.doc_id: r.predicted for r in toxicity.score(probe, model).collect()}
    assert (res[2], res[3], res[4], res[5], res[6]) == (1, 1, 0, 0, 0)


def test_deobfuscation_of_spaced_leet_and_blanks(chars):
    for raw in ("an i d 1 0 t here", "an i  d  i  o  t here", "an 1 d i o t here"):
        assert "idiot" in toxicity.Restorer(chars).words(raw), raw
    assert toxicity.Restorer(chars).guesses("1 2 3 4 5 and 2 + 2") == set()


def test_character_counts_match_a_plain_count(spark):
    texts = ["Ñandú, übÉr ça", "漢字 x", None, ""]
    got = {r.code: r.n for r in toxicity.char_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()}
    want, n = collections.Counter(), toxicity._CLASSES
    s = [toxicity._symbol(c) for c in "  ".join([*[(t or "").lower() for t in texts], ""])]
    for a, b, c in zip(s, s[1:], s[2:]):
        want[(a * n + b) * n + c] += 1
    assert got == want and len({toxicity._symbol(c) for c in "nñuüeéz漢"}) == 8


def test_toxicity_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op9_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.toxic == 0], [r.score for r in rows if r.toxic == 1]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    caught = sum(r.predicted for r in rows if r.toxic == 1) / len(bad)
    # the labels are partly noise: what has no toxic word in the rows to learn from can't be found
    assert len(bad) >= 5 and auc > 0.85 and caught >= 0.7 and sum(g >= toxicity.THRESHOLD for g in good) <= 0.02 * len(good), (auc, caught)


def test_toxicity_odd_input(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0), (99, 1, 0)], "doc_id long, toxic int, score int")
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0


# -- packing ----------------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, sf, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    special = spark.createDataFrame([(801, "a <|endoftext|> b's don't"), (802, "<|ENDOFTEXT|>x"), (803, "à la carte. É!"), (804, "İ ΑΣ x́.y")], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id > 10").unionByName(odd.select("doc_id", "text").where("doc_id IS NOT NULL AND doc_id <> 1")).unionByName(special)
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id > 10 OR doc_id IN (2, 3, 4, 5, 6, 7)").collect()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = packing.pack_documents(docs, queries.tokenizer_path(), shard_pieces=50).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in texts.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
def test_segment_tree_finds_the_tightest_window(lengths):
    fit, left = packing.BestFit(64), []
    for n in sorted(lengths, reverse=True):
        rooms = [r for r in left if r >= n]
        which, offset, opened = fit.place(n, len(left))
        if opened:
            assert not rooms
            left.append(64 - n)
        else:
            assert left[which] == min(rooms) and offset == 64 - left[which]
            left[which] -= n


def test_packing_odd_input(spark, odd, empty):
    got = packing.pack_documents(odd, queries.tokenizer_path()).collect()
    assert sum(r.start == 0 for r in got) == odd.count()
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0


# -- fuzzy lines ------------------------------------------------------------------------------------------------------------------


def lines_brute(rows, threshold=0.8):
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    texts = sorted({norm(x) for _, t in rows if t is not None for x in t.split("\n") if norm(x)})
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in texts]
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                parent[root(texts[i])] = root(texts[j])
    keeper = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if norm(x) in parent:
                c = root(norm(x))
                keeper[c] = min(keeper.get(c, i), i)
    out = {}
    for i, t in rows:
        if t is None:
            out[i] = None
            continue
        seen, kept = set(), []
        for x in t.split("\n"):
            if norm(x) in parent:
                c = root(norm(x))
                if keeper[c] != i or c in seen:
                    continue
                seen.add(c)
            kept.append(x)
        out[i] = "\n".join(kept)
    return out


def test_fuzzy_lines_match_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = "It was a long and winding line of prose that many documents happen to share with one another, more or less."
    rows += [(5000 + k, f"Heading {k} of its own kind and nature\n{base.replace('winding', f'winding{k}')}\nTail") for k in range(8)]
    want = lines_brute(rows)
    got = {r.doc_id: r.text for r in fuzzy_lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = [i for i in want if want[i] != got[i]]
    assert len(wrong) <= 0.01 * len(rows), wrong  # bands miss a few links by design
    count = lambda t: collections.Counter((t or "").split("\n"))
    assert all(count(want[i]) <= count(got[i]) for i in want)  # but no line goes that should stay
    assert all(base[:20] not in got[5000 + k] for k in range(1, 8)) and base[:20] in got[5000]


def test_fuzzy_lines_recall_of_the_bands(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(rng.choice([8, 20, 45]))]
        other = list(words)
        for j in rng.sample(range(len(words)), max(1, len(words) // 20)):
            other[j] = "".join(rng.choices("klmnop", k=len(words[j])))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for _, t in rows]
    close = [k for k in range(300) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])]
    got = {r.doc_id: r.n_dropped for r in fuzzy_lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(close) > 100 and sum(got[2 * k + 1] == 1 for k in close) / len(close) >= 0.95
    assert all(got[2 * k + 1] == 0 for k in range(300) if k not in close)


def test_fuzzy_lines_link_pairs_within_a_hot_band(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for k in range(150):  # the passage is common to all lines, a tail to two of them
        tail = [word() for _ in range(20)]
        rows += [(2 * k, f"{passage} {' '.join(tail)}"), (2 * k + 1, f"{passage} {' '.join(tail[:-1])} {word()}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = docs.select("doc_id", F.lower("text").alias("norm"), F.xxhash64(F.lower("text")).alias("h"))
    found = materialize(lines.select(F.col("h").alias("line_hash"), F.array(F.lit(1).cast("long")).alias("keys")), "hot-band")  # one band holds them all
    ids = {r.h: r.doc_id for r in lines.collect()}
    pairs = {tuple(sorted((ids[r.x], ids[r.y]))) for r in fuzzy_lines.links(lines.select("h", "norm"), found).collect()}
    assert pairs == {(2 * k, 2 * k + 1) for k in range(150)}
    got = {r.doc_id: r.n_dropped for r in fuzzy_lines.deduplicate(docs).collect()}
    assert sum(got[2 * k + 1] for k in range(150)) >= 0.95 * 150 and not any(got[2 * k] for k in range(150))


@pytest.mark.parametrize("spaces", [True, False])
def test_fuzzy_lines_recall_of_scattered_letters(spark, spaces):
    rng = random.Random(11)
    letters = "abcdefghij   " if spaces else "กขคงจฉชซญดตถทธนบปผพ"
    rows = []
    for k in range(2000):
        n = rng.choice([60, 100, 200, 400])
        line = list("x" + "".join(rng.choices(letters, k=n - 2)) + "x")
        other = list(line)
        for j in rng.sample(range(5, n - 5), n // 46):
            other[j] = "z" if spaces else "ฮ"
        rows.append(("".join(line), "".join(other)))
    sets = [[{t[i : i + 5] for i in range(len(t) - 4)} for t in r] for r in rows]
    close = [r for r, (a, b) in zip(rows, sets) if 0.8 * len(a | b) <= len(a & b) <= 0.85 * len(a | b)]
    keys = fuzzy_lines.band_keys
    met = spark.createDataFrame(close, "a string, b string").where(F.arrays_overlap(keys(F.col("a")), keys(F.col("b")))).count()
    assert len(close) > 400 and met >= 0.95 * len(close), (met, len(close))


def test_similar_lines_of_very_unlike_lengths(spark):
    lines = spark.createDataFrame([("ab cd ef " * 4,), ("ab cd ef " * 40,)], "norm string").withColumn("h", F.xxhash64("norm"))
    x, y = sorted(r.h for r in lines.collect())
    assert fuzzy_lines.similar(lines, spark.createDataFrame([(x, y)], "x long, y long")).count() == 1


def edited(rng, line, letters, n):
    out = list(line)
    for j in rng.sample(range(5, len(out) - 5), n):
        out[j] = letters
    return "".join(out)


def jaccard(a, b, n=5):
    x, y = ({t[i : i + n] for i in range(len(t) - n + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_fuzzy_lines_recall_of_short_lines_and_in_hot_bands(spark):
    rng = random.Random(3)
    rows, close = [], {}
    passage = "".join(rng.choices("abcdefghij  ", k=220))
    for k in range(1400):
        if k < 700:  # lines of under 80 characters, at the threshold
            line, edits = "".join(rng.choices("abcdefghijklm  ", k=rng.randint(60, 79))), 1
        else:  # 1,400 lines that share a passage, two by two similar
            line, edits = passage + "".join(rng.choices("klmnopqrst  ", k=140)), rng.randint(6, 8)
        other = edited(rng, line, "z", edits)
        close[k] = 0.8 <= jaccard(line.strip(), other.strip()) <= 0.86
        rows += [(2 * k, line), (2 * k + 1, other)]
    got = {r.doc_id: r.n_dropped for r in fuzzy_lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for low, high in ((0, 700), (700, 1400)):
        some = [k for k in range(low, high) if close[k]]
        assert len(some) > 200 and sum(got[2 * k] + got[2 * k + 1] >= 1 for k in some) >= 0.95 * len(some)


def test_short_lines_are_grouped_by_equality(spark):
    rows = [(1, "Read more\nabc\nalpha"), (2, "read more \nabd\nbeta"), (3, "\tRead more\nabc\n  \n\n  ")]
    got = {r.doc_id: r.text for r in fuzzy_lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "Read more\nabc\nalpha", 2: "abd\nbeta", 3: "  \n\n  "}


def test_fuzzy_lines_odd_input(spark, odd, empty):
    got = fuzzy_lines.deduplicate(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    rows = got.collect()
    assert len(rows) == odd.count()
    assert [r.text for r in rows if r.doc_id == 1] == ["the cat sat on the mat and it was a good day for all of them"] * 2
    assert sorted((r.text is None, r.text) for r in rows if r.doc_id is None) == [(False, ""), (True, None)]
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None and r.n_dropped)
    assert fuzzy_lines.deduplicate(empty).count() == 0


def test_fuzzy_lines_run_no_python(spark, odd):
    plan = fuzzy_lines.deduplicate(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
