"""Hard negatives, sentence pieces and spelling variants: brute-force versions, the library, odd input."""

import collections
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mesoflux.llm import hard_negatives, queries, sentence_pieces, spelling

# -- hard negatives -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1, 1), (64, 64, 64), (33, 70, 129), (100, 17, 35), (17, 0, 20)])
def test_strassen_is_exact_in_64_bits(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    for high in (100, 1 << 26, 1 << 62):  # sums of the last wrap around, in both ways of multiplying alike
        a, b = rng.integers(-high, high, (m, k)), rng.integers(-high, high, (k, n))
        assert (hard_negatives.strassen(a, b) == a @ b).all()


def mine_brute(rows, anchor, positives=5, negatives=10):
    vec = {i: [int(np.floor(256.0 * float(np.float32(x)))) for x in v] for i, _, v in rows}
    label = {i: c for i, c, _ in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(vec[a], vec[b]))
    out = set()
    for a in filter(anchor, vec):
        order = sorted((-dot(a, i), i) for i in vec if i != a)
        best = [(i, -s) for s, i in order if label[i] == label[a]][:positives]
        for p, ps in best:
            inside = [(i, -s) for s, i in order if label[i] != label[a] and 30 * ps <= -100 * s <= 90 * ps][:negatives]
            out.update((a, p, k + 1, i, ps, s) for k, (i, s) in enumerate(inside))
    return out


EMB = "id long, label int, vec array<float>, _i long, score string, other string, _group string"


@pytest.mark.parametrize("blocks", [(7, 13), (2048, 4096)])
def test_negatives_match_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", blocks[0])
    monkeypatch.setattr(hard_negatives, "CANDIDATE_BLOCK", blocks[1])
    rnd = random.Random(4)
    base = [[round(rnd.gauss(0, 1), 2) for _ in range(5)] for _ in range(4)]
    rows = [(i, 3 if i % 3 else rnd.randrange(6), [b + round(rnd.gauss(0, 0.7), 1) for b in rnd.choice(base)]) for i in range(-50, 250)]  # a hot label, many ties
    rows += [(1000 + i, 1, [0.5, 0.5]) for i in range(15)]  # shorter vectors
    df = spark.createDataFrame([(*r, 0, "s", "o", "g") for r in rows], EMB)
    got = [tuple(r) for r in hard_negatives.mine(df, F.col("id") % 10 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == mine_brute(rows, lambda i: i % 10 == 0)


def test_negatives_on_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, 1, [1.0]), (1, None, [1.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [nan]), (5, 1, [inf]), (6, 1, [3e38]), (0, 1, [1.0, 1.0]), (10, 1, []), (10, 1, [1.0]), (11, 1, [1.0, 1.0]), (11, 1, [1.0, 1.0]), (12, 2, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 0, "s", "o", "g") for r in rows], EMB)
    # 10 keeps its empty vector, whose scores and window are 0; 0 and 11 have the negative 12 in the window of each other, not in that of 10
    want = {(0, 11, 1, 12, 131072, 65536), (11, 0, 1, 12, 131072, 65536), (10, 0, 1, 12, 0, 0), (10, 11, 1, 12, 0, 0)}
    assert {tuple(r) for r in hard_negatives.mine(df, F.col("id") != 12).collect()} == want
    assert hard_negatives.mine(df.limit(0), F.col("id") % 2 == 0).count() == 0


# -- sentence pieces ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def path():
    return queries.public_tokenizers.path(queries.PIECES)


@pytest.fixture(scope="module")
def library(path):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def same(model, library, texts):
    ids, bounds = model.encode(pa.array(texts, pa.string()))
    want = library.encode([t or "" for t in texts], num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert model.decode(ids, bounds) == [library.decode(w) for w in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet="ab the▁ing\n\té漢😀́.,0", max_size=60)), max_size=8))
def test_pieces_equal_the_library(path, library, texts):
    same(sentence_pieces.model(path), library, texts)


def test_pieces_of_fixed_cases(path, library):
    cases = ["", None, "a", " a", "  a  b ", "\n\n", "▁a ▁▁", "a\0b", "<s>hi</s>", "<0x41>", "  " * 300 + "x" + " " * 37, "😀😀é́ ñ 漢字仮名 ﻿", "the the thethethe"]
    same(sentence_pieces.model(path), library, cases)


def test_pieces_of_long_words(path, library, monkeypatch):
    rnd = random.Random(2)
    letters = "".join(rnd.choice("etaoinshrdlu") for _ in range(6000))
    words = [letters, "a" * 9000, "ab" * 3000, " " * 5000, "the" * 1500 + "ing" * 1500]
    began = time.time()
    same(sentence_pieces.model(path), library, words)
    assert time.time() - began < 60
    monkeypatch.setattr(sentence_pieces, "LONG", 3)  # short words by linked places, too
    same(sentence_pieces.model(path), library, [w[:400] for w in words] + ["of the people by the people", None])


def test_decoding_any_ids_equals_the_library(path, library):
    rnd = random.Random(3)
    some = [0, 1, 2, 3, 10, 13, 35, 198, 228, 229, 172, 290, 264, 28705, 259]
    lists = [[rnd.choice(some) for _ in range(rnd.randrange(9))] for _ in range(4000)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    assert sentence_pieces.model(path).decode(np.array([i for x in lists for i in x]), bounds) == [library.decode(x) for x in lists]
    with pytest.raises(ValueError):
        sentence_pieces.model(path).decode(np.array([32000]), np.array([0, 1]))


def test_pieces_on_tables_and_odd_input(spark, sf, odd, empty, path, library, monkeypatch):
    clash = odd.withColumn("IDS", F.lit("x")).withColumn("Decoded", F.lit(1))
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), clash):
        for r in sentence_pieces.round_trip(df, path).collect():
            assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    assert sentence_pieces.round_trip(clash, path).columns == [*odd.columns, "ids", "decoded"]
    assert sentence_pieces.round_trip(empty, path).count() == 0
    monkeypatch.setattr(sentence_pieces, "PART_BYTES", 50)
    apart = sentence_pieces.decode(sentence_pieces.encode(odd, path), path)
    assert sorted((r.text or "", r.decoded) for r in apart.collect()) == sorted((r.text or "", r.text or "") for r in odd.collect())


# -- spelling -------------------------------------------------------------------------------------------------------------------


def spelling_brute(docs, every=97, shortest=5, least=3, factor=2):
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if every and doc_id is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= shortest and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    rows, form = {}, {}
    for w in n:
        around = sorted((-n[v], v) for v in n if v != w and near(w, v))
        form[w] = around[0][1] if around and -around[0][0] >= factor * n[w] else None
        rows[w] = len(around)
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], rows[w], form[w], n.get(form[w]), root))
    return out


@pytest.mark.parametrize("words_a_range", [5, 50_000])
def test_spelling_matches_brute_force(spark, words_a_range):
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(4, 9))) for _ in range(60)]
    docs = [(i, " ".join(rnd.choice(stems) if rnd.random() < 0.8 else rnd.choice(stems).upper() + "-x" for _ in range(rnd.randrange(60)))) for i in range(120)]
    docs += [(i, "wordsmith " * 2 ** (i % 7) + "wordsmiths wordsmitts wordsmittens aaaaaa aaaaa aaaaaaa ÀÿÀÿÀÿ×÷ " * 3) for i in range(200, 230)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for every in (None, 3, 97):
        got = [tuple(r) for r in spelling.variants(df, every, words_a_range=words_a_range).select("word", "n", "n_near", "form", "form_n", "root").collect()]
        assert len(got) == len(set(got)) and set(got) == spelling_brute(docs, every)


def test_nodes_agree_over_ranges(spark):
    """Equal beginnings have equal nodes, other beginnings have others, whatever the ranges."""
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 12))) for _ in range(300)} | {"a" * 40, "a" * 39 + "b"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for ranges in (1, 2, 9, 64):
        nodes: dict = {}
        for r in spelling.trie_nodes(df, "nodes", ranges).collect():
            assert len(r.nodes) == len(r.word) + 1
            for k, node in enumerate(r.nodes):
                assert nodes.setdefault(r.word[:k], node) == node
        assert len(set(nodes.values())) == len(nodes)


def test_spelling_on_odd_input(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(None, "colour colour colours"), (8, "x" * 3000 + " " + "x" * 2999 + "y"), (8, "x" * 3000 + " " + "x" * 2999 + "y"), (9, "x" * 3000 + " " + "x" * 2999 + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("WORD", F.lit(1)).withColumn("root", F.lit("r"))
    got = {tuple(r) for r in spelling.variants(df, 97, words_a_range=3).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == spelling_brute(rows)
    assert spelling.variants(empty, 97).count() == 0
