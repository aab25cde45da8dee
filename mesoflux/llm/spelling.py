"""Spelling variants by a dictionary of pairs of trie nodes.

1. ``count_words``: runs of letters of all texts, counted in the JVM; partial counts are combined before the shuffle.
2. ``trie_nodes``: words are sorted and dealt over ranges; in a range, the nodes of the trie of all words are numbered by one walk along the
   sorted words, which share their stack of nodes as far as neighbours agree. Nodes that words on both sides of a range's edge share are
   named by the edge, so that all ranges agree on them. The words read backwards give the nodes of the suffixes.
3. ``pair_dictionary``: a word with position i skipped is the pair (node of what is before, node of what is after); a word cut at i, as if a
   letter were inserted there, is a pair too. Two words of equal length with a common skipped pair differ by one replaced letter, and a
   skipped pair that equals a cut one is an inserted letter. A run of equal letters is skipped once for inserted letters. So every two near
   words meet in exactly one pair of integers; a pair holds one cut word at most and, of skipped ones, one for each letter of the alphabet.
4. ``neighbours``: each pair is reduced to its count and its two best words, each word gathers from its pairs; no pairs of words are made.
   ``roots``: pointer doubling along the forms.

Odd input: null texts have no words. A null document id never changes a run. Repeated rows count each time. Texts and words may be of any
length. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, discard, extended, materialize, rekey, scratch_path

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Words in a range of the sorted dictionary.
RANGE = 50_000
#: Nodes are numbered range * 2^40 + place; edges name theirs range * 2^40 + 2^39 + depth.
_BASE, _EDGE = 1 << 40, 1 << 39


def noisy(doc_id: Column, run: Column, every: int | None) -> Column:
    """``run`` without one letter where ``every`` divides the crc32 of "<doc_id>:<run>"; None: as it is."""
    if not every:
        return run
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % every == 0, cut).otherwise(run)


def count_words(docs: DataFrame, every: int | None = None, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points and ``least`` occurrences."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.where(F.char_length("run") >= shortest).select(noisy(F.col("doc_id"), F.col("run"), every).alias("word")).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _shared(a: str, b: str) -> int:
    """Letters that two words have in common at the beginning."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _edge_names(edges: list[tuple[str, str]]) -> list[tuple[list[int], str, list[int]]]:
    """For each range (first word, last word): nodes that its first word shares with the range before; the beginning of the last word that the next range shares, and its nodes."""
    before: list[list[int]] = [[]]
    for p in range(1, len(edges)):
        depth = _shared(edges[p - 1][1], edges[p][0])
        through = before[p - 1][: _shared(edges[p - 1][0], edges[p - 1][1])]  # nodes that run through the whole range p - 1
        before.append([*through[:depth], *(((p - 1) * _BASE) + _EDGE + d for d in range(len(through[:depth]) + 1, depth + 1))])
    after = [*before[1:], []]
    return [(b, last[: len(a)], a) for b, a, (_, last) in zip(before, after, edges)]


def trie_nodes(words: DataFrame, name: str, ranges: int) -> DataFrame:
    """``words`` (word, ...) with ``name``: the numbers of the trie nodes of all beginnings of the word, the root (0) first.

    The first and the last word of each range pass through the driver, no others.
    """
    spark, path = words.sparkSession, scratch_path(words.sparkSession, "trie-ranges")
    dealt = materialize(words.repartitionByRange(ranges, "word").withColumn("_part", F.spark_partition_id()), "trie-ranges", path)
    found = sorted(tuple(r) for r in dealt.groupBy("_part").agg(F.min("word"), F.max("word")).collect())
    place = {part: (k, names) for k, (part, names) in enumerate(zip([r[0] for r in found], _edge_names([r[1:] for r in found])))}

    def walk(batches):
        part, last, stack, made, edge = None, "", [0], 0, None
        for b in batches:
            out = []
            for p, w in zip(b.column("_part").to_pylist(), b.column("word").to_pylist()):
                if p != part:
                    part, made, (k, edge) = p, 0, place[p]
                    stack, last = [0, *edge[0]], w[: len(edge[0])]
                keep = _shared(last, w)
                del stack[keep + 1 :]
                named = _shared(edge[1], w)
                for depth in range(keep + 1, len(w) + 1):
                    if depth <= named:
                        stack.append(edge[2][depth - 1])
                    else:
                        made += 1
                        stack.append(k * _BASE + made)
                last = w
                out.append(stack.copy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], [*b.schema.names, name])

    sorted_ranges = dealt.repartition(ranges, "_part").sortWithinPartitions("_part", "word")
    return sorted_ranges.mapInArrow(walk, extended(dealt, f"{name} array<bigint>")).drop("_part")


def pair_dictionary(words: DataFrame) -> DataFrame:
    """(p, s, word_id, n, cut, single): the pairs of every word; ``cut``: with nothing skipped; ``single``: the first of a run of equal letters is skipped.

    ``words`` has (word_id, n, word, before, after): nodes of its beginnings, and of its ends by their length.
    """
    length = F.char_length("word")
    letter = lambda i: F.substr(F.col("word"), i + 1, F.lit(1))
    at = words.select("word_id", "n", "word", "before", "after", F.posexplode("before").alias("i", "p"))
    i = F.col("i")
    entries = F.array(
        F.struct(F.get("after", length - i).alias("s"), F.lit(True).alias("cut"), F.lit(False).alias("single")),
        F.struct(F.get("after", length - i - 1).alias("s"), F.lit(False).alias("cut"), ((i == 0) | (letter(i) != letter(i - 1))).alias("single")),
    )
    return at.select("word_id", "n", "p", F.explode(entries).alias("e")).select("word_id", "n", "p", "e.s", "e.cut", "e.single").where("s is not null")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(word_id, n_near, best): the number of near words, and (-n, word_id) of the best of them."""
    me = F.struct((-F.col("n")).alias("m"), F.col("word_id").alias("w"))
    # of the skipped words of a pair, one for each letter at most: a bounded array
    groups = pairs.groupBy("p", "s").agg(
        F.min(F.when(F.col("cut"), me)).alias("whole"), F.sort_array(F.collect_list(F.when(~F.col("cut"), F.struct(me.alias("x"), "single")))).alias("skipped"),
    ).where((F.size("skipped") > 1) | (F.col("whole").isNotNull() & (F.size("skipped") > 0)))
    first, second = F.get("skipped", F.lit(0))["x"], F.get("skipped", F.lit(1))["x"]
    singles = F.filter("skipped", lambda e: e["single"])
    other = lambda e: F.when(e["x"]["w"] == first["w"], second).otherwise(first)
    whole = F.col("whole")
    of_skipped = F.transform("skipped", lambda e: F.struct(
        e["x"]["w"].alias("word_id"), (F.size("skipped") - 1 + (e["single"] & whole.isNotNull()).cast("int")).cast("long").alias("k"),
        F.least(other(e), F.when(e["single"], whole)).alias("best"),
    ))
    of_whole = F.filter(
        F.array(F.struct(whole["w"].alias("word_id"), F.size(singles).cast("long").alias("k"), F.get(singles, F.lit(0))["x"].alias("best"))), lambda e: e["word_id"].isNotNull() & (e["k"] > 0)
    )
    found = groups.select(F.explode(F.concat(of_skipped, of_whole)).alias("e")).select("e.*")
    return found.groupBy("word_id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word_id, root_id) of words that have a form (word_id, form_id): the end of the chain of forms. Forms grow in n, so there are no rings."""
    spark, path = forms.sparkSession, scratch_path(forms.sparkSession, "roots")
    now = materialize(forms.select("word_id", F.col("form_id").alias("root_id")), "roots", path)
    for _ in range(max_rounds):
        step = now.select(F.col("word_id").alias("_w"), F.col("root_id").alias("_r"))
        if now.join(step, F.col("root_id") == F.col("_w"), "left_semi").isEmpty():
            return now
        old, path = path, scratch_path(spark, "roots")
        now = materialize(now.withColumn("_k", rekey(F.col("root_id"))).join(step, F.col("_k") == F.col("_w"), "left").select("word_id", F.coalesce("_r", "root_id").alias("root_id")), "roots", path)
        discard(spark, old)
    raise RuntimeError(f"forms did not settle in {max_rounds} rounds")


def variants(docs: DataFrame, every: int | None = None, shortest: int = 5, least: int = 3, factor: int = 2, words_a_range: int = RANGE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of ``docs`` (doc_id, text).

    A word's form is its near word of largest n (ties: the smallest word) if that has at least ``factor`` times its n; its root is the end of
    the chain of forms.
    """
    counted = materialize(count_words(docs.select("doc_id", "text"), every, shortest, least), "words")
    ranges = max(1, -(-counted.count() // words_a_range))
    # ids in code-point order, so that the smallest id is the smallest word
    sorted_words = materialize(counted.repartitionByRange(ranges, "word").sortWithinPartitions("word").withColumn("word_id", F.monotonically_increasing_id()), "word-ids")
    before = trie_nodes(sorted_words, "before", ranges)
    backwards = sorted_words.select(F.reverse("word").alias("word"), "word_id")
    after = trie_nodes(backwards, "after", ranges).select(F.col("word_id").alias("_w"), "after")
    near = neighbours(pair_dictionary(before.join(after, F.col("word_id") == F.col("_w"))))
    joined = sorted_words.join(near.withColumnRenamed("word_id", "_w"), F.col("word_id") == F.col("_w"), "left")
    has = -F.col("best.m") >= factor * F.col("n")
    judged = materialize(joined.select("word", "word_id", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.w")).alias("form_id"), F.when(has, -F.col("best.m")).alias("form_n")), "near-words")
    found = roots(judged.where("form_id is not null"))
    names = lambda key, name: sorted_words.select(F.col("word_id").alias(key), F.col("word").alias(name))
    chained = judged.where("form_id is not null").join(found.withColumnRenamed("word_id", "_w"), F.col("word_id") == F.col("_w"))
    named = chained.withColumn("_f", rekey(F.col("form_id"))).join(names("_fw", "form"), F.col("_f") == F.col("_fw"))
    named = named.withColumn("_r", rekey(F.col("root_id"))).join(names("_rw", "root"), F.col("_r") == F.col("_rw"))
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    plain = judged.where("form_id is null").select("word", "n", "n_near", F.lit(None).cast("string").alias("form"), "form_n", F.col("word").alias("root"))
    return named.select(*columns).unionByName(plain.select(*columns))
