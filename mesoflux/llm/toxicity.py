"""Toxicity scoring of restored text.

Noisy-channel deobfuscation: a token with leetspeak, separators between its letters or long repetitions, and letters or leet signs set
apart by blanks, span a lattice of the plain words they may stand for. Viterbi decoding finds the path of least cost under a character
trigram model, counted over the characters of all documents, plus the channel's costs. A token with one path only is its own restoration, so the
decoder runs on the others alone, once for each distinct token.

The scorer looks for words and word beginnings that labelled toxic documents hold and clean ones don't. A feature counts if its
excess over the base rate is beyond chance and if it follows many different words, which the words of a text that was merely
copied don't. Features are counted and judged by Spark; those that pass reach the driver. The score is the noisy-or of their precisions.

The labelled rows are sampled down to about ``TRAIN_ROWS``, and no feature of the sample is left out for being rare among others; the
character counts cover every document.

Odd input: null and empty texts get the base score. Labels without a document, null labels and null ids teach nothing; of several
labels for an id the largest holds. Without labels every score is the base score. Repeated rows are judged one by one; columns
named score or predicted are replaced, others pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import extended, sampled

TRAIN_ROWS = 30_000
BASE_SCORE = 0.02
THRESHOLD = 0.7
_CHANCE = 20.0
_CONTEXTS = 5
_CACHE = 500_000

#: What a leet sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = ".-_*~'`,"
_SWAP_COST, _DROP_COST, _KEEP_COST, _BREAK_COST = 0.7, 0.3, 12.0, 3.0
_SINGLE = "[^\\W\\d_]|[" + re.escape("".join(LEET)) + "]"
_SPACED = re.compile(rf"(?<!\S)(?:{_SINGLE})(?: {{1,3}}(?:{_SINGLE})){{2,}}(?!\S)")
_NOISY = re.compile(r"[^\W\d_].*[0-9@$!|+(€.\-_*~'`,].*[^\W\d_]|^[0-9@$!|+(€]+[^\W\d_]|[^\W\d_][0-9@$!|(€]+$|([^\W\d_])\1\1")
_EDGES = "\"'.,;:!?()[]{}<>«»“”‘’…*#%&|/\\-_~`^=+"
#: Symbols: 0 for what is no letter, then a-z, the letters of Latin-1, and one for all others.
_SYMBOL = np.array([59 if chr(k).isalpha() else 0 for k in range(1 << 16)], np.int32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[0xDF:0x100] = [0 if k == 0xF7 else 27 + k - 0xDF - (k > 0xF7) for k in range(0xDF, 0x100)]
_CLASSES = 60


def _symbol(ch: str) -> int:
    return int(_SYMBOL[min(ord(ch), 0xFFFF)])


def char_counts(docs: DataFrame) -> DataFrame:
    """(code, n): trigrams of character symbols over all documents, lower-cased."""

    def run(batches):
        total = np.zeros(_CLASSES**3, np.int64)
        for b in batches:
            raw = "  ".join([*[(t or "").lower() for t in b.column("text").to_pylist()], ""]).encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(raw, np.uint32)
            for low in range(0, len(codes), 1 << 20):
                x = _SYMBOL[np.minimum(codes[low : low + (1 << 20) + 2], 0xFFFF)]
                total += np.bincount((x[:-2] * _CLASSES + x[1:-1]) * _CLASSES + x[2:], minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(total[code], pa.int64())], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class CharModel:
    """Cost of a symbol after two others, in nats: interpolated trigram, bigram and unigram estimates."""

    cost: list[float]

    @classmethod
    def build(cls, counts: list[tuple[int, int]]) -> CharModel:
        n3 = np.zeros((_CLASSES,) * 3)
        for code, n in counts:
            n3[code // _CLASSES**2, code // _CLASSES % _CLASSES, code % _CLASSES] = n
        n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
        p1 = (n1 + 1) / (n1.sum() + _CLASSES)
        p2 = (n2 + 4 * p1) / (n2.sum(axis=1, keepdims=True) + 4)
        p3 = (n3 + 4 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 4)
        return cls((-np.log(p3)).reshape(-1).tolist())

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """Viterbi: the string of least total cost; each cell of ``lattice`` lists (text, channel cost), the text may be empty."""
        cost, states = self.cost, {(0, 0): (0.0, "")}
        for options in [*lattice, [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (so_far, out) in states.items():
                for text, price in options:
                    x, y, total = a, b, so_far + price
                    for ch in text:
                        s = _symbol(ch)
                        total += cost[(x * _CLASSES + y) * _CLASSES + s]
                        x, y = y, s
                    old = after.get((x, y))
                    if old is None or total < old[0]:
                        after[x, y] = (total, out + text)
            states = after
        return min(states.values())[1].strip()


def lattice_of(token: str) -> list[list[tuple[str, float]]]:
    """The options of each character, runs of one letter being a cell of their own."""
    out, k = [], 0
    while k < len(token):
        ch = token[k]
        run = 1
        while k + run < len(token) and token[k + run] == ch:
            run += 1
        if ch.isalpha():
            out.append([(ch, 0.0), (ch * 2, 0.0)] if run >= 3 else [(ch * run, 0.0)])
        else:
            options = [(ch * run, _KEEP_COST)]
            if ch in LEET:
                options += [(letter * min(run, 2), _SWAP_COST) for letter in LEET[ch]]
            if ch in SEPARATORS or ch in "!|+(":
                options.append(("", _DROP_COST))
            out.append(options)
        k += run
    return out


class Restorer:
    """Words of a text with obfuscation undone. Tokens are lower case; a bounded cache holds what was decoded."""

    def __init__(self, model: CharModel):
        self.model, self.cache = model, {}

    def token(self, token: str) -> str:
        found = self.cache.get(token)
        if found is None:
            bare = token.strip(_EDGES)
            noisy = _NOISY.search(bare) or _NOISY.search(token)
            found = self.model.decode(lattice_of(bare if _NOISY.search(bare) else token)).strip(_EDGES) if noisy else bare
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            self.cache[token] = found
        return found

    def spaced(self, text: str) -> list[list[str]]:
        """The words of each run of single letters and leet signs, at least half of them letters, cut into words where that costs least."""
        return [words for words in (self._run(m.group()) for m in _SPACED.finditer(text)) if words]

    def _run(self, run: str) -> list[str]:
        signs = run.split()
        if 2 * sum(map(str.isalpha, signs)) < len(signs):
            return []
        lattice = []
        for k, ch in enumerate(signs):
            options = [(ch, 0.0)] if ch.isalpha() else [(ch, _KEEP_COST), *[(letter, _SWAP_COST) for letter in LEET[ch]]]
            lattice.append(options if k == 0 else options + [(" " + t, c + _BREAK_COST) for t, c in options])
        return self.model.decode(lattice).split()

    def guesses(self, text: str) -> set[str]:
        """Besides those words, the whole run and the run less its first or last letter, which may be a word of its own."""
        out: set[str] = set()
        for words in self.spaced(text):
            letters = "".join(words)
            out.update(words, (letters, letters[1:], letters[:-1]))
        return out

    def text(self, text: str) -> str:
        """The restored text, for reading."""
        joined = _SPACED.sub(lambda m: " ".join(self._run(m.group())) or m.group(), text.lower())
        return " ".join(self.token(t) for t in joined.split())

    def words(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        out = {self.token(t) for t in set(low.split())}
        out.update(self.guesses(low))
        out.discard("")
        return out


def features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}~" for n in (4, 5, 6) if len(word) >= n]]


@dataclass
class ToxicModel:
    chars: CharModel
    precision: dict[str, float]

    def scorer(self):
        restorer, miss, seen = Restorer(self.chars), [], {}
        precision = self.precision

        def logs(token: str) -> list[tuple[str, float]]:
            found = seen.get(token)
            if found is None:
                hit = [(f, precision[f]) for f in features(restorer.token(token)) if f in precision]
                if len(seen) >= _CACHE:
                    seen.clear()
                found = seen[token] = hit or miss
            return found

        def score(text: str | None) -> float:
            low = (text or "").lower()
            found: dict[str, float] = {}
            for t in set(low.split()):
                got = logs(t)
                if got:
                    found.update(got)
            for w in restorer.guesses(low):
                found.update((f, precision[f]) for f in features(w) if f in precision)
            clean = 1.0 - BASE_SCORE
            for p in found.values():
                clean *= 1.0 - p
            return 1.0 - clean

        return score


def _feature_counts(chars):
    def run(batches):
        restorer = Restorer(chars.value)
        for b in batches:
            n, bad, seen = Counter(), Counter(), Counter()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                tokens = (text or "").lower().split()
                found: dict[str, int] = {}
                for before, token in zip(["", *tokens], tokens):
                    mask = 1 << (hash_of(before) & 31) if toxic else 0
                    for f in features(restorer.token(token)):
                        found[f] = found.get(f, 0) | mask
                for w in restorer.guesses((text or "").lower()):
                    for f in features(w):
                        found[f] = found.get(f, 0) | toxic
                found.pop("", None)
                n.update(found.keys())
                if toxic:
                    bad.update(found.keys())
                    for f, mask in found.items():
                        seen[f] |= mask
            columns = [pa.array(list(n), pa.string()), *[pa.array([c[f] for f in n], pa.int64()) for c in (n, bad, seen)]]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "n", "toxic", "contexts"])

    return run


def hash_of(word: str) -> int:
    h = 0
    for ch in word[:12]:
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    return h ^ h >> 15


def char_model(docs: DataFrame) -> CharModel:
    rows = char_counts(docs).collect()  # at most 60^3 rows
    return CharModel.build([(r.code, r.n) for r in rows])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicModel:
    """``docs``: every document, for the character counts; ``labels``: doc_id and toxic of the rows to learn from."""
    chars = char_model(docs)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = sampled(known, F.lit(1), train_rows)  # the bound makes it fit for a broadcast
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(some), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(chars)
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not sizes.get(1):
        return ToxicModel(chars, {})
    base = sizes[1] / sum(sizes.values())
    counts = texts.select("text", "toxic").mapInArrow(_feature_counts(sent), "feature string, n long, toxic long, contexts long")
    counts = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t"), F.bit_or("contexts").alias("contexts"))
    # how far beyond chance t of n is: n * KL(t / n || base), in nats
    p, q = F.col("t") / F.col("n"), min(base, 0.99)
    excess = F.col("n") * (p * F.log(p / q) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0))
    precision = (F.col("t") + base) / (F.col("n") + 1)
    good = (F.col("t") >= 4) & (F.bit_count("contexts") >= _CONTEXTS) & (precision >= 0.8) & (p > q) & (excess >= _CHANCE)
    return ToxicModel(chars, {r.feature: r.p for r in counts.where(good).select("feature", precision.alias("p")).toLocalIterator()})


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``docs`` with score and predicted."""
    base = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = extended(base, "score double, predicted int")

    def run(batches):
        judge = held.value.scorer()
        for b in batches:
            s = [judge(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], [*b.schema.names, "score", "predicted"]
            )

    return base.mapInArrow(run, schema)
