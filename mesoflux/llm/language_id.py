"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order up to ``ORDER``. In a context seen N times with D different next bytes, a
byte seen n times has probability n / (N + D) and the escape to the context shorter by a byte has D / (N + D); below the empty
context all 256 bytes are equally likely. With statistics frozen, the code length of a byte depends on its context alone, so the
trees of all languages are merged into one tree whose nodes hold the exact code length of every next byte under every language,
and a text's bytes are looked up all at once. The language of the least total code length wins; the score is its posterior
probability under equal priors.

Training counts come from a sample of about ``TRAIN_BYTES`` bytes of each language, ``ALL_BYTES`` in all, drawn as pieces of ``PIECE``
characters by hash over all training rows, so that a language of a few long texts is drawn from like any other. That bounds what
reaches the driver; every context of the sample stays, however rare. All else runs over whole texts.

Odd input: a null text, or one without a letter, is ``und`` with score 0, and so is everything if no language was learned. Null
texts and null languages teach nothing. Ties go to the language first in alphabetical order. Rows are judged one by one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import extended

ORDER = 3
TRAIN_BYTES = 1_500_000
ALL_BYTES = 24_000_000
PIECE = 2048
_PLAIN = re.compile("[A-Za-z]")
_SLICE = 1 << 19


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter; superscripts, fractions and circled digits are none."""
    return bool(text) and (_PLAIN.search(text) is not None or any(map(str.isalpha, text)))


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _grams(batches):
    """(lang, order, code, n): counts of each byte with its ``order`` bytes before, packed into a number."""
    for b in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            texts.setdefault(lang, []).append(b" " * ORDER + _bytes(text))
        out = []
        for lang, parts in texts.items():
            data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
            first = np.zeros(len(data), bool)  # the padding is context, not content
            begin = np.cumsum([0, *[len(p) for p in parts]])[:-1]
            for k in range(ORDER):
                first[begin + k] = True
            real = np.flatnonzero(~first)
            code = np.zeros(len(real), np.int64)
            for order in range(ORDER + 1):
                code |= data[real - order] << (8 * order)
                codes, n = np.unique(code, return_counts=True)
                out.append((np.full(len(codes), lang, object), np.full(len(codes), order), codes, n))
        if out:
            cols = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["lang", "order", "code", "n"]
            )


@dataclass
class Model:
    """The merged tree. ``step[node * width + symbol]`` leads to the longer context; nodes from ``len(nodes)`` on are dead ends."""

    langs: list[str]
    symbol: np.ndarray
    step: np.ndarray
    cost: np.ndarray  # (nodes * width, languages), in bits

    @property
    def width(self) -> int:
        return int(self.symbol.max()) + 1

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): bits of each whole text."""
        total = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts])
        data = self.symbol[np.frombuffer(b"".join(b" " * ORDER + t for t in texts), np.uint8)]
        owner = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(owner)) + np.repeat(np.arange(1, len(texts) + 1) * ORDER, sizes)
        width, nodes = self.width, len(self.cost) // self.width
        for low in range(0, len(place), _SLICE):
            at, of = place[low : low + _SLICE], owner[low : low + _SLICE]
            node = np.zeros(len(at), np.int32)
            for k in range(1, ORDER + 1):
                node = self.step[node * width + data[at - k]]
            node[node >= nodes] -= nodes
            bits = self.cost[node * width + data[at]]
            base = int(of[0])
            for lang in range(len(self.langs)):
                got = np.bincount(of - base, weights=bits[:, lang])
                total[base : base + len(got), lang] += got
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [k for k, t in enumerate(texts) if has_letter(t)]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if known and self.langs:
            bits = self.code_lengths([_bytes(texts[k]) for k in known])
            best = bits.argmin(axis=1)
            gap = np.minimum((bits - bits.min(axis=1, keepdims=True)) * np.log(2), 700)
            score = 1 / np.exp(-gap).sum(axis=1)
            for k, b, s in zip(known, best.tolist(), score.tolist()):
                langs[k], scores[k] = self.langs[b], s
        return langs, scores


def build(rows) -> Model:
    """``rows``: (lang, order, code, n). A context is named by its bytes, the nearest first."""
    langs = sorted({r[0] for r in rows})
    counts: dict[bytes, dict[int, dict[int, int]]] = {}
    for lang, order, code, n in rows:
        packed = int(code).to_bytes(ORDER + 1, "little")
        of = counts.setdefault(packed[1 : order + 1], {}).setdefault(langs.index(lang), {})
        of[packed[0]] = of.get(packed[0], 0) + n
    seen = sorted({s for c in counts.values() for t in c.values() for s in t})
    symbol = np.full(256, len(seen), np.int32)  # bytes never seen share the last symbol
    symbol[seen] = np.arange(len(seen))
    width = len(seen) + 1
    chosen: dict[bytes, int] = {b"": 0}
    for c in sorted(counts, key=lambda c: (len(c), c)):
        chosen.setdefault(c, len(chosen))
    nodes = len(chosen)
    step = np.empty((2 * nodes, width), np.int32)
    step[:nodes] = nodes + np.arange(nodes)[:, None]
    step[nodes:] = nodes + np.arange(nodes)[:, None]
    cost = np.empty((nodes, width, max(1, len(langs))), np.float32)
    for c, at in chosen.items():  # parents come before children
        shorter = chosen[c[:-1]] if c else None
        if c:
            step[shorter, symbol[c[-1]]] = at
        for k in range(len(langs)):
            below = cost[shorter, :, k] if c else np.full(width, 8.0, np.float32)
            own = counts.get(c, {}).get(k)
            if not own:
                cost[at, :, k] = below
                continue
            total, kinds = sum(own.values()), len(own)
            cost[at, :, k] = below + np.log2((total + kinds) / kinds)
            for s, n in own.items():
                cost[at, symbol[s], k] = np.log2((total + kinds) / n)
    return Model(langs, symbol, step.reshape(-1), cost.reshape(nodes * width, -1))


def train(labelled: DataFrame, train_bytes: int = TRAIN_BYTES, all_bytes: int = ALL_BYTES) -> Model:
    """``labelled``: text and lang; rows with a null in either are skipped."""
    rows = labelled.select("lang", "text").where(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    totals = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("total"))  # a row a language
    bound = F.least(F.lit(float(train_bytes)), F.lit(float(all_bytes)) / F.count("*").over(Window.partitionBy(F.lit(0))))
    shares = totals.select(F.col("lang").alias("of"), F.least(F.lit(1.0), bound / F.col("total")).alias("share"))
    draw = lambda k: F.pmod(F.xxhash64(F.lit("piece"), "lang", "text_hash", k), F.lit(1 << 30)) / float(1 << 30)
    drawn = F.filter(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int")), lambda k: draw(k) < F.col("share"))
    pieces = F.transform(drawn, lambda k: F.substring(F.col("text"), k * PIECE + 1, F.lit(PIECE)))
    marked = rows.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(shares), F.col("lang") == F.col("of"))
    some = marked.select("lang", F.explode(pieces).alias("text"))
    grams = some.mapInArrow(_grams, "lang string, order int, code long, n long").groupBy("lang", "order", "code").agg(F.sum("n").alias("n")).toArrow()
    return build(list(zip(*[grams.column(c).to_pylist() for c in ("lang", "order", "code", "n")])) if grams.num_rows else [])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; columns of those names are replaced."""
    base = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = extended(base, "lang_pred string, score double")

    def run(batches):
        for b in batches:
            langs, scores = [], []
            texts = b.column("text").to_pylist()
            low = size = 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size > 1 << 20 or k == len(texts) - 1:
                    got = held.value.predict(texts[low : k + 1])
                    langs += got[0]
                    scores += got[1]
                    low, size = k + 1, 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)


def held_out(doc_id, parts: int, part: int):
    """crc32 of the id as text, modulo ``parts``, is ``part``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
