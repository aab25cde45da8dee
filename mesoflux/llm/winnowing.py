"""Benchmark decontamination by winnowing.

Words are hashed, every run of ``K`` words is a k-gram, and of each ``SPAN - K + 1`` consecutive k-grams the least hash is kept
with its place (the rightmost of equal ones). Two texts that share ``SPAN`` words share those k-grams and so the kept one: no
shared span of ``SPAN`` words or more is missed. A fingerprint found in both is extended word by word in both directions; a run of
``SPAN`` words or more is a hit. An item of fewer words than ``SPAN`` is one window, looked up by the hash of all its words.

The test items' fingerprints are sent to every task while the items' characters stay within ``broadcast_chars``. Beyond that
bound training and test fingerprints are joined by a shuffle; the documents with a fingerprint in common, and no pair of texts, go on
to a second join, on the hashes of whole spans, which extends the hits: neighbouring spans make up longer ones.

Odd input: null and empty texts have no words, no hits and aren't contaminated. Repeated documents are judged row by row. Items
that share an id count once; an item with a null id marks words but isn't named. An empty benchmark hits nothing. Only ``doc_id``,
``text`` and ``item_id`` are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import extended, give_back, materialize

SPAN = 13
K = 5
BROADCAST_CHARS = 16_000_000
_STEP = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_GRAM = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, number of words of each text)."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = _LOWER[np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)]
    inside = _WORD[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stops = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.searchsorted(starts, stops), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    sizes = ends - starts
    powers = np.full(int(sizes.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    kept = data[inside].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(sizes) - sizes
    kept *= powers[np.arange(len(kept)) - np.repeat(first, sizes)]
    return _mix(np.add.reduceat(kept, first) + sizes.astype(np.uint64)), counts


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * _GRAM + words[j : len(words) - n + 1 + j]
    return _mix(out + np.uint64(n))


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the rightmost least hash of every ``width`` consecutive hashes, each place once."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    n = len(hashes) - width + 1
    low, place = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):
        other = hashes[j : n + j]
        less = other <= low
        low[less] = other[less]
        place[less] = j
    place += np.arange(n)
    return place[np.diff(place, prepend=-1) != 0]


@dataclass
class Items:
    """Fingerprints of the test items. ``span``: words that a long window holds."""

    span: int = SPAN
    k: int = K
    ids: list = field(default_factory=list)
    words: list = field(default_factory=list)
    prints: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    short: dict = field(default_factory=dict)

    @classmethod
    def build(cls, rows: list[tuple], span: int = SPAN, k: int = K) -> Items:
        out = cls(span, k)
        prints, owner, place, short = [], [], [], {}
        for item_id, text in rows:
            words, _ = word_hashes([text])
            if not len(words):
                continue
            at = len(out.ids)
            out.ids.append(None if item_id is None else str(item_id))
            out.words.append(words)
            if len(words) < span:
                short.setdefault(len(words), []).append((int(grams(words, len(words))[0]), at))
            else:
                g = grams(words, k)
                p = winnow(g, span - k + 1)
                prints.append(g[p])
                owner.append(np.full(len(p), at))
                place.append(p)
        if prints:
            order = np.argsort(np.concatenate(prints), kind="stable")
            out.prints, out.owner, out.place = (np.concatenate(x)[order] for x in (prints, owner, place))
        for n, pairs in short.items():
            pairs.sort()
            out.short[n] = (np.array([h for h, _ in pairs], np.uint64), np.array([i for _, i in pairs]))
        return out

    def _runs(self, words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray):
        """(item, start, end): runs of ``span`` equal words or more on every diagonal (item, place in text - place in item) with a common fingerprint."""
        met = np.flatnonzero(high > low)
        counts = (high - low)[met]
        part = np.cumsum(counts) // _STEP  # repeated words give many pairs, though few diagonals
        diagonals = set()
        for k in np.unique(part).tolist():
            j, n = met[part == k], counts[part == k]
            entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[j], n)
            code = (self.owner[entry] << 40) + np.repeat(at[j], n) - self.place[entry] + (1 << 39)
            diagonals.update(np.unique(code).tolist())
        for code in diagonals:
            item, shift = code >> 40, (code & ((1 << 40) - 1)) - (1 << 39)
            other = self.words[item]
            a, b = max(0, shift), max(0, -shift)
            n = min(len(words) - a, len(other) - b)
            edge = np.diff((words[a : a + n] == other[b : b + n]).astype(np.int8), prepend=0, append=0)
            for start, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                if end - start >= self.span:
                    yield item, a + start, a + end

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """(mask of hit words, places of the items that occur)."""
        mask, found = np.zeros(len(words), bool), set()
        if len(self.prints) and len(words) >= self.span:
            g = grams(words, self.k)
            at = winnow(g, self.span - self.k + 1)
            low, high = np.searchsorted(self.prints, g[at], "left"), np.searchsorted(self.prints, g[at], "right")
            for item, start, end in self._runs(words, at, low, high):
                mask[start:end] = True
                found.add(item)
        for n, (hashes, owners) in self.short.items():
            g = grams(words, n)
            low, high = np.searchsorted(hashes, g, "left"), np.searchsorted(hashes, g, "right")
            for p in np.flatnonzero(high > low):
                for e in range(low[p], high[p]):
                    if np.array_equal(words[p : p + n], self.words[int(owners[e])]):
                        mask[p : p + n] = True
                        found.add(int(owners[e]))
        return mask, found


def _parts(texts: list[str | None]):
    """Lists of texts of about ``_STEP`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= _STEP:
            yield part
            part, size = [], 0
    if part:
        yield part


def spans(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """``docs`` with n_words, n_hit (long) and items (sorted array of the item ids, as strings, that occur).

    Columns of ``docs`` with those names are replaced.
    """
    made = ["n_words", "n_hit", "items"]
    base = docs.drop(*made)
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > broadcast_chars:
        return _joined(base, bench, span, k)
    items = docs.sparkSession.sparkContext.broadcast(Items.build([(r.item_id, r.text) for r in bench.toLocalIterator()], span, k))
    schema = extended(base, "n_words long, n_hit long, items array<string>")

    def run(batches):
        known = items.value
        for b in batches:
            n_words, n_hit, ids = [], [], []
            for part in _parts(b.column("text").to_pylist()):
                words, counts = word_hashes(part)
                low = 0
                for n in counts.tolist():
                    mask, found = known.hits(words[low : low + n])
                    low += n
                    n_words.append(n)
                    n_hit.append(int(mask.sum()))
                    ids.append(sorted({known.ids[i] for i in found} - {None}))
            cols = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *made])
        b = part = words = cols = None
        give_back()

    return base.mapInArrow(run, schema)


def _joined(base: DataFrame, bench: DataFrame, span: int, k: int) -> DataFrame:
    """The same by shuffles, for a benchmark of any size. Rows of equal text share one answer, found by the text's two hashes."""
    lengths = bench.mapInArrow(_lengths, "n int").where(F.col("n").between(1, span - 1)).distinct()
    short = sorted(r.n for r in lengths.collect())  # at most span - 1 numbers
    row = F.struct(*[F.col(f"`{c}`") for c in base.columns])  # in a struct, names of the input can't clash
    keyed = base.select(row.alias("row"), F.xxhash64("text").alias("k1"), F.crc32(F.col("text").cast("binary")).alias("k2"))
    texts = keyed.select("k1", "k2", F.col("row.text").alias("text")).where("text IS NOT NULL").dropDuplicates(["k1", "k2"])
    items = bench.select(F.xxhash64("item_id", "text").alias("k1"), F.lit(0).cast("long").alias("k2"), "item_id", "text")
    common = items.mapInArrow(_prints(span, k, short), "k1 long, k2 long, h long").select(F.col("h").alias("ih")).distinct()
    found = texts.mapInArrow(_prints(span, k, short), "k1 long, k2 long, h long").join(common, F.col("h") == F.col("ih"), "left_semi")
    some = materialize(found.select("k1", "k2").distinct(), "winnow-documents")
    lines = "item_id string, k1 long, k2 long, p int, n int, w long"
    windows = materialize(items.mapInArrow(_windows(span, short, True), lines).select("item_id", F.col("w").alias("iw")).distinct(), "winnow-windows")
    marked = texts.join(some, ["k1", "k2"], "left_semi").withColumn("item_id", F.lit(None).cast("string")).mapInArrow(_windows(span, short, False), lines)
    hit = materialize(marked.join(windows.select("iw").distinct(), F.col("w") == F.col("iw"), "left_semi").select("k1", "k2", "p", "n", "w"), "winnow-hits")
    places = F.flatten(F.collect_list(F.sequence("p", F.col("p") + F.col("n") - 1)))
    covered = hit.groupBy("k1", "k2").agg(F.size(F.array_distinct(places)).cast("long").alias("n_hit"))
    named = hit.select("k1", "k2", "w").distinct().join(windows, F.col("w") == F.col("iw")).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    merged = materialize(covered.join(named, ["k1", "k2"]), "winnow-merged")
    count = F.size(F.array_remove(F.split(F.lower(F.coalesce("row.text", F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")).cast("long")
    none = F.array().cast("array<string>")
    return keyed.join(merged, ["k1", "k2"], "left").select(
        "row.*", count.alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items")
    )


def _lengths(batches):
    for b in batches:
        _, counts = word_hashes(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int32())], ["n"])


def _worded(batches):
    """(slice of the batch, word hashes of each of its texts)."""
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            part = batch.slice(low, 64)
            words, counts = word_hashes(part.column("text").to_pylist())
            yield part, np.split(words, np.cumsum(counts)[:-1])


def _prints(span: int, k: int, short: list[int]):
    def run(batches):
        for part, texts in _worded(batches):
            rows = []
            for w in texts:
                g = grams(w, k)
                rows.append(np.unique(np.concatenate([g[winnow(g, span - k + 1)], *[grams(w, s) for s in short]])))
            take = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
            yield pa.RecordBatch.from_arrays([part.column("k1").take(take), part.column("k2").take(take), pa.array(np.concatenate(rows).view(np.int64))], ["k1", "k2", "h"])

    return run


def _windows(span: int, short: list[int], whole: bool):
    """Hashes w of the windows of n words at place p; ``whole``: of an item of fewer words than ``span`` its one window alone."""

    def run(batches):
        for part, texts in _worded(batches):
            at, places, sizes, hashes = [], [], [], []
            for k, w in enumerate(texts):
                for n in ([min(len(w), span)] if len(w) else []) if whole else [*short, span]:
                    g = grams(w, n)
                    at.append(np.full(len(g), k))
                    places.append(np.arange(len(g), dtype=np.int32))
                    sizes.append(np.full(len(g), n, np.int32))
                    hashes.append(g.view(np.int64))
            if at:
                take = pa.array(np.concatenate(at))
                names = ["item_id", "k1", "k2"]
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(take) for c in names], *[pa.array(np.concatenate(x)) for x in (places, sizes, hashes)]], [*names, "p", "n", "w"])

    return run


def items_digest(items):
    """SHA-256, in lower-case hex, of the comma-joined ids."""
    return F.sha2(F.array_join(items, ","), 256)


def judge(found: DataFrame) -> DataFrame:
    """``spans`` rows with ``contaminated``: at least one hit, and hits make up a twentieth of the words or more."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``docs`` without the contaminated ones."""
    columns = docs.columns
    hidden = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"_c{n}") for n, c in enumerate(columns)])
    kept = judge(spans(hidden, benchmark, **params)).where(~F.col("contaminated"))
    return kept.select(*[F.col(c if c == "text" else f"_c{n}").alias(c) for n, c in enumerate(columns)])


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
