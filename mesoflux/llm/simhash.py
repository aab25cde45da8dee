"""SimHash near-duplicates with bit-sliced comparison.

1. ``fingerprints``: each text's 64-bit SimHash of word shingles, one pass, in Arrow batches.
2. Candidates by the pigeonhole principle: the 64 bits are cut into ``radius + spare`` blocks; two fingerprints within the radius
   agree on ``spare`` of them at least, so every choice of ``spare`` blocks is one table keyed by those bits. Only distinct
   fingerprints enter. A bucket of more than ``chunk`` rows is cut into chunks and every pair of chunks is a unit of its own, so
   no task holds an unbounded bucket and no link is lost.
3. ``_links``: in a unit, bit planes are stored vertically (one bit of 64 fingerprints to a word); carry-save counters over the
   planes update all distances at once, and words whose 64 distances all exceed the radius are abandoned. A unit returns a
   spanning forest of its links, never all pairs.
4. Distributed union-find over the links, then the smallest doc_id of each component.

Odd input: null and empty texts have no words and fingerprint zero, which links like any other. Null doc_ids are skipped when
the smallest is taken; a component of such rows only has a null id. Every input row gives one output row, repeated rows and ties
included. Columns other than ``doc_id`` and ``text`` are not read, so their names can't clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuzzy_lines
from ._common import SPACE_CLASS, connected_components, give_back, materialize, rekey

SHINGLE = 3
RADIUS = 3
SPARE = 2
CHUNK = 2048
SEED = 42
BATCH_BYTES = 4_000_000
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text as an unsigned 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, stops)]
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):  # bounds the unpacked bits of a very long text
        block = np.array(hashes[k : k + 4096], dtype=">u8")
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint's bits as a signed long, text_hash the XXH64 of the text."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])
        b = None
        give_back()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return picked.mapInArrow(run, "doc_id long, text_hash long, fp long")


# -- bit-sliced comparison ------------------------------------------------------------------------------------------------


def _planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit b of 64 fingerprints in each word; lanes beyond the last fingerprint repeat it."""
    lanes = -(-len(values) // 64) * 64
    padded = np.concatenate([values, np.repeat(values[-1:], lanes - len(values))])
    bits = np.unpackbits(padded.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def _within(planes: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(query, lane) index pairs at ``radius`` or fewer differing bits.

    Saturating carry-save counters of two bits and an overflow hold the distances of a query to 64 lanes in three words. After
    every 8 planes the (query, word) cells whose lanes have all overflowed are dropped.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the two-bit counters hold distances of at most 3")
    q, w = np.divmod(np.arange(len(queries) * planes.shape[1]), planes.shape[1])
    ones = np.zeros(len(q), np.uint64)
    twos, over = ones.copy(), ones.copy()
    for low in range(0, 64, 8):
        for b in range(low, low + 8):
            flip = np.where((queries[q] >> np.uint64(63 - b)) & np.uint64(1), _FULL, np.uint64(0))
            x = planes[b, w] ^ flip
            carry = ones & x
            ones ^= x
            up = twos & carry
            twos ^= carry
            over |= up
        live = over != _FULL
        if not live.all():
            q, w, ones, twos, over = q[live], w[live], ones[live], twos[live], over[live]
            if not len(q):
                break
    far = over.copy()
    if radius == 0:
        far |= ones | twos
    elif radius == 1:
        far |= twos
    elif radius == 2:
        far |= ones & twos
    close = np.unpackbits((~far).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    cell, lane = np.nonzero(close)
    return q[cell], w[cell] * 64 + lane


def _links(fps: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``fps[left]`` and ``fps[right]``."""
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    planes, out = _planes(fps[right]), []
    step = max(1, (1 << 16) // planes.shape[1])
    for k in range(0, len(left), step):
        rows, lanes = _within(planes, fps[left[k : k + step]], radius)
        ok = lanes < len(right)
        for i, j in zip(left[k : k + step][rows[ok]].tolist(), right[lanes[ok]].tolist()):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _masks(radius: int, spare: int) -> list[int]:
    parts = radius + spare
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    blocks = [((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(parts)]
    return [sum(blocks[k] for k in chosen) for chosen in combinations(range(parts), spare)]


def links(distinct: DataFrame, radius: int = RADIUS, spare: int = SPARE, chunk: int = CHUNK) -> DataFrame:
    """(a, b): fingerprint links whose components are those of all links within the radius. ``distinct`` has one column fp."""
    signed = [m - (1 << 64) if m >> 63 else m for m in _masks(radius, spare)]
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])
    entries = distinct.select("fp", F.explode(keys).alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(rekey(F.col("key")).alias("k"), "n")
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    dealt = (
        entries.join(sizes, F.col("key") == F.col("k"))
        .withColumn("parts", parts)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("mine", "other").alias("ci"), F.greatest("mine", "other").alias("cj"), F.col("mine").alias("c"), "fp")
    )
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key", "ci", "cj").sortWithinPartitions("key", "ci", "cj").mapInArrow(_units(radius), "a long, b long")


def _units(radius: int):
    def run(batches):
        held = None
        for b in batches:
            t = {c: b.column(c).to_numpy() for c in ("key", "ci", "cj", "c", "fp")}
            if held is not None:
                t = {c: np.concatenate([held[c], t[c]]) for c in t}
            n = len(t["key"])
            if not n:
                continue
            cut = np.flatnonzero((np.diff(t["key"]) != 0) | (np.diff(t["ci"]) != 0) | (np.diff(t["cj"]) != 0)) + 1
            last = int(cut[-1]) if len(cut) else 0
            held = {c: v[last:] for c, v in t.items()}
            if last:
                yield _solve({c: v[:last] for c, v in t.items()}, cut, radius)
        if held is not None:
            yield _solve(held, np.array([len(held["key"])]), radius)

    return run


def _solve(t: dict[str, np.ndarray], cuts: np.ndarray, radius: int) -> pa.RecordBatch:
    """All whole units of ``t``; units of two are compared together, in lanes of XORs."""
    out, fps = [], t["fp"].view(np.uint64)
    starts = np.concatenate([[0], cuts[:-1]])
    two = starts[cuts - starts == 2]
    if len(two):
        x = fps[two] ^ fps[two + 1]
        _, lanes = _within(_planes(x), np.zeros(1, np.uint64), radius)
        lanes = lanes[lanes < len(x)]
        out += [(int(fps[s]), int(fps[s + 1])) for s in two[lanes]]
    for s, e in zip(starts.tolist(), cuts.tolist()):
        if e - s > 2:
            part, side = fps[s:e], t["c"][s:e]
            i, j = int(t["ci"][s]), int(t["cj"][s])
            every = np.arange(e - s)
            left, right = (every, every) if i == j else (every[side == i], every[side == j])
            if len(left) and len(right):
                out += [(int(part[a]), int(part[b])) for a, b in _links(part, left, right, radius)]
    a = np.array([p for p, _ in out], dtype=np.uint64).view(np.int64)
    b = np.array([q for _, q in out], dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


# -- the operator ---------------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, radius: int = RADIUS, spare: int = SPARE, shingle: int = SHINGLE, chunk: int = CHUNK, further: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fp, component_id (the smallest doc_id reachable over links), root (its fingerprint).

    ``further``: links (x, y) between texts, by their hashes, beside those between fingerprints.
    """
    marked = materialize(fingerprints(docs, shingle), "simhash", batch_bytes=BATCH_BYTES)
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    edges = links(distinct.select("fp"), radius, spare, chunk)
    if further is not None:
        of = marked.groupBy("text_hash").agg(F.min("fp").alias("fp"))
        a, b = [of.select(rekey(F.col("text_hash")).alias("h" + s), F.col("fp").alias(s)) for s in "ab"]
        edges = edges.union(further.join(a, F.col("x") == F.col("ha")).join(b, F.col("y") == F.col("hb")).select("a", "b"))
    roots = connected_components(edges, "a", "b")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id")).select(rekey(F.col("root")).alias("r"), "component_id")
    named = rooted.join(lows, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id", "root")
    named = materialize(named, "simhash-components")
    return marked.join(named, F.col("fp") == F.col("f")).select("doc_id", "text_hash", "fp", "component_id", "root")


def word_shingles(text: Column, n: int = 5) -> Column:
    """Hashes of the n-word shingles of a text; one of all its words where they are fewer; none without a word."""
    words = F.array_remove(F.split(F.lower(text), SPACE_CLASS), "")
    hashed = lambda ws, i: F.xxhash64(*[F.get(ws, i + k) for k in range(n)])
    runs = lambda ws: F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - n + 1, F.lit(1))), lambda w, i: hashed(ws, i))
    return F.get(F.transform(F.array(words), runs), F.lit(0))


def shingle_links(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(x, y): hashes of texts whose 5-word shingles have that Jaccard similarity, found in bands and verified exactly."""
    texts = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("h"), F.col("text").alias("norm"))
    keys = fuzzy_lines.set_keys(word_shingles(F.col("norm")))
    distinct = materialize(texts.select(F.col("h").alias("line_hash"), keys.alias("keys")).distinct(), "simhash-bands")
    return fuzzy_lines.links(texts, distinct, similarity, split=word_shingles)


def hex_fingerprint(col):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """``docs`` without all but one row of each near-duplicate component: the row of the smallest doc_id.

    Rows that share that doc_id are told apart by their text, the smallest hash staying; of rows equal in both one stays. A
    component of null doc_ids keeps one row of one text.
    """
    found = near_duplicates(docs, **params).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # by root: components whose smallest ids are equal or null are told apart by it
    keep = found.groupBy("root").agg(F.min("doc_id").alias("k_id"), F.min("text_hash").alias("text_hash"))
    keep = keep.select(F.coalesce("k_id", F.lit(0)).alias("id"), F.col("k_id").isNull().alias("no_id"), "text_hash").distinct()
    doc_id = F.col("doc_id").cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # in a struct, names of the input can't clash
    hashed = docs.select(row.alias("row"), F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id"), F.xxhash64("text").alias("text_hash"))
    # plain equality on all three keys, so that dropping repeats needs no further shuffle of the texts
    return hashed.join(keep, ["id", "no_id", "text_hash"], "left_semi").dropDuplicates(["id", "no_id", "text_hash"]).select("row.*")
