"""Hard-negative mining with exact integer scores.

1. ``prepared``: components are scaled and floored to integers; rows that can't be scored leave.
2. Anchors and candidates are dealt into blocks of bounded size by a hash of their ids, so that any label, however frequent, is many
   blocks. ``_cells`` brings each pair of an anchor block and a candidate block together once. The anchors are a stated set of queries.
3. Scores of a cell: ``strassen``, recursive multiplication of int64 tiles with zero padding. Integer sums wrap around modulo 2^64 and
   so stay exact whatever the intermediate sums are, as long as the product itself fits.
4. Heaps: a cell yields the best ``positives`` rows of each anchor's label, then, with the thresholds that these set, the best
   ``negatives`` rows of every window. Heaps of cells merge by rank windows that Spark limits before their shuffle.

Odd input: rows with a null id, label or vector, or a null or non-finite component take no part; nor do rows with a scaled component
beyond +-2^26, whose products might not fit 64 bits. Of rows that share an id, that with the least label, then vector, takes part.
Vectors of different lengths are padded with zeros; an empty vector scores 0. Anchors without a positive, and windows without a
negative, give no rows. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

ANCHOR_BLOCK = 2048
CANDIDATE_BLOCK = 4096
#: Side from which on tiles are multiplied by numpy.
LEAF = 16
_TILE = 1024
_LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices: seven products of half the size, down to ``LEAF``; odd sides are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b)[:m, :n]
    h, w, v = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:h, :w], a[:h, w:], a[h:, :w], a[h:, w:]
    b11, b12, b21, b22 = b[:w, :v], b[:w, v:], b[w:, :v], b[w:, v:]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11), strassen(a11, b12 - b22)
    p4, p5 = strassen(a22, b21 - b11), strassen(a11 + a12, b22)
    p6, p7 = strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((m, n), np.int64)
    out[:h, :v], out[:h, v:] = p1 + p4 - p5 + p7, p3 + p5
    out[h:, :v], out[h:, v:] = p2 + p4, p1 - p2 + p3 + p6
    return out


class Heaps:
    """The best ``size`` entries of each slot by score, then by smaller id; entries come tile by tile, heaps of parts can be merged."""

    def __init__(self, slots: int, size: int):
        self.size = size
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.worst = np.full(slots, _LEAST)  # what an entry must reach to be kept

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        starts = np.flatnonzero(np.diff(slot, prepend=-1))
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(starts, append=len(slot)))
        last = place == self.size - 1
        self.worst[slot[last]] = score[last]
        keep = place < self.size
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]


def prepared(rows: DataFrame, scale: float, limit: int = 1 << 26) -> DataFrame:
    """(id, label, vec): one scorable row of each id, with whole components. ``rows`` has (id, label, vec)."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    whole = F.transform("vec", lambda x: F.floor(scaled(x)))
    sound = F.forall("vec", lambda x: x.isNotNull() & (F.abs(scaled(x)) <= limit))  # NaN is greater than any number
    fit = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(sound)
    return fit.select("id", "label", whole.alias("vec")).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row")).select("id", "row.label", "row.vec")


def _cells(anchors: DataFrame, candidates: DataFrame, n_anchors: int, n_candidates: int, run, schema: str, group: Column, sizes: DataFrame | None = None) -> DataFrame:
    """``run`` over every pair of an anchor block and a candidate block of the same ``group``.

    Blocks are dealt by a hash of the id; ``sizes`` (group, n_anchors, n_candidates) sets their numbers by group, else the two totals do.
    """

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        return (
            df.withColumn("_own", F.pmod(F.xxhash64("id"), F.col(own)))
            .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        )

    def numbered(df: DataFrame) -> DataFrame:
        df = df.withColumn("_group", group.cast("long"))
        if sizes is None:
            return df.withColumns({"_a": F.lit(_blocks(n_anchors, ANCHOR_BLOCK)).cast("long"), "_c": F.lit(_blocks(n_candidates, CANDIDATE_BLOCK)).cast("long")})
        return df.join(sizes, "_group")

    left = dealt(numbered(anchors), "_a", "_c").select("_group", F.col("_own").alias("_i"), F.col("_other").alias("_j"), *[F.col(c).alias(c) for c in anchors.columns])  # own columns: both sides come from one table
    right = dealt(numbered(candidates), "_c", "_a").select("_group", F.col("_other").alias("_i"), F.col("_own").alias("_j"), *candidates.columns)
    keys = ["_group", "_i", "_j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows as one int64 matrix, padded with zeros to ``width``."""
    lists = vectors.combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    return out


def _tiles(left: pa.Table, right: pa.Table):
    """(slice of anchors, slice of candidates, their scores)."""
    width = int(max(pc.max(pc.list_value_length(t.column("vec"))).as_py() for t in (left, right)))
    a, b = _matrix(left.column("vec"), width), _matrix(right.column("vec"), width).T
    for i in range(0, a.shape[0], _TILE):
        for j in range(0, b.shape[1], _TILE):
            yield slice(i, i + _TILE), slice(j, j + _TILE), strassen(a[i : i + _TILE], np.ascontiguousarray(b[:, j : j + _TILE]))


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _best(df: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Merge the heaps of cells: rank within ``keys`` by score, then id; Spark limits the ranks before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "other"))
    return df.withColumn(name, rank).where(F.col(name) <= size)


def mine(rows: DataFrame, anchor: Column, *, scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (id, label, vec): (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says which rows are anchors. A negative's score lies between ``low`` and ``high`` hundredths of the positive's.
    """
    data = materialize(prepared(rows.select("id", "label", "vec"), scale), "scaled")
    anchors = data.where(anchor)
    n, n_anchors = data.count(), anchors.count()
    blocks = lambda c, size: F.greatest(F.lit(1), F.ceil(c / F.lit(size))).cast("long")
    sizes = (
        data.groupBy(F.col("label").cast("long").alias("_group")).agg(F.count("*").alias("_n"), F.count_if(anchor).alias("_n_anchors"))
        .where("_n_anchors > 0").select("_group", blocks(F.col("_n_anchors"), ANCHOR_BLOCK).alias("_a"), blocks(F.col("_n"), CANDIDATE_BLOCK).alias("_c"))
    )
    found = materialize(_best(_cells(anchors, data, 0, 0, _positive_heaps(positives), "anchor_id long, other long, score long", F.col("label"), sizes), ["anchor_id"], positives, "_rank"), "positives")
    windows = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("_rank", F.col("other").alias("p"), F.col("score").alias("s")))).alias("w"))
    asked = anchors.join(windows, F.col("id") == F.col("anchor_id")).select(
        "id", "label", "vec", F.col("w.s").alias("p_score"), F.col("w.p").alias("p_id")
    )
    schema = "anchor_id long, positive_id long, positive_score long, other long, score long"
    made = _cells(asked, data, n_anchors, n, _window_heaps(negatives, low, high), schema, F.lit(0))
    return _best(made, ["anchor_id", "positive_id"], negatives, "rank").select(
        "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _positive_heaps(size: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best rows of each anchor among the rows of its label."""
        names = ["anchor_id", "other", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        own, ids, heaps = _column(left, "id"), _column(right, "id"), Heaps(left.num_rows, size)
        for at, of, score in _tiles(left, right):
            slot, col = np.nonzero((score >= heaps.worst[at, None]) & (own[at, None] != ids[None, of]))
            heaps.add(slot + at.start, score[slot, col], ids[of][col])
        return pa.table([own[heaps.slot], heaps.id, heaps.score], names)

    return run


def _window_heaps(size: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best rows of other labels in the window of each anchor and positive."""
        names = ["anchor_id", "positive_id", "positive_score", "other", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5, names)
        own, label, ids, labels = _column(left, "id"), _column(left, "label"), _column(right, "id"), _column(right, "label")
        lists = left.column("p_score").combine_chunks()
        of_anchor = pc.list_parent_indices(lists).to_numpy()
        p_score, p_id = pc.list_flatten(lists).to_numpy(), pc.list_flatten(left.column("p_id").combine_chunks()).to_numpy()
        # the bounds hold whole scores: low * p <= 100 * s <= high * p
        floor, ceil, heaps = -((-low * p_score) // 100), (high * p_score) // 100, Heaps(len(p_id), size)
        for at, of, score in _tiles(left, right):
            first, last = np.searchsorted(of_anchor, [at.start, at.stop])
            differs = label[at, None] != labels[None, of]
            for a in range(first, last, 256):  # windows of some anchors at a time
                w = slice(a, min(a + 256, last))
                row = of_anchor[w] - at.start
                s = score[row]
                slot, col = np.nonzero((s >= np.maximum(floor[w], heaps.worst[w])[:, None]) & (s <= ceil[w, None]) & differs[row])
                heaps.add(slot + a, s[slot, col], ids[of][col])
        return pa.table([own[of_anchor[heaps.slot]], p_id[heaps.slot], p_score[heaps.slot], heaps.id, heaps.score], names)

    return run
