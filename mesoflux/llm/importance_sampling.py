"""Importance resampling with hashed n-gram models.

Words and word pairs are hashed into ``BUCKETS``; target text and raw text each give a smoothed distribution over the buckets, and
a document's log weight is the sum of the log ratios of its n-grams. Gumbel noise, drawn from a hash of the row, is added, and the
rows with the largest sums are a sample without replacement by weight.

The k-th largest sum is found by narrowing a histogram, so no task or driver sees the ranking as a whole.

The target model is fitted on a sample of about ``TARGET_ROWS`` target rows, spread by hash over all of them, so that their ids may be
broadcast and no text ever crosses an exchange; the raw model, the weights and the ranking cover every row.

Odd input: null and empty texts have log weight 0. Sums are ranked to six decimals; ties at the bar, such as rows equal in id and text,
which draw the same noise, are chosen together, so the sample may exceed k by them. An empty table gives an empty result; without
target rows all weights are 0. Null target ids mark nothing. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import extended, materialize, sampled
from .winnowing import _parts, grams, word_hashes

BUCKETS = 10_000
SHARE = 0.5
#: Target rows that the target model is fitted on, at most; the bound makes their ids (8 bytes each) fit for a broadcast.
TARGET_ROWS = 200_000
SEED = 7
_SCALE = 1_000_000  # sums are ranked to six decimals
_BINS = 4096


def _buckets(words: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word and every pair of words within a text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    pairs = grams(words, 2)
    inside = owner[1:] == owner[:-1]
    return np.concatenate([words, pairs[inside]]) % np.uint64(buckets), np.concatenate([owner, owner[1:][inside]])


def ngram_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, target, raw): n-grams of rows whose ``is_target`` is true, and of all rows."""

    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            flags = np.array(b.column("is_target").to_pylist(), bool)
            low = 0
            for part in _parts(b.column("text").to_pylist()):
                bucket, owner = _buckets(*word_hashes(part), buckets)
                flag = flags[low : low + len(part)]
                low += len(part)
                total[0] += np.bincount(bucket[flag[owner]].astype(np.int64), minlength=buckets)
                total[1] += np.bincount(bucket.astype(np.int64), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total[0]), pa.array(total[1])], ["bucket", "target", "raw"])

    picked = texts.select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    return picked.mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    rows = ngram_counts(texts, buckets).collect()  # one row a bucket
    target, raw = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        target[r.bucket], raw[r.bucket] = r.target, r.raw
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``docs`` with log_weight."""
    base = docs.drop("log_weight")
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        known = held.value
        for b in batches:
            out = []
            for part in _parts(b.column("text").to_pylist()):
                bucket, owner = _buckets(*word_hashes(part), len(known))
                out.append(np.bincount(owner, weights=known[bucket.astype(np.int64)], minlength=len(part)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], [*b.schema.names, "log_weight"])

    return base.mapInArrow(run, extended(base, "log_weight double"))


def gumbel(seed: int, *cols: str):
    """-ln(-ln u), u uniform in (0, 1) from a 53-bit hash of the columns."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(ranks: DataFrame, col: str, k: int) -> int | None:
    """The k-th largest value of a long column: each pass counts ``_BINS`` equal ranges and keeps the one that holds it."""
    if k <= 0:
        return None
    low, high = ranks.agg(F.min(col), F.max(col)).first()
    if low is None:
        return None
    while low < high:
        width = -(-(high - low + 1) // _BINS)
        rows = (
            ranks.where(F.col(col).between(low, high)).groupBy(F.floor((F.col(col) - F.lit(low)) / F.lit(width)).cast("long").alias("bin")).count()
            .orderBy(F.desc("bin")).collect()
        )
        for r in rows:
            if k <= r["count"]:
                break
            k -= r["count"]
        else:
            return low  # fewer than k values
        low, high = low + r.bin * width, min(high, low + (r.bin + 1) * width - 1)
    return low


def mark(docs: DataFrame, target_ids: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(text, is_target) of every row; ``target_rows`` bounds the marked ids."""
    ids = target_ids.select(F.col("doc_id").cast("long").alias("target_id")).where("target_id IS NOT NULL").distinct()
    some = F.broadcast(sampled(ids, F.lit(1), target_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(some, F.col("doc_id") == F.col("target_id"), "left").select("text", F.col("target_id").isNotNull().alias("is_target"))


def resample(docs: DataFrame, target_ids: DataFrame, share: float = SHARE, seed: int = SEED, buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, selected) of every row. ``target_ids``: doc_id of target rows, repeats allowed."""
    rows = docs.select("doc_id", "text")
    weighed = weigh(rows, log_ratios(mark(docs, target_ids, target_rows), buckets))
    keyed = weighed.select("doc_id", "log_weight", F.round((F.col("log_weight") + gumbel(seed, "doc_id", "text")) * _SCALE).cast("long").alias("rank"))
    keyed = materialize(keyed, "resample")
    bar = kth_largest(keyed, "rank", math.ceil(share * keyed.count()))
    chosen = F.lit(False) if bar is None else F.col("rank") >= bar
    return keyed.select("doc_id", "log_weight", (F.col("rank") / _SCALE).alias("gumbel_key"), chosen.alias("selected"))
