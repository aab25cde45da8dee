"""Best-fit-decreasing packing of token sequences.

1. Tokenize in Arrow batches, in slices of a megabyte. Splitting at ASCII white space is exact for this tokenizer, which drops
   white space and never joins over it, so a chunk is encoded when a task first meets it and the ids are gathered by index. What a
   task remembers is bounded by the characters of its chunks; beyond that it begins anew.
2. An overlong document is first cut into full windows, which are whole sequences; only the remainders are packed.
3. Remainders are dealt over shards by a hash of the piece and its place in the table, so that repeated rows spread; a shard holds about ``shard_pieces`` of them, however large the input is. In its
   shard each piece, longest first, goes to the open window with the least remaining capacity that still fits it, found by a
   segment tree indexed by remaining capacity.

Odd input: a null or empty text has the end id alone. Every input row gives its own pieces, repeated rows and null ids
included. Only ``doc_id`` and ``text`` are read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import give_back, materialize

WINDOW = 4096
END_ID = 2
SHARD_PIECES = 20_000
_JOINED = 1000
_END = 1  # the place of the end id among the chunks known
_PART_BYTES = 1_000_000
_BATCH_BYTES = 4_000_000
#: Characters of the chunks that a task remembers with their ids.
_KNOWN_CHARS = 4_000_000
_SPACES = r"[ \t\n\x0b\x0c\r]+"
_CUT = r"([a-z0-9])([.,;:!?|*#$%&])"


class ChunkEncoder:
    """Token ids of texts; a white-space-free chunk is encoded once, until the chunks known hold over ``_KNOWN_CHARS`` characters.

    Chunks are made few by steps that can't change the ids: the tokenizer lower-cases anyway, and it always cuts between a letter
    or digit and a sign other than the apostrophe.
    """

    def __init__(self, tokenizer_path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        """Only the empty chunk, without an id, and the place of the end id stay."""
        self.known, self.chars = {"": 0}, 0
        self.flat, self.begins, self.sizes = np.array([self.end_id], np.uint32), np.zeros(2, np.int64), np.array([0, 1], np.int64)

    def _places(self, chunks: list[str]) -> np.ndarray:
        """Where ``begins`` and ``sizes`` have the chunks, which differ; unknown ones are encoded first."""
        if self.chars > _KNOWN_CHARS:
            self._forget()
        places = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        unknown = np.flatnonzero(places < 0)
        if len(unknown):
            new = [chunks[i] for i in unknown.tolist()]
            flat, some = self._encode_chunks(new)
            places[unknown] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            self.known.update(zip(new, places[unknown].tolist()))
            self.chars += sum(map(len, new))
            self.begins = np.append(self.begins, len(self.flat) + np.cumsum(some) - some)
            self.sizes, self.flat = np.append(self.sizes, some), np.append(self.flat, flat)
        return places

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other, number of ids of each chunk); many chunks share one call, told apart by offsets."""
        flat, sizes = [], []
        for low in range(0, len(chunks), _JOINED):
            part = chunks[low : low + _JOINED]
            done = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(c) + 1 for c in part])
            of = np.searchsorted(ends, np.fromiter(map(itemgetter(0), done.offsets), np.int64, len(done)), "right")
            flat.append(np.array(done.ids, np.uint32))
            sizes.append(np.bincount(of, minlength=len(part)))
        return np.concatenate(flat or [np.zeros(0, np.uint32)]), np.concatenate(sizes or [np.zeros(0, np.int64)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, bounds of each text in them); the end id closes every text."""
        filled = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = pc.match_substring(filled, "<|")  # may hold a special token, which lower-casing and cutting would touch
        if not pc.any(marked).as_py():
            return self._encode_plain(filled)
        ids, bounds = self._encode_plain(pc.if_else(marked, "", filled))
        parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for k in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
            whole = self.tokenizer.encode(filled[k].as_py(), add_special_tokens=False).ids
            parts[k] = np.array([*whole, self.end_id], np.uint32)
        return np.concatenate(parts), np.cumsum([0, *[len(x) for x in parts]])

    def _encode_plain(self, filled: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lowered = pc.ascii_lower(filled)
        spaced = pc.replace_substring_regex(pc.replace_substring_regex(lowered, _CUT, r"\1 \2"), _SPACES, " ")
        lists = pc.split_pattern(spaced, " ")
        coded = lists.flatten().dictionary_encode()
        bounds = lists.offsets.to_numpy()
        places = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        chunk = np.insert(places, bounds[1:] - bounds[0], _END)
        n = self.sizes[chunk]
        stops = np.cumsum(n)
        ids = self.flat[np.repeat(self.begins[chunk] - (stops - n), n) + np.arange(int(n.sum()))]
        return ids, np.concatenate([[0], stops[np.flatnonzero(chunk == _END)]])


def _by_size(batch: pa.RecordBatch):
    """Slices of about ``_PART_BYTES`` of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // _PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.take(pa.array(np.arange(low, high)))  # a copy: string kernels misread some slices


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows and a remainder of each document."""

    def run(batches):
        encoder = ChunkEncoder(tokenizer_path, end_id)
        for b in batches:
            for part in _by_size(b):
                rows = []
                ids, bounds = encoder.encode(part.column("text"))
                for k, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    data = ids[low:high].astype("<u4", copy=False)
                    for s in range(0, len(data), window):
                        cut = data[s : s + window]
                        rows.append((k, s, len(cut), zlib.crc32(cut.tobytes()), len(data)))
                cols = list(zip(*rows))
                taken = part.column("doc_id").take(pa.array(cols[0]))
                yield pa.RecordBatch.from_arrays([taken, *[pa.array(c, pa.int64()) for c in cols[1:]]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        encoder = b = part = ids = data = cut = rows = cols = taken = None
        give_back()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return picked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class BestFit:
    """Open windows by remaining capacity; a segment tree over capacities finds the tightest that fits."""

    def __init__(self, window: int):
        self.window = window
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)  # how many open windows lie below a node
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least ``need`` among open windows."""
        i = need + self.leaves
        if self.tree[i]:
            return need
        while i > 1:
            if not i & 1 and self.tree[i + 1]:  # a right neighbour holds larger capacities
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None

    def place(self, length: int, fresh: int) -> tuple[int, int, bool]:
        """(window, offset in it, whether ``fresh`` was opened)."""
        room = self.tightest(length)
        opened = room is None
        if opened:
            room, which = self.window, fresh
        else:
            which = self.open[room].pop()
            self._add(room, -1)
        left = room - length
        if left:
            self.open[left].append(which)
            self._add(left, 1)
        return which, self.window - room, opened


def pack(found: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``found`` is read three times, so pass a written table."""
    spark = found.sparkSession
    shards = max(1, -(-found.where(F.col("length") < window).count() // shard_pieces))
    # every shard numbers its sequences from shard * 2^40; whole windows count on in their own range
    rest = found.where(F.col("length") < window).withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", F.monotonically_increasing_id()), F.lit(shards)))

    def fit(batches):
        shard, fitter, made = None, None, 0
        for b in batches:
            seq, off = [], []
            for s, n in zip(b.column("shard").to_pylist(), b.column("length").to_pylist()):
                if s != shard:
                    shard, fitter, made = s, BestFit(window), 0
                which, offset, opened = fitter.place(n, made)
                made += opened
                seq.append((shard << 40) + which)
                off.append(offset)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*names, "sequence_id", "offset"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // 8)))
    packed = (
        rest.repartition(tasks, "shard")
        .sortWithinPartitions("shard", F.desc("length"), "doc_id", "start", "ids_crc32")
        .mapInArrow(fit, schema)
    )
    whole = found.where(F.col("length") == window).withColumn("sequence_id", F.lit(shards << 40) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    return pack(materialize(pieces(docs, tokenizer_path, window, end_id), "pieces", batch_bytes=_BATCH_BYTES), window, shard_pieces)
