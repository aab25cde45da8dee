"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

1. ``PieceModel`` reads pieces, scores and kinds through the library and lists every pair of symbols that joins to a piece, with the
   rank of its score. Only identity normalisation with a dummy prefix is served; another model is an error.
2. Texts are one flat byte array, cut wherever no piece holds the two neighbouring bytes, so that no merge can cross a cut. Each distinct
   word of a batch is encoded once.
3. A round takes the least pair rank of every word (a segmented minimum), merges all its places at once from the left, and compacts the
   arrays; words without a pair leave. Where a merged piece could open a pair that goes before its own rank, only the leftmost place is
   merged in that round, which keeps the library's order exactly. Long words are merged alone, by linked places.
4. Decoding gathers piece surfaces by id; byte pieces become bytes, and bytes that are no UTF-8 become U+FFFD, one each.

Odd input: null and empty texts have no ids and decode to the empty text. Repeated rows give repeated rows. Only the text column is read;
input columns named like an output column are replaced, whatever their case. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Words of more symbols than this are merged one at a time.
LONG = 2_000
PART_BYTES = 16_000_000
_NONE = np.int64(1) << 40
_SHIFT = 22
_META = "▁"


class PieceModel:
    """Pieces of a BPE model as arrays."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        if sp.encode("") or sp.decode(sp.encode(" a  ａ")) != " a  ａ" or sp.encode("a", out_type=str)[0][0] != _META:
            raise ValueError("only models with identity normalisation and a dummy prefix are served")
        self.size = sp.get_piece_size()
        self.bytes_from = next(i for i in range(self.size) if sp.is_byte(i))
        if [sp.id_to_piece(self.bytes_from + b) for b in range(256)] != [f"<0x{b:02X}>" for b in range(256)]:
            raise ValueError("the model has no byte pieces in a row")
        names = {sp.id_to_piece(i): i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        scores = {p: sp.get_score(i) for p, i in names.items()}
        rank_of = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.single = np.arange(0x110000, dtype=np.int64) + self.size  # characters without a piece
        for p, i in names.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.single[0x20] = self.single[ord(_META)]
        symbol = lambda x: names.get(x) if len(x) > 1 else int(self.single[ord(x)])
        keys, merged, ranks, opens = [], [], [], set()
        for p, i in names.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    keys.append((a << _SHIFT) + b)
                    merged.append(i)
                    ranks.append(rank_of[scores[p]])
                    opens.update(x for x, s in ((a, p[:k]), (b, p[k:])) if len(s) > 1 and scores[s] <= scores[p])
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged, self.ranks = (np.array(x, np.int64)[order] for x in (keys, merged, ranks))
        self.alone = np.zeros(self.size, bool)  # pieces of which only the leftmost place is merged in a round
        self.alone[list(opens)] = True
        times = Counter(scores.values())
        self.alone[[i for p, i in names.items() if times[scores[p]] > 1]] = True
        self.joined = np.zeros((256, 256), bool)
        self.joined[:, 0x80:0xC0] = True  # inside a character
        surfaces = []
        for i in range(self.size):
            p = sp.id_to_piece(i)
            if names.get(p) == i:
                surfaces.append(p.replace(_META, " ").encode())
                pair = np.frombuffer(surfaces[-1], np.uint8)
                self.joined[pair[:-1], pair[1:]] = True
            elif sp.is_byte(i):
                surfaces.append(bytes([i - self.bytes_from]))
            else:
                surfaces.append(" ⁇ ".encode() if sp.is_unknown(i) else b"")
        self.unknown = sp.unk_id()
        self.silent = np.array([not x for x in surfaces])
        self.surfaces = pa.array(surfaces, pa.large_binary())

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of pairs of symbols; a rank of ``_NONE`` where they don't join."""
        key = (left << _SHIFT) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), np.where(found, self.merged[at], 0)

    def chosen(self, hits: np.ndarray, word: np.ndarray | None, merged: np.ndarray) -> np.ndarray:
        """Of the places of the least rank (ascending), those to merge now: leftmost first, none overlapping.

        ``hits`` must count neighbouring pairs by neighbouring numbers; ``word`` is the word of each hit, None where all are in one.
        """
        run = np.flatnonzero(np.diff(hits, prepend=-2) != 1)
        offset = hits - np.repeat(hits[run], np.diff(run, append=len(hits)))
        first = np.arange(len(hits)) == 0 if word is None else np.diff(word, prepend=-1) != 0
        return (offset % 2 == 0) & (first | ~self.alone[merged])

    # -- encoding ---------------------------------------------------------------------------------------------------------------

    def merge(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the symbols of words that lie one after the other: (symbols, sizes) of the results."""
        n = len(sizes)
        if long := np.flatnonzero(sizes > LONG).tolist():
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            short = np.repeat(sizes <= LONG, sizes)
            done, out_sizes = self.merge(sym[short], sizes[sizes <= LONG])
            parts = iter(np.split(done, np.cumsum(out_sizes)[:-1]) if len(out_sizes) else [])
            alone = {k: self.merge_long(sym[bounds[k] : bounds[k + 1]]) for k in long}
            all_parts = [alone[k] if k in alone else next(parts) for k in range(n)]
            return np.concatenate(all_parts), np.array([len(x) for x in all_parts], np.int64)
        word = np.repeat(np.arange(n), sizes)
        rank, merged = self._ranked(sym, word)
        out_sym, out_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(starts, append=len(sym))
            if (ended := best == _NONE).any():
                gone = np.repeat(ended, lengths)
                out_sym.append(sym[gone])
                out_word.append(word[gone])
                sym, word, rank, merged = sym[~gone], word[~gone], rank[~gone], merged[~gone]
                if not len(sym):
                    break
                best, lengths = best[~ended], lengths[~ended]
            hits = np.flatnonzero(rank == np.repeat(best, lengths))
            hits = hits[self.chosen(hits, word[hits], merged[hits])]
            sym[hits] = merged[hits]
            stay = np.ones(len(sym), bool)
            stay[hits + 1] = False
            at = (np.cumsum(stay) - 1)[hits]
            sym, word, rank, merged = sym[stay], word[stay], rank[stay], merged[stay]
            fresh = np.zeros(len(sym) + 1, bool)
            fresh[at] = fresh[at - 1] = True  # the place before the first is the spare one at the end
            changed = np.flatnonzero(fresh[:-1])
            rank[changed], merged[changed] = self._ranked(sym, word, changed)
        if not out_sym:
            return sym, np.zeros(n, np.int64)
        all_words = np.concatenate(out_word)
        return np.concatenate(out_sym)[np.argsort(all_words, kind="stable")], np.bincount(all_words, minlength=n)

    def _ranked(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(sym)) if at is None else at
        after = np.minimum(at + 1, max(len(sym) - 1, 0))
        rank, merged = self.pairs(sym[at], sym[after])
        return np.where((after > at) & (word[after] == word[at]), rank, _NONE), merged

    def merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The same rounds over one word; merged places stay until half of them are gone, so a round is a scan for the minimum."""
        sym = sym.copy()
        rank, merged = self._ranked(sym, np.zeros(len(sym), np.int64))
        alive = np.ones(len(sym), bool)
        before, after = np.arange(len(sym)) - 1, np.arange(len(sym)) + 1
        while len(sym) and (best := rank.min()) < _NONE:
            hits = np.flatnonzero(rank == best)
            number = hits.copy()  # neighbouring pairs must have neighbouring numbers, whatever lies dead between them
            number[1:] = number[0] + np.cumsum(np.where(after[hits[:-1]] == hits[1:], 1, 2))
            hits = hits[self.chosen(number, None, merged[hits])]
            gone = after[hits]
            sym[hits] = merged[hits]
            rank[gone], alive[gone] = _NONE, False
            after[hits] = after[gone]
            inner = after[hits] < len(sym)
            before[after[hits][inner]] = hits[inner]
            touched = np.concatenate([hits, before[hits][before[hits] >= 0]])
            rank[touched] = _NONE
            touched = touched[after[touched] < len(sym)]
            rank[touched], merged[touched] = self.pairs(sym[touched], sym[after[touched]])
            if alive.sum() < len(sym) // 2:
                sym, rank, merged = sym[alive], rank[alive], merged[alive]
                alive = np.ones(len(sym), bool)
                before, after = np.arange(len(sym)) - 1, np.arange(len(sym)) + 1
        return sym[alive]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, bounds of each text in them)."""
        filled = pc.fill_null(texts.cast(pa.large_string()), "")
        if pc.any(pc.match_substring(filled, _META)).as_py():
            filled = pc.replace_substring(filled, _META, " ")
        mark, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        filled = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(filled), 0), none, mark), filled, none)
        ends = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
        data = np.frombuffer(filled.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        cut = np.ones(len(data), bool)
        np.logical_not(self.joined[data[:-1], data[1:]], out=cut[1:])
        cut[ends[:-1][ends[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data))
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        coded = words.dictionary_encode()
        flat, sizes = self._encode_words(coded.dictionary)
        begins = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        n = sizes[which]
        stops = np.cumsum(n)
        ids = flat[np.repeat(begins[which] - (stops - n), n) + np.arange(int(n.sum()))]
        return ids, np.concatenate([[0], stops])[np.searchsorted(starts, ends)]

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        sym, sizes = self.merge(self.single[points], pc.utf8_length(words).to_numpy().astype(np.int64))
        if len(odd := np.flatnonzero(sym >= self.size)):  # characters without a piece become their bytes
            word = np.repeat(np.arange(len(sizes)), sizes)
            data = [np.frombuffer(chr(c).encode(), np.uint8) for c in (sym[odd] - self.size).tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(x) for x in data]
            sizes = np.bincount(word, weights=times, minlength=len(sizes)).astype(np.int64)
            bytes_at = np.repeat(sym >= self.size, times)
            sym = np.repeat(sym, times)
            sym[bytes_at] = np.concatenate(data).astype(np.int64) + self.bytes_from
        return sym, sizes

    # -- decoding ---------------------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of the id sequences that ``bounds`` cut out of ``ids``."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id lies outside the model")
        got = self.surfaces.take(pa.array(ids))
        ends = np.frombuffer(got.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = memoryview(got.buffers()[2] or b"")
        texts, silent = [], bool(self.silent[ids].any())  # a piece without text ends a run of byte pieces
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            try:
                text = self._repaired(ids[low:high]) if silent and self.silent[ids[low:high]].any() else bytes(data[ends[low] : ends[high]]).decode()
            except UnicodeDecodeError:
                text = self._repaired(ids[low:high])
            texts.append(text[1:] if text[:1] == " " and self._opens(ids[low:high]) else text)
        return texts

    def _opens(self, ids: np.ndarray) -> bool:
        """Whether the blank at the beginning is the dummy prefix: it belongs to the first piece that isn't empty."""
        first = next(i for i in ids.tolist() if len(self.surfaces[i].as_py()))
        return first != self.unknown and not self.bytes_from <= first < self.bytes_from + 256

    def _repaired(self, ids: np.ndarray) -> str:
        """Text of ids whose byte pieces aren't UTF-8 throughout: every stray byte is one U+FFFD."""
        out, run = [], bytearray()
        for i in [*ids.tolist(), -1]:
            if self.bytes_from <= i < self.bytes_from + 256:
                run.append(i - self.bytes_from)
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:n]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                del run[:n]
            if i >= 0:
                out.append(self.surfaces[i].as_py().decode())
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model a worker process."""
    return PieceModel(path)


def _mapped(df: DataFrame, made: str, column: str, run) -> DataFrame:
    """``df`` with the columns of the DDL ``made``, which ``run`` makes of a part of ``column``; columns of these names are replaced."""
    new = [f.name for f in StructType.fromDDL(made).fields]
    kept = [c for c in df.columns if c.lower() not in new]

    def work(batches):
        for b in batches:
            for part in _parts(b, column):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *run(part.column(column))], [*kept, *new])

    fields = [f for f in df.schema.fields if f.name in kept]
    return df.mapInArrow(work, StructType([*fields, *StructType.fromDDL(made).fields]))


def _parts(batch: pa.RecordBatch, column: str):
    """Slices of about ``PART_BYTES`` of text or ids, so that a batch of long rows needs no more memory than one of short rows."""
    values = batch.column(column)
    sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    part = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.take(pa.array(np.arange(low, high)))  # a copy: string kernels misread some slices


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model_path: str, column: str = "text") -> DataFrame:
    """``docs`` with ``ids`` of the column's texts."""
    return _mapped(docs, "ids array<int>", column, lambda texts: [_lists(*model(model_path).encode(texts))])


def decode(tokens: DataFrame, model_path: str, column: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of the column's ids; null ids give the empty text."""

    def run(lists):
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return [pa.array(model(model_path).decode(pc.list_flatten(lists).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])), pa.string())]

    return _mapped(tokens, "decoded string", column, run)


def round_trip(docs: DataFrame, model_path: str, column: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, in one pass over the rows."""

    def run(texts):
        ids, bounds = model(model_path).encode(texts)
        return [_lists(ids, bounds), pa.array(model(model_path).decode(ids, bounds), pa.string())]

    return _mapped(docs, "ids array<int>, decoded string", column, run)
