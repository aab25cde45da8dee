"""URL filter over a sorted digest array.

A rule is a host and a path prefix. The two, with a zero character between, are hashed with 64-bit XXH64; the keys are stored sorted, in a file
that every executor maps into memory, beside the full strings and the verdicts. A url is probed with each suffix of its host at a
label boundary times each path prefix whose length occurs among the rules; all probes of a batch go through one vectorised binary
search, and an equal key counts only if the stored string is the probe's own. The longest rule wins, of equally long ones the one
with the longer host.

Odd input: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the default verdict. Repeated
rows are judged row by row; an empty table gives an empty result. Only the url is read; other columns pass through, those named
host, path, rule or verdict being replaced.
"""

from __future__ import annotations

import hashlib
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import extended

#: Fixed values: (host, path prefix, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class DigestArray:
    """Sorted keys, the strings that they stand for and their verdicts, as memory-mapped arrays."""

    def __init__(self, keys, offsets, blob, verdicts, lengths, hasher=digest):
        self.keys, self.offsets, self.blob, self.verdicts, self.lengths, self.hasher = keys, offsets, blob, verdicts, lengths, hasher

    @classmethod
    def build(cls, rules, hasher=digest) -> DigestArray:
        """The first of rules with the same host and path stays."""
        unique: dict[str, tuple[str, str]] = {}
        for host, path, verdict in rules:
            unique.setdefault(f"{host}\0{path}", (path, verdict))
        rows = sorted((hasher(s), s.encode(), v) for s, (_, v) in unique.items())
        return cls(
            np.array([h for h, _, _ in rows], np.uint64),
            np.cumsum([0, *[len(s) for _, s, _ in rows]]),
            np.frombuffer(b"".join(s for _, s, _ in rows), np.uint8),
            np.array([v == "block" for _, _, v in rows], bool),
            np.array(sorted({len(p) for p, _ in unique.values()}), np.int64),
            hasher,
        )

    PARTS = ("keys", "offsets", "blob", "verdicts", "lengths")

    def send(self, spark: SparkSession) -> str:
        """Hand the arrays to every executor as files; returns their common name."""
        name = "digests-" + hashlib.sha1(b"".join(getattr(self, p).tobytes() for p in self.PARTS)).hexdigest()[:16]
        if any(f"{name}-{self.PARTS[-1]}" in f for f in spark.sparkContext.listFiles):
            return name  # this very content has been handed out before
        folder = Path(tempfile.mkdtemp(prefix="digests-"))
        for part in self.PARTS:
            path = folder / f"{name}-{part}.npy"
            np.save(path, getattr(self, part))
            spark.sparkContext.addFile(str(path))
        return name

    @classmethod
    def mapped(cls, name: str) -> DigestArray:
        load = lambda part: np.load(SparkFiles.get(f"{name}-{part}.npy"), mmap_mode="r")
        return cls(*[load(p) for p in cls.PARTS])

    def find(self, probes: list[str]) -> np.ndarray:
        """For each probe the place of its own string, or -1."""
        keys = np.array([self.hasher(p) for p in probes], np.uint64)
        at = np.searchsorted(self.keys, keys, "left")
        out = np.full(len(probes), -1, np.int64)
        equal = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)) if len(self.keys) else []
        for j in equal:
            own, k = probes[j].encode("utf-8", "surrogatepass"), int(at[j])
            while k < len(self.keys) and self.keys[k] == keys[j]:  # keys that collide stand side by side
                if self.string(k) == own:
                    out[j] = k
                    break
                k += 1
        return out

    def string(self, k: int) -> bytes:
        return self.blob[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, bool | None]]:
        """(rule, blocks) of the winning rule of each url, or (None, None)."""
        probes, owner, host_size = [], [], []
        lengths = self.lengths.tolist()
        for j, (host, path) in enumerate(zip(hosts, paths)):
            if not host:
                continue
            suffix = host
            while True:
                for n in lengths:
                    if n <= len(path):
                        probes.append(f"{suffix}\0{path[:n]}")
                        owner.append(j)
                        host_size.append(len(suffix))
                dot = suffix.find(".")
                if dot < 0:
                    break
                suffix = suffix[dot + 1 :]
        best: dict[int, tuple[int, int, int]] = {}
        for p, k in enumerate(self.find(probes).tolist()):
            if k >= 0:
                best[owner[p]] = max(best.get(owner[p], (0, 0, 0)), (len(probes[p]), host_size[p], k))
        out: list[tuple[str | None, bool | None]] = [(None, None)] * len(hosts)
        for j, (_, _, k) in best.items():
            out[j] = (self.string(k).decode("utf-8", "surrogatepass").replace("\0", "", 1), bool(self.verdicts[k]))
        return out


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict."""
    spark = pages.sparkSession
    name = DigestArray.build(rules).send(spark)
    made = {"host", "path", "rule", "verdict"}
    through = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in made]
    base = pages.select(*through, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    schema = extended(base, "rule string, verdict string")

    def run(batches):
        array = DigestArray.mapped(name)
        for b in batches:
            found = array.judge(b.column("host").to_pylist(), b.column("path").to_pylist())
            rule = pa.array([r for r, _ in found], pa.string())
            verdict = pa.array([default if v is None else "block" if v else "allow" for _, v in found], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], [*b.schema.names, "rule", "verdict"])

    return base.mapInArrow(run, schema)
