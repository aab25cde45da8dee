"""Shared helpers of the training-data operators.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Java-regex class of the white space that separates words in every contract.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: The same six characters, for ``translate``.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Whether Spark deletes the shuffle files of a query as soon as it ends.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Paths of the tables written in a block of ``temporary``.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, _UPPER, _UPPER.lower())


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and further nullable fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a session in one process gets a temporary one; a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="mesoflux-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, path: str | None = None, batch_bytes: int | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read it back, so that lost executors cost no recomputation.

    Once the table is written nothing reads its shuffle files again; they are deleted then, not when the driver's garbage is collected.
    ``batch_bytes``: bytes of the Arrow batches that go to Python, which both sides hold whole.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    wanted = {_SWEEP: "true"} | ({_BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing refers to any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator:
    """A block whose materialized tables are deleted when it ends, all but those that its value (called like ``materialize``) writes.

    Those belong to the block around, if there is one. Nothing that is read later may refer to the others.
    """
    outer, made = _MADE.get(), []
    token = _MADE.set(made)

    def keep(df: DataFrame, label: str) -> DataFrame:
        written = materialize(df, label)
        path = made.pop()
        if outer is not None:
            outer.append(path)
        return written

    try:
        yield keep
    finally:
        _MADE.reset(token)
        for path in made:
            discard(spark, path)


def give_back() -> None:
    """Return what a task in Python has freed to the system; Spark keeps the process for later tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted`` with as many underscores as it takes to differ from all columns of ``df``, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def rekey(col: Column) -> Column:
    """A join key equal to ``col`` that Spark can't recognise as the partitioning of an aggregate.

    An aggregate's output keeps its hash partitioning, and a join on the same key would reuse it. The re-derived key makes
    Spark shuffle both sides anew, and only such an exchange is split by adaptive execution where a key is hot.
    """
    return F.when(col.isNotNull(), col)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find over an edge list of longs: (node, component), component = the smallest node of it.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round links every node to the least node that
    it can see, in O(log^2 n) rounds. All work is joins and aggregates; hot nodes are split by adaptive skew joins; a
    round's edges are written to the shared folder and deleted after the next. Null ends and self links are ignored; nodes without a link don't appear.
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").where(
        F.col("u").isNotNull() & F.col("v").isNotNull()
    )
    # greatest/least skip nulls, so a null end turns into a self link, which "u > v" removes
    spark, path = edges.sparkSession, scratch_path(edges.sparkSession, "edges")
    now = materialize(pair.distinct(), "edges", path)
    mark = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(rekey(F.col("u")).alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        keyed = low.select(rekey(F.col("u")).alias("k"), "m")
        small = large.join(keyed, F.col("u") == F.col("k")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, path = path, scratch_path(spark, "edges")
        now = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges", path)
        discard(spark, old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def sampled(df: DataFrame, weight: Column, bound: int, *by: str, salt: str = "sample") -> DataFrame:
    """Rows of ``df`` whose summed ``weight`` is about ``bound`` at most, in each group of ``by``.

    A row stays if its hash falls under bound / total, so the sample is spread over the whole table, needs no sort and is the
    same each time. Groups within the bound stay whole.
    """
    total = df.groupBy(*by).agg(F.sum(weight).alias("_total")).select(
        *[F.col(c).alias(f"_g_{c}") for c in by], F.least(F.lit(1.0), F.lit(float(bound)) / F.greatest(F.col("_total"), F.lit(1))).alias("_share")
    )
    cond = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    joined = df.join(F.broadcast(total), cond) if by else df.crossJoin(F.broadcast(total))
    draw = F.pmod(F.xxhash64(F.lit(salt), *[F.col(c) for c in df.columns]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return joined.where(draw < F.col("_share")).select(*df.columns)
