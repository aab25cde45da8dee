"""Ranks, quantiles and neighbours in the order of a column, without a task for each group.

A group of up to ``WHOLE`` rows (counted first) is sorted by one task, which is the cheapest. Beyond that, with the same results, a
group of a third of all rows can't be: for quantiles its equal values are counted first; its rows (or distinct values) are dealt by value over ``PARTS`` ranges of about equal count, each
range is sorted alone, and what lies before it comes from a table of counts, a row a range. The bounds of the ranges are approximate;
ranks and quantiles are exact. They are written to the shared folder first, so that every use sees the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

PARTS = 64
WHOLE = 1_000_000


def _small(df: DataFrame, by: Sequence[str], whole: int) -> bool:
    """Whether no group has more than ``whole`` rows."""
    return (df.groupBy(*by).agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0) <= whole


def _group(by: Sequence[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def _same(names: Sequence[str], other: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in names]


def _beside(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the row of its group in ``small``, whose keys are named with a _g_ in front; a single row without keys."""
    return df.join(small, _same(by, "_g_")).drop(*[f"_g_{c}" for c in by]) if by else df.crossJoin(F.broadcast(small))  # one row


def dealt(df: DataFrame, order: str, by: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """``df`` with ``_part``: the range of its group that the row's value lies in; equal values share one. Rows without a value go."""
    known = df.where(F.col(order).isNotNull())
    number = F.unix_micros(F.col(order).cast("timestamp")) if df.schema[order].dataType.typeName().startswith("timestamp") else F.col(order)
    path = scratch_path(df.sparkSession, "ranges")
    cuts = F.percentile_approx(number, [k / parts for k in range(1, parts)], 20 * parts)
    known.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(cuts.alias("_cuts")).write.parquet(path)
    bounds = df.sparkSession.read.parquet(path)
    return _beside(known, bounds, by).withColumn("_part", F.size(F.filter("_cuts", lambda x: x < number))).drop("_cuts")


def ranked(df: DataFrame, order: str, by: Sequence[str] = (), whole: int = WHOLE) -> DataFrame:
    """``df`` with ``_rank``, from 0 in the order of the column, and ``_n``, the rows of the group. Rows without a value go."""
    known = df.where(F.col(order).isNotNull())
    if _small(known, by, whole):
        return known.withColumns({"_rank": F.row_number().over(_group(by).orderBy(order)) - 1, "_n": F.count("*").over(_group(by))})
    rows = dealt(df, order, by)
    group = _group([f"_g_{c}" for c in by])  # PARTS rows a group
    counts = rows.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_part").alias("_g__part")).agg(F.count("*").alias("_m"))
    counts = counts.withColumns({"_n": F.sum("_m").over(group), "_before": F.sum("_m").over(group.orderBy("_g__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")}).drop("_m")
    inner = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(order))
    return _beside(rows.withColumn("_inner", inner), counts, [*by, "_part"]).withColumn("_rank", F.col("_before") + F.col("_inner") - 1).drop("_inner", "_before", "_part")


def counted(df: DataFrame, column: str, by: Sequence[str] = (), whole: int = WHOLE) -> DataFrame:
    """(by, column, _m, _before, _n): each distinct value of a group, how many rows have it, how many have less, and the group's rows.

    Equal values combine on the map side before anything is ordered, so that repeated ones cost nothing. Rows without a value go.
    """
    points = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_m"))
    path = scratch_path(df.sparkSession, "counted")
    points.write.parquet(path)
    points = df.sparkSession.read.schema(points.schema).parquet(path)
    grow = lambda w, order: F.sum("_m").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    if _small(points, by, whole):
        w = _group(by)
        return points.withColumns({"_before": grow(w, column) - F.col("_m"), "_n": F.sum("_m").over(w)})
    rows = dealt(points, column, by)
    group = _group([f"_g_{c}" for c in by])  # PARTS rows a group
    parts = rows.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_part").alias("_g__part")).agg(F.sum("_m").alias("_p"))
    parts = parts.withColumns({"_n": F.sum("_p").over(group), "_start": F.sum("_p").over(group.orderBy("_g__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_p")}).drop("_p")
    inner = rows.withColumn("_inner", grow(Window.partitionBy(*by, "_part"), column) - F.col("_m"))
    return _beside(inner, parts, [*by, "_part"]).withColumn("_before", F.col("_start") + F.col("_inner")).drop("_inner", "_start", "_part")


def quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = (), whole: int = WHOLE) -> DataFrame:
    """(by, q): the exact quantiles, linear between neighbours, as an array."""
    known = df.select(*by, column).where(F.col(column).isNotNull())
    if _small(known, by, whole):
        return known.groupBy(*by).agg(F.percentile(column, F.array(*[F.lit(float(p)) for p in shares])).alias("q"))
    rows = counted(known, column, by, whole)
    at = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    value = F.col(column).cast("double")
    pick = lambda place: F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_m")), value))
    # the value that holds the place, and that which holds the next
    ends = [F.struct(pick(F.floor(at(p))).alias("a"), pick(F.least(F.floor(at(p)) + 1, F.col("_n") - 1)).alias("b"), F.max(at(p) - F.floor(at(p))).alias("w")).alias(f"_q{k}") for k, p in enumerate(shares)]
    got = rows.groupBy(*by).agg(*ends)
    line = lambda k: F.col(f"_q{k}.a") + (F.col(f"_q{k}.b") - F.col(f"_q{k}.a")) * F.col(f"_q{k}.w")
    return got.select(*by, F.array(*[line(k) for k in range(len(shares))]).alias("q"))


def previous(df: DataFrame, columns: Sequence[str], order: str, by: Sequence[str] = (), suffix: str = "_prev", whole: int = WHOLE) -> DataFrame:
    """``df`` with the columns of the row before in the group. The first row of a range has the last of the range before."""
    known = df.where(F.col(order).isNotNull())
    if _small(known, by, whole):
        return known.withColumns({f"{c}{suffix}": F.lag(c).over(_group(by).orderBy(order)) for c in columns})
    rows = dealt(df, order, by)
    inner = Window.partitionBy(*by, "_part").orderBy(order)
    group = _group([f"_g_{c}" for c in by])  # PARTS rows a group
    last = rows.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_part").alias("_g__part")).agg(F.max_by(F.struct(*columns), order).alias("_last"))
    last = last.withColumn("_edge", F.lag("_last").over(group.orderBy("_g__part"))).drop("_last")
    marked = rows.withColumns({"_first": F.row_number().over(inner) == 1} | {f"{c}{suffix}": F.lag(c).over(inner) for c in columns})
    joined = _beside(marked, last, [*by, "_part"])
    return joined.withColumns({f"{c}{suffix}": F.when(F.col("_first"), F.col(f"_edge.{c}")).otherwise(F.col(f"{c}{suffix}")) for c in columns}).drop("_first", "_edge", "_part")


def tile(bins: int) -> Column:
    """The 1-based tile of a ``ranked`` row: tiles of nearly equal count, larger ones first."""
    small, extra, rank = F.floor(F.col("_n") / bins), F.col("_n") % bins, F.col("_rank")
    large = (small + 1) * extra
    return F.when(rank < large, F.floor(rank / (small + 1))).otherwise(extra + F.floor((rank - large) / F.greatest(small, F.lit(1)))) + 1
