"""Long series of few stations, cut into ranges of time that tasks scan alone.

A window over a series is one task for each key. ``cut`` marks each row with a range (``_slice``) of its series, so that windows can be
partitioned by key and range. What lies over a range's edge comes in one of two ways:

* ``scan``: rules of bounded reach see the rows near an edge on both sides of it (a halo, dropped afterwards). Rules that are
  sequential but start anew in calm stretches have their edges moved there; an edge without a calm place nearby is given up, so a
  series that is never calm stays whole.
* ``carried``: what has no bound (the last known value) is folded over a small table, a row a range, and joined back.

Rows without a stamp belong to the first range.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about; and the most ranges, which bounds the work of a row.
ROWS, PARTS = 8_192, 256


def micros(df: DataFrame, ts: str) -> Column:
    """The order of a series as a long: microseconds of a stamp, a whole number as it is."""
    return F.unix_micros(F.col(ts).cast("timestamp")) if df.schema[ts].dataType.typeName().startswith("timestamp") else F.col(ts).cast("long")


def edges(df: DataFrame, ts: str, rows: int = ROWS, apart: float = 0.0, parts: int = PARTS) -> list[int]:
    """Microseconds at which ranges begin, all but the first: ranges of about ``rows`` rows, more than ``apart`` seconds long. One pass over the stamps."""
    steps = [k / parts for k in range(1, parts)]
    n, found = df.select(micros(df, ts).alias("t")).agg(F.count("t"), F.percentile_approx("t", F.array(*map(F.lit, steps)), F.lit(10 * parts))).first()
    wanted = min(parts, -(-n // rows))
    out: list[int] = []
    for k in range(1, wanted):
        at = found[max(0, round(k * parts / wanted) - 1)]
        if not out or at - out[-1] > apart * 1e6:
            out.append(at)
    return out


def _calm(df: DataFrame, keys: Sequence[str], ts: str, cuts: Sequence[int], rules: Sequence[tuple[str, float, int]], step_seconds: float, look: float) -> DataFrame:
    """(keys, _cuts): for every series the edges, each moved to the first row after it that ends a calm stretch for all rules.

    Calm: the row and the ``max_len`` + 1 before it have values, follow each other within a step and make no jump above the threshold.
    Only rows within ``look`` seconds of an edge are looked at.
    """
    t, known = F.col("_t"), F.array(*[F.lit(c).cast("long") for c in cuts])
    near = df.select(*keys, *dict.fromkeys(c for c, _, _ in rules), micros(df, ts).alias("_t")).withColumn("_k", F.size(F.filter(known, lambda c: c <= t)))
    near = near.where((F.col("_k") > 0) & (t - F.element_at(known, F.greatest("_k", F.lit(1))) <= int(look * 1e6)))
    order = Window.partitionBy(*keys, "_k").orderBy("_t")
    calm = F.lit(True)
    gap = t - F.lag("_t").over(order)
    for k, (column, threshold, length) in enumerate(rules):
        quiet = (F.abs(F.col(column) - F.lag(column).over(order)) <= threshold) & (gap > 0) & (gap <= int(step_seconds * 1e6))
        near = near.withColumn(f"_q{k}", F.coalesce(quiet, F.lit(False)).cast("int"))
        calm = calm & (F.sum(f"_q{k}").over(order.rowsBetween(-(length + 1), 0)) == length + 2)
    found = near.withColumn("_calm", calm).where("_calm").groupBy(*keys, "_k").agg(F.min("_t").alias("_c"))
    return found.groupBy(*keys).agg(F.sort_array(F.collect_list("_c")).alias("_cuts"))


def cut(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", cuts: DataFrame | Sequence[int] = ()) -> DataFrame:
    """``df`` with ``_slice``, the number of edges at or before the row's stamp, and ``_cuts``, the edges of its series."""
    if isinstance(cuts, DataFrame):
        named = cuts.withColumnsRenamed({c: f"_g_{c}" for c in keys})
        base = df.join(named, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in keys], "left").drop(*named.columns[:-1]) if keys else df.join(F.broadcast(named), F.lit(True), "left")  # a row a series
        base = base.withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<bigint>")))
    else:
        base = df.withColumn("_cuts", F.array(*[F.lit(c).cast("long") for c in cuts]).cast("array<bigint>"))
    t = micros(base, ts)
    return base.withColumn("_slice", F.size(F.filter("_cuts", lambda c: c <= t)))


def scan(df: DataFrame, run: Callable[[DataFrame, list[str]], DataFrame], keys: Sequence[str] = (), ts: str = "ts", *, before: float = 0.0, after: float = 0.0, calm: Sequence[tuple[str, float, int]] = (), step_seconds: float = 300.0, stamps: DataFrame | None = None, rows: int = ROWS, look: float = 21_600.0) -> DataFrame:
    """``run(df, keys)`` with a range as a further key: the same rows as ``run(df, keys)`` on whole series, from as many tasks as there are ranges.

    ``run`` keeps all columns that it gets and looks ``before`` and ``after`` seconds away at most. ``calm``: (column, threshold, max_len) of
    sequential rules in it, between which a calm stretch is a fresh start. ``stamps``: a frame with the same stamps that is cheaper to read.
    """
    cuts = edges(df if stamps is None else stamps, ts, rows, before + after + (look if calm else 0.0))
    if not cuts:
        return run(df, list(keys))
    marked = cut(df, keys, ts, _calm(df, keys, ts, cuts, calm, step_seconds, look) if calm else cuts)
    at, own = micros(marked, ts), F.col("_slice")
    begins, ends = F.get("_cuts", own - 1), F.get("_cuts", own)
    copies = F.array(F.struct(own.alias("s"), F.lit(False).alias("h")), F.when(at < begins + int(after * 1e6), F.struct((own - 1).alias("s"), F.lit(True).alias("h"))), F.when(at >= ends - int(before * 1e6), F.struct((own + 1).alias("s"), F.lit(True).alias("h"))))
    spread = marked.withColumn("_copy", F.explode(F.filter(copies, lambda c: c.isNotNull()))).withColumns({"_slice": F.col("_copy.s"), "_halo": F.col("_copy.h")}).drop("_copy", "_cuts")
    return run(spread.repartition(*keys, "_slice"), [*keys, "_slice"]).where(~F.col("_halo")).drop("_slice", "_halo")


def carried(df: DataFrame, values: Mapping[str, Column], keys: Sequence[str] = (), ts: str = "ts", backwards: bool = False) -> DataFrame:
    """``df``, marked by ``cut``, with the last known of each of the values up to the row; ``backwards``: the next known from the row on."""
    order = F.desc if backwards else F.asc
    w = Window.partitionBy(*keys, "_slice").orderBy(order(ts)).rowsBetween(Window.unboundedPreceding, 0)
    at = [F.when(v.isNotNull(), F.struct(micros(df, ts).alias("t"), v.alias("v"))) for v in values.values()]
    pick = F.min_by if backwards else F.max_by
    ends = df.groupBy(*[F.col(c).alias(f"_g_{c}") for c in keys], F.col("_slice").alias("_g__slice")).agg(*[pick(a["v"], a["t"]).alias(f"_e{k}") for k, a in enumerate(at)])
    over = Window.partitionBy(*[f"_g_{c}" for c in keys]) if keys else Window.partitionBy(F.lit(0))  # a row a range
    over = over.orderBy(order("_g__slice")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[f"_g_{c}" for c in [*keys, "_slice"]], *[F.last(f"_e{k}", True).over(over).alias(f"_e{k}") for k in range(len(at))])
    local = df.withColumns({n: F.last(v, True).over(w) for n, v in values.items()})
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in [*keys, "_slice"]]
    return local.join(ends, same).withColumns({n: F.coalesce(n, f"_e{k}") for k, n in enumerate(values)}).drop(*ends.columns)


def _beside(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the row of its range in ``small``, whose keys have a _g_ in front."""
    return df.join(small, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in [*keys, "_slice"]]).drop(*[f"_g_{c}" for c in [*keys, "_slice"]])


def _ranges(df: DataFrame, keys: Sequence[str], **made: Column) -> DataFrame:
    return df.groupBy(*[F.col(c).alias(f"_g_{c}") for c in keys], F.col("_slice").alias("_g__slice")).agg(*[c.alias(n) for n, c in made.items()])


def _over(keys: Sequence[str]):
    """The ranges of a series in order: a row each."""
    return (Window.partitionBy(*[f"_g_{c}" for c in keys]) if keys else Window.partitionBy(F.lit(0))).orderBy("_g__slice")


def numbered(df: DataFrame, keys: Sequence[str], ts: str, name: str) -> DataFrame:
    """``df``, marked by ``cut``, with the number of the row in its series, from 1."""
    counts = _ranges(df, keys, _m=F.count("*"))
    before = counts.withColumn("_m", F.coalesce(F.sum("_m").over(_over(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(ts))
    return _beside(df.withColumn(name, inner), before, keys).withColumn(name, F.col(name) + F.col("_m")).drop("_m")


def shifted(df: DataFrame, values: Mapping[str, Column], keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """``df``, marked by ``cut``, with values of the row before in the series; the first row of a range takes them from the last of the range before."""
    inner = Window.partitionBy(*keys, "_slice").orderBy(ts)
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    last = _ranges(df, keys, _e=F.max_by(packed, micros(df, ts)))
    last = last.withColumn("_e", F.lag("_e").over(_over(keys)))
    marked = df.withColumns({"_first": F.row_number().over(inner) == 1} | {n: F.lag(v).over(inner) for n, v in values.items()})
    return _beside(marked, last, keys).withColumns({n: F.when(F.col("_first"), F.col(f"_e.{n}")).otherwise(F.col(n)) for n in values}).drop("_first", "_e")
