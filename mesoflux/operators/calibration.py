"""Dated calibration factors, channel unification and checks of their windows.

Windows are inclusive by day: an end without a time of day means the whole day.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Calibration:
    column: str
    start: str | None = None
    end: str | None = None
    factor: float | None = 1.0


@dataclass(frozen=True)
class Switch:
    unified: str
    column: str
    start: str | None = None
    end: str | None = None


def in_window(ts: Column, start: str | None, end: str | None) -> Column:
    out = F.lit(True)
    if start is not None:
        out = out & (ts >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        whole_day = len(end.strip()) <= 10 or end.strip().endswith("00:00:00") or end.strip().endswith(" 00:00")
        stop = F.lit(end).cast("timestamp_ntz")
        out = out & (ts < stop + F.expr("INTERVAL 1 DAY") if whole_day else ts <= stop)
    return out


def _bounds(start: str | None, end: str | None) -> tuple[str, str]:
    low = start or "0001-01-01"
    high = end or "9999-12-31"
    return (low if len(low) > 10 else low + " 00:00:00"), (high if len(high) > 10 and not high.endswith("00:00:00") else high[:10] + " 23:59:59.999999")


def check_overlaps(windows: Sequence[tuple[str, str | None, str | None]]) -> None:
    """Raise on two windows of one key that overlap; rules are few, so this stays on the driver. Empty windows are skipped."""
    by: dict[str, list[tuple[str, str]]] = {}
    for key, start, end in windows:
        low, high = _bounds(start, end)
        if low <= high:
            by.setdefault(key, []).append((low, high))
    for key, spans in by.items():
        spans.sort()
        for (_, a), (b, _) in zip(spans, spans[1:]):
            if b <= a:
                raise ValueError(f"windows of {key} overlap at {b}")


def apply_calibrations(df: DataFrame, records: Sequence[Calibration], ts: str = "ts") -> DataFrame:
    """Multiply inside each window; a null factor blanks it. All records fold into one projection."""
    check_overlaps([(r.column, r.start, r.end) for r in records])
    new = {}
    for name in dict.fromkeys(r.column for r in records if r.column in df.columns):
        out = None
        for r in (r for r in records if r.column == name):
            value = F.col(name) * F.lit(r.factor) if r.factor is not None else F.lit(None).cast("double")
            out = (F if out is None else out).when(in_window(F.col(ts), r.start, r.end), value)
        new[name] = out.otherwise(F.col(name))
    return df.withColumns(new) if new else df


def calibration_matches(df: DataFrame, records: Sequence[Calibration], ts: str = "ts") -> DataFrame:
    """(record, matched): samples that each record touches; a record with 0 deserves a warning."""
    counts = [F.struct(F.lit(f"{r.column} {r.start}..{r.end}").alias("record"), (F.count_if(in_window(F.col(ts), r.start, r.end) & F.col(r.column).isNotNull()) if r.column in df.columns else F.lit(0).cast("long")).alias("matched")) for r in records]
    return df.agg(F.array(*counts).alias("r")).select(F.inline("r"))


def unify_columns(df: DataFrame, switches: Sequence[Switch], ts: str = "ts") -> DataFrame:
    """Each unified column takes its source's value inside that source's window, else null. Sources stay."""
    check_overlaps([(s.unified, s.start, s.end) for s in switches])
    new = {}
    for name in dict.fromkeys(s.unified for s in switches):
        parts = [F.when(in_window(F.col(ts), s.start, s.end), F.col(s.column)) for s in switches if s.unified == name and s.column in df.columns]
        new[name] = F.coalesce(*parts) if parts else F.lit(None).cast("double")
    return df.withColumns(new)


def window_overlaps(windows: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end, other_end): windows that begin within an earlier one of their key, of a rule table of any size."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return windows.where(F.col(start) <= F.col(end)).withColumn("other_end", F.max(end).over(w)).where(F.col(start) <= F.col("other_end")).select(key, start, end, "other_end")


def uncovered_gaps(windows: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, gap_start, gap_end): what lies between the windows of a key and in none of them (exclusive bounds)."""
    w = Window.partitionBy(key).orderBy(start, end)
    runs = windows.where(F.col(start) <= F.col(end)).withColumn("gap_start", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("gap_end", F.lead(start).over(w))
    return runs.where(F.col("gap_start") < F.col("gap_end")).select(key, "gap_start", "gap_end")


def uncalibrated(mapping: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Windows of ``mapping`` (column, start, end) that no calibration of the column covers; never-calibrated columns are exempt."""
    known = calibrations.where("start <= end")
    exempt = mapping.join(known.select("column").distinct(), "column", "left_semi")
    clipped = exempt.alias("m").join(known.alias("c"), "column").where("c.start <= m.end AND c.end >= m.start").select("column", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.greatest("c.start", "m.start").alias("s"), F.least("c.end", "m.end").alias("e"))
    ends = exempt.select("column", "start", "end", F.col("start").alias("s"), F.col("start").alias("e")).unionByName(exempt.select("column", "start", "end", F.col("end").alias("s"), F.col("end").alias("e")))
    w = Window.partitionBy("column", "start", "end").orderBy("s", "e")
    runs = clipped.unionByName(ends).withColumn("gap_start", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("gap_end", F.lead("s").over(w))
    return runs.where("gap_start < gap_end").select("column", "gap_start", "gap_end")


def resolve_windows(df: DataFrame, switches: Sequence[Switch], ts: str = "ts") -> DataFrame:
    """(unified, column, first, last): each switch with its open ends set to the record's own."""
    spark = df.sparkSession
    table = spark.createDataFrame([(s.unified, s.column, s.start, s.end) for s in switches if s.column in df.columns], "unified string, column string, start string, end string")
    span = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return table.crossJoin(span).select("unified", "column", F.coalesce(F.col("start").cast("timestamp_ntz"), "lo").alias("first"), F.coalesce(F.col("end").cast("timestamp_ntz"), "hi").alias("last"))


def shade_ring(df: DataFrame, factors: DataFrame, column: str, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Multiply a diffuse channel by the factor of its instant inside the window; a sample without one fails the job."""
    joined = df.join(factors.select(F.col(ts).alias("_ts"), F.col("fc").alias("_fc")), F.col(ts) == F.col("_ts"), "left")
    need = in_window(F.col(ts), start, end) & F.col(column).isNotNull()
    missing = F.raise_error(F.concat(F.lit("no shade-ring factor at "), F.col(ts).cast("string"))).cast("double")
    return joined.withColumn(column, F.when(need & F.col("_fc").isNull(), missing).when(need, F.col(column) * F.col("_fc")).otherwise(F.col(column))).drop("_ts", "_fc")
