"""Quality control of sensor records: gates, masks and checks.

Records are wide frames with one DOUBLE column a channel, or long ones with a value column; ``ts`` names the stamp and ``keys`` the
columns that identify a station. A missing value is null. Rules whose column isn't there are skipped, never an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import solar
from ..functions.atmosphere import computed
from ..functions.solar import Site

#: Coefficients of the physically possible limits, channel -> (gain, offset in W/m2).
CEILING = {"Sw_dw": (1.5, 100.0), "Sw_dif": (0.95, 50.0), "Sw_up": (1.2, 50.0), "Sw_par": (0.825, 55.0)}
FLOOR = -4.0
PAR_SHARE = 0.55


def _present(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def range_gate(df: DataFrame, limits: Sequence[tuple[str, float | None, float | None]]) -> DataFrame:
    """Values outside [lower, upper] become null."""
    new = {}
    for name, low, high in limits:
        if name in df.columns:
            c = new.get(name, F.col(name))
            ok = reduce(lambda a, b: a & b, [c >= low] * (low is not None) + [c <= high] * (high is not None), F.lit(True))
            new[name] = F.when(ok, c)
    return df.withColumns(new) if new else df


def range_violations(df: DataFrame, limits: Sequence[tuple[str, float | None, float | None]]) -> DataFrame:
    """(column, n) of channels that break their limits; one pass."""
    used = [(n, lo, hi) for n, lo, hi in limits if n in df.columns]
    if not used:
        return df.sparkSession.createDataFrame([], "column string, n long")
    bad = lambda n, lo, hi: F.count_if((F.col(n) < lo if lo is not None else F.lit(False)) | (F.col(n) > hi if hi is not None else F.lit(False)))
    one = df.agg(F.array(*[F.struct(F.lit(n).alias("column"), bad(n, lo, hi).alias("n")) for n, lo, hi in used]).alias("rows"))
    return one.select(F.inline("rows")).where("n > 0")


@dataclass(frozen=True)
class Sentinel:
    """kind: ``value`` (exact), ``range`` (outside lower..upper), ``window`` (exact value inside first..last) or ``invalid`` (whole window)."""

    column: str
    kind: str
    value: float | None = None
    lower: float | None = None
    upper: float | None = None
    first: str | None = None
    last: str | None = None


def _inside(ts: Column, first: str | None, last: str | None) -> Column:
    out = F.lit(True)
    if first is not None:
        out = out & (ts >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        out = out & (ts <= F.lit(last).cast("timestamp_ntz"))
    return out


def _sentinel(rule: Sentinel, c: Column, ts: Column) -> Column:
    window = _inside(ts, rule.first, rule.last)
    if rule.kind == "value":
        return c == F.lit(rule.value)
    if rule.kind == "range":
        return (c < rule.lower if rule.lower is not None else F.lit(False)) | (c > rule.upper if rule.upper is not None else F.lit(False))
    if rule.kind == "window":
        return (c == F.lit(rule.value)) & window
    if rule.kind == "invalid":
        return c.isNotNull() & window
    raise ValueError(f"unknown sentinel kind {rule.kind!r}")


def mask_sentinels(df: DataFrame, rules: Sequence[Sentinel], ts: str = "ts") -> DataFrame:
    """Blank what any rule marks. Rules of a column apply to the value that came in, so their order doesn't matter."""
    by: dict[str, list[Sentinel]] = {}
    for r in rules:
        by.setdefault(r.column, []).append(r)
    new = {n: F.when(~F.coalesce(reduce(lambda a, b: a | b, [_sentinel(r, F.col(n), F.col(ts)) for r in rs]), F.lit(False)), F.col(n)) for n, rs in by.items() if n in df.columns}
    return df.withColumns(new) if new else df


def removals(before: DataFrame, masked: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, removed) by counting non-null values on both sides."""
    def counts(df: DataFrame) -> DataFrame:
        return df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("n")) for c in columns]).alias("r")).select(F.inline("r"))

    return counts(before).alias("a").join(counts(masked).alias("b"), "column").select("column", (F.col("a.n") - F.col("b.n")).alias("removed")).where("removed > 0")


def persistent_runs(df: DataFrame, column: str, min_run: int, keys: Sequence[str] = (), ts: str = "ts", step: str = "5 minutes") -> DataFrame:
    """``df`` with ``column`` null wherever the same value stood longer than ``min_run`` samples on the exact grid.

    Gaps and missing values break a run. One window sort finds the runs (islands), one hash window counts them.
    """
    order = Window.partitionBy(*keys).orderBy(ts) if keys else Window.orderBy(ts)
    same = (F.col(column) == F.lag(column).over(order)) & (F.col(ts) == F.lag(ts).over(order) + F.expr(f"INTERVAL {step}"))
    run = df.withColumn("_starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(column).over(Window.partitionBy(*keys, "_run"))
    return run.withColumn(column, F.when(size <= min_run, F.col(column))).drop("_starts", "_run")


def step_excursions(df: DataFrame, column: str, threshold: float, return_tol: float, max_len: int, keys: Sequence[str] = (), ts: str = "ts", step_seconds: float = 300.0) -> DataFrame:
    """Blank short departures that leave and come back: a jump beyond the threshold, a jump back within ``max_len`` samples, and a value
    within ``return_tol`` of the one before it all.

    The end of a departure is found by looking ahead in one window. A departure may begin only after a sample that stays, so the rule is
    sequential: the sorted rows go through one scan in Arrow batches, whose only state is the end of the last departure, so that its time
    is linear however noisy the series. Null samples are left out of the rule. For a long series see ``segments.scan``.
    """
    valid = Window.partitionBy(*keys, F.col(column).isNull())
    order = valid.orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    step = micros - F.lag(micros).over(order)
    near = F.coalesce((step > 0) & (step <= int(2 * step_seconds * 1e6)), F.lit(False)) & F.col(column).isNotNull()
    base = df.withColumns({"_near": near, "_before": F.lag(column).over(order), "_i": F.row_number().over(order)})
    base = base.withColumn("_jump", F.when(F.col("_near"), F.col(column) - F.col("_before")))
    ahead = lambda c, d: F.lead(c, d).over(order)
    end, linked = F.lit(None).cast("int"), F.lit(True)
    cases = []
    for d in range(1, max_len + 1):
        linked = linked & F.coalesce(ahead("_near", d), F.lit(False))
        back = ahead("_jump", d)
        cases.append((linked & (F.abs(back) > threshold) & (back * F.col("_jump") < 0) & (F.abs(ahead(column, d) - F.col("_before")) <= return_tol), F.col("_i") + d))
    for condition, at in reversed(cases):
        end = F.when(condition, at).otherwise(end)
    loud = F.coalesce(F.abs("_jump") > threshold, F.lit(False))
    return base.withColumn("_end", F.when(loud, end)).select(*df.columns, "_i", "_end").mapInArrow(_settled(column, df.columns), StructType([StructField(f.name, f.dataType) for f in df.schema.fields]))


def _settled(column: str, columns: Sequence[str]):
    """Blank the departures that hold. ``_i`` counts the samples of a series from 1; rows come as the window left them, series by series."""

    def run(batches):
        last = seen = 0  # the end of the last departure that holds, and the sample before this batch
        for b in batches:
            i, end = b.column("_i").to_numpy(zero_copy_only=False), pc.fill_null(b.column("_end"), 0).to_numpy(zero_copy_only=False)
            if ((np.diff(i, prepend=seen) != 1) & (i != 1)).any():
                raise RuntimeError("the samples aren't in order")
            fresh = np.flatnonzero(i == 1)
            gone = np.zeros(len(i), bool)
            gone[: fresh[0] if len(fresh) else len(i)] = i[: fresh[0] if len(fresh) else len(i)] < last  # a departure that began in the batch before
            for k in np.union1d(fresh, np.flatnonzero(end)).tolist():
                if i[k] == 1:
                    last = 0
                if end[k] and i[k] > last:
                    last = int(end[k])
                    gone[k : k + last - int(i[k])] = True
            seen = int(i[-1]) if len(i) else seen
            kept = pc.if_else(pa.array(gone), pa.scalar(None, b.column(column).type), b.column(column))
            yield pa.RecordBatch.from_arrays([kept if c == column else b.column(c) for c in columns], list(columns))

    return run


def short_excursions(df: DataFrame, column: str, threshold: float, return_tol: float, keys: Sequence[str] = (), ts: str = "ts", step: str = "5 minutes") -> DataFrame:
    """``step_excursions`` of one sample only, without Python: a lone value that jumps away from both neighbours, which agree."""
    valid = Window.partitionBy(*keys, F.col(column).isNull()).orderBy(ts)
    before, after = F.lag(column).over(valid), F.lead(column).over(valid)
    near = (F.col(ts) - F.lag(ts).over(valid) <= F.expr(f"INTERVAL {step}") * 2) & (F.lead(ts).over(valid) - F.col(ts) <= F.expr(f"INTERVAL {step}") * 2)
    out, back = F.col(column) - before, after - F.col(column)
    bad = near & (F.abs(out) > threshold) & (F.abs(back) > threshold) & (out * back < 0) & (F.abs(after - before) <= return_tol)
    return df.withColumn(column, F.when(~F.coalesce(bad, F.lit(False)), F.col(column)))


def with_sun(df: DataFrame, site: Site, ts: str = "ts") -> DataFrame:
    """``df`` with ``_mu`` (cosine of the zenith angle) and ``_e0`` (eccentricity correction), made once for the steps that follow; they take
    these columns where they find them. Made before a window, the work is spread over the scan's tasks."""
    return solar.with_sun(df, site, ts)


def _sun(df: DataFrame, site: Site, ts: str) -> DataFrame:
    return df if {"_mu", "_e0"} <= set(df.columns) else with_sun(df, site, ts)


def mask_impossible(df: DataFrame, site: Site, ts: str = "ts") -> DataFrame:
    """Blank shortwave outside the physically possible limits, and diffuse over the global it belongs to.

    Net radiation goes where the global does. Elevation and ceilings are projected once.
    """
    here = _present(df, CEILING)
    mu = F.col("_mu")
    base = computed(_sun(df, site, ts), {"_top": F.lit(solar.CEILING_SOLAR_CONSTANT) * F.col("_e0") * F.when(mu > 0, F.pow(mu, F.lit(1.2))).otherwise(F.lit(0.0))})
    bad = {}
    for name in here:
        gain, offset = CEILING[name]
        floor = FLOOR * (PAR_SHARE if name == "Sw_par" else 1.0)
        bad[name] = (F.col(name) > F.col("_top") * gain + offset) | (F.col(name) < floor) | ((mu > 0) & (F.degrees(F.asin(mu)) > 0) & (F.col(name) <= 0))
    if {"Sw_dif", "Sw_dw"} <= set(here):
        bad["Sw_dif"] = bad["Sw_dif"] | ((F.col("Sw_dw") > 200.0) & (F.col("Sw_dif") > 1.05 * F.col("Sw_dw")))
    if "Net_CNR1" in df.columns and "Sw_dw" in here:
        bad["Net_CNR1"] = bad["Sw_dw"]
    return base.withColumns({n: F.when(~F.coalesce(b, F.lit(False)), F.col(n)) for n, b in bad.items()}).select(*df.columns)


def night_corrupted_days(df: DataFrame, site: Site, columns: Sequence[str], keys: Sequence[str] = (), ts: str = "ts", min_samples: int = 3, flux: float = 50.0, below: float = -10.0) -> DataFrame:
    """(keys, day, n): days with that many deep-night samples in which any shortwave channel is over ``flux``."""
    lit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > flux, F.lit(False)) for c in _present(df, columns)], F.lit(False))
    days = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count_if(lit & (solar.elevation(F.col(ts), site) < below)).alias("n"))
    return days.where(F.col("n") >= min_samples)


def mask_corrupted_days(df: DataFrame, site: Site, columns: Sequence[str], masked: Sequence[str], keys: Sequence[str] = (), ts: str = "ts", min_samples: int = 3, flux: float = 50.0, below: float = -10.0) -> DataFrame:
    """``night_corrupted_days`` and ``mask_days`` in one pass: blank ``masked`` on days with that many lit samples in the deep night."""
    lit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > flux, F.lit(False)) for c in _present(df, columns)], F.lit(False))
    base = _sun(df, site, ts).withColumn("_day", F.to_date(ts))
    base = base.withColumn("_lit", F.sum(((F.degrees(F.asin("_mu")) < below) & lit).cast("int")).over(Window.partitionBy(*keys, "_day")))
    return base.withColumns({c: F.when(F.col("_lit") < min_samples, F.col(c)) for c in _present(df, masked)}).select(*df.columns)


def mask_days(df: DataFrame, days: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Blank ``columns`` on the flagged days. ``days`` has ``keys`` and day; Spark broadcasts it when it is small."""
    flags = days.select(*keys, F.col("day").alias("_day"), F.lit(True).alias("_bad")).distinct()
    joined = df.withColumn("_day", F.to_date(ts)).join(flags, [*keys, "_day"], "left")
    return joined.withColumns({c: F.when(F.col("_bad").isNull(), F.col(c)) for c in _present(df, columns)}).select(*df.columns)


def mask_nocturnal(df: DataFrame, site: Site, columns: Sequence[str], ts: str = "ts", below: float = 0.0) -> DataFrame:
    base = _sun(df, site, ts)
    return base.withColumns({c: F.when(F.degrees(F.asin("_mu")) >= below, F.col(c)) for c in _present(df, columns)}).select(*df.columns)


def close_net_radiation(df: DataFrame, name: str = "Net_CNR1", parts: Sequence[str] = ("Sw_dw", "Sw_up", "Lw_dw", "Lw_up"), night: Column | None = None) -> DataFrame:
    """net = SWd - SWu + LWd - LWu, null if any part is; where ``night`` holds, the longwave balance alone."""
    a, b, c, d = (F.col(p) for p in parts)
    full = a - b + c - d
    return df.withColumn(name, full if night is None else F.when(night, c - d).otherwise(full))


def changed_counts(before: Column, after: Column) -> list[Column]:
    return [F.count_if(before.isNull() & after.isNotNull()).alias("gained"), F.count_if(before.isNotNull() & after.isNull()).alias("dropped")]


def drop_ungated(df: DataFrame, names: Sequence[str] = ("RECORD",), patterns: Sequence[str] = ("rtime", "_mv_Avg")) -> DataFrame:
    gone = [c for c in df.columns if c in names or c.startswith(patterns[0]) or c.endswith(patterns[1])]
    return df.drop(*gone)


def status_to_number(df: DataFrame, columns: Sequence[str], ok: str = "OK") -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) == ok, 1.0).when(F.col(c).isNotNull(), 0.0) for c in _present(df, columns)})


def ratio_gate(a: Column, b: Column, low: float = 0.0, high: float = 1.5) -> Column:
    """a / b where b > 0 and the ratio lies in [low, high]; the clearness and the diffuse ratio."""
    r = F.when(b > 0, a / b)
    return F.when(r.between(low, high), r)


def lowest_elevation(ts: Column, site: Site, minutes: Sequence[int] = (0, 30, 60)) -> Column:
    return F.least(*[solar.elevation(ts + F.expr(f"INTERVAL {m} MINUTES"), site) for m in minutes])


def highest_elevation(ts: Column, site: Site, minutes: Sequence[int] = (0, 30, 60)) -> Column:
    return F.greatest(*[solar.elevation(ts + F.expr(f"INTERVAL {m} MINUTES"), site) for m in minutes])


def daylight_selection(ts: Column, site: Site, day_above: float = 10.0, night_below: float = 0.0) -> Column:
    """``day``, ``night`` or null (twilight)."""
    return F.when(lowest_elevation(ts, site) > day_above, "day").when(highest_elevation(ts, site) < night_below, "night")


def with_elevations(df: DataFrame, site: Site, ts: str = "ts", minutes: Sequence[int] = (0, 30, 60)) -> DataFrame:
    """``df`` with ``_low`` and ``_high``, as ``lowest_elevation`` and ``highest_elevation``, but the sun is computed once for each of the minutes, in
    steps that compile. As one expression its formula is there so often that Spark interprets it."""
    base, names = df, [f"_el_{m}" for m in minutes]
    for m, name in zip(minutes, names):
        moved = computed(base, {"_at": F.col(ts) + F.expr(f"INTERVAL {m} MINUTES")})
        base = computed(solar.with_sun(moved, site, "_at"), {name: F.degrees(F.asin("_mu"))}).drop("_at", "_mu", "_e0")
    return base.withColumns({"_low": F.least(*names), "_high": F.greatest(*names)}).drop(*names)


def with_daylight(df: DataFrame, site: Site, ts: str = "ts", name: str = "part", day_above: float = 10.0, night_below: float = 0.0) -> DataFrame:
    """``df`` with ``daylight_selection`` as a column."""
    part = F.when(F.col("_low") > day_above, "day").when(F.col("_high") < night_below, "night")
    return with_elevations(df, site, ts).withColumn(name, part).drop("_low", "_high")


def prepare_clearness(df: DataFrame, site: Site, column: str = "Sw_dw", ts: str = "ts", shift_minutes: int = 30, min_elevation: float = 10.0) -> DataFrame:
    """Hours with a sun at mid-hour, a lowest elevation above the bound and a value: adds ``e0`` and ``kt``."""
    mid = F.col(ts) + F.expr(f"INTERVAL {shift_minutes} MINUTES")
    base = computed(with_elevations(df.where(F.col(column).isNotNull()), site, ts).drop("_high"), {"e0": solar.extraterrestrial(mid, site)})
    return base.where((F.col("e0") > 0) & (F.col("_low") > min_elevation)).withColumn("kt", F.col(column) / F.col("e0")).drop("_low")


def unshaded_diffuse_days(df: DataFrame, diffuse: str, total: str, keys: Sequence[str] = (), ts: str = "ts", clear: float = 600.0, min_samples: int = 20, limit: float = 0.55, certain: float = 0.85, min_days: int = 3, join_days: int = 2) -> DataFrame:
    """(keys, first, last, days, ratio): runs of days on which the diffuse channel sees the whole sky."""
    days = (
        df.where(F.col(total) > clear).groupBy(*keys, F.to_date(ts).alias("day"))
        .agg(F.percentile(F.col(diffuse) / F.col(total), F.lit(0.5)).alias("ratio"), F.count(diffuse).alias("n"))
        .where((F.col("n") >= min_samples) & (F.col("ratio") > limit))
    )
    runs = islands(days, "day", F.datediff("day", F.lag("day").over(_by(keys, "day"))) > join_days, keys)
    out = runs.groupBy(*keys, "_run").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days"), F.percentile("ratio", F.lit(0.5)).alias("ratio"))
    return out.where((F.col("days") >= min_days) | (F.col("ratio") > certain)).drop("_run")


def _by(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)


def islands(df: DataFrame, order: str, starts: Column, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_run``: the number of rows up to here at which ``starts`` holds (the first row starts too)."""
    flagged = df.withColumn("_start", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0))
    return flagged.withColumn("_run", F.sum("_start").over(_by(keys, order).rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def blocked_gauge_runs(df: DataFrame, column: str, keys: Sequence[str] = (), ts: str = "ts", min_days: int = 30) -> DataFrame:
    """(keys, first, last, days): runs of calendar days in a row on which nothing was collected."""
    days = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.max(column).alias("top"))
    dry = days.where(F.col("top") <= 0)
    runs = islands(dry, "day", F.datediff("day", F.lag("day").over(_by(keys, "day"))) > 1, keys)
    return runs.groupBy(*keys, "_run").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days")).where(F.col("days") >= min_days).drop("_run")


def unquantised(df: DataFrame, columns: Sequence[str], quantum: float = 0.254, tolerance: float = 1e-5) -> DataFrame:
    """(column, n): positive totals that aren't a multiple of the tip."""
    here = _present(df, columns)
    off = lambda c: F.count_if((F.col(c) > 0) & (F.abs(F.col(c) / quantum - F.rint(F.col(c) / quantum)) > tolerance))
    return df.agg(F.array(*[F.struct(F.lit(c).alias("column"), off(c).alias("n")) for c in here]).alias("r")).select(F.inline("r"))


def months_never_saturated(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), ts: str = "ts", floor: float = 93.0, min_samples: int = 2000) -> DataFrame:
    """(keys, column, month, top, n): months whose humidity never reached ``floor``."""
    here = _present(df, columns)
    long = df.unpivot([F.col(k) for k in [*keys, ts]], here, "column", "value")
    months = long.groupBy(*keys, "column", F.trunc(F.col(ts), "month").alias("month")).agg(F.max("value").alias("top"), F.count("value").alias("n"))
    return months.where((F.col("n") >= min_samples) & (F.col("top") < floor))


def nocturnal_offsets(df: DataFrame, column: str, site: Site, keys: Sequence[str] = (), ts: str = "ts", below: float = -10.0, alarm: float = 1.5, months_back: int = 12, min_months: int = 3) -> DataFrame:
    """(keys, month, n, median, p5, p95, below_4, below_2, baseline, drifts) of deep-night values."""
    night = df.where((solar.elevation(F.col(ts), site) < below) & F.col(column).isNotNull())
    v = F.col(column)
    months = night.groupBy(*keys, F.trunc(F.col(ts), "month").alias("month")).agg(
        F.count("*").alias("n"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.05)).alias("p5"), F.percentile(v, F.lit(0.95)).alias("p95"),
        F.avg((v < -4).cast("double")).alias("below_4"), F.avg((v < -2).cast("double")).alias("below_2"),
    )
    back = _by(keys, "month").rowsBetween(-months_back, -1)
    base = F.when(F.count("median").over(back) >= min_months, F.percentile("median", F.lit(0.5)).over(back))
    return months.withColumn("baseline", base).withColumn("drifts", F.coalesce(F.abs(F.col("median") - F.col("baseline")) > alarm, F.lit(False)))


def strip_atoms(df: DataFrame, atoms: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Point masses blanked, and (column, removed, share) of each. ``atoms``: channel -> where its value is one."""
    here = {n: c for n, c in atoms.items() if n in df.columns}
    hit = lambda n: F.coalesce(here[n], F.lit(False)) & F.col(n).isNotNull()
    counts = df.agg(F.array(*[F.struct(F.lit(n).alias("column"), F.count_if(hit(n)).alias("removed"), F.try_divide(F.count_if(hit(n)), F.count(n)).alias("share")) for n in here]).alias("r"))
    return df.withColumns({n: F.when(~hit(n), F.col(n)) for n in here}), counts.select(F.inline("r"))


def standard_atoms() -> dict[str, Column]:
    c = F.col
    return {"WS": c("WS") <= 0.281, "ur": c("ur") >= 99.5, "precip": c("precip") < 0.254, "Sw_dw": c("Sw_dw") <= 0,
            "Sw_par": (c("Sw_par") == 0) | ((c("Sw_dw") > 50) & (c("Sw_par") > 0.6 * c("Sw_dw")))}


def row_contract(df: DataFrame, rows: int, start: str, end: str, step_minutes: int = 5, ts: str = "ts") -> DataFrame:
    """One row: n, first, last, duplicates, and ``problems`` (array of texts) against what was audited."""
    one = df.agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"), (F.count(ts) - F.count_distinct(ts)).alias("duplicates"))
    span = (F.unix_seconds(F.col("last").cast("timestamp")) - F.unix_seconds(F.col("first").cast("timestamp"))) / (60 * step_minutes) + 1
    text = lambda cond, what: F.when(cond, F.lit(what))
    checks = [text(F.col("n") != rows, f"expected {rows} rows"), text(F.coalesce(F.col("first") != F.lit(start).cast("timestamp_ntz"), F.lit(True)), f"does not start at {start}"),
              text(F.coalesce(F.col("last") != F.lit(end).cast("timestamp_ntz"), F.lit(True)), f"does not end at {end}"), text(F.col("duplicates") > 0, "duplicate stamps"), text(F.col("n") > span, "more rows than the grid holds")]
    return one.withColumn("problems", F.array_compact(F.array(*checks)))


def dead_channels(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Channels that are zero in every finite row. One job, one row."""
    here = _present(df, columns)
    if not here:
        return []
    row = df.agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(here)], *[F.count_if((F.col(c) != 0) & ~F.isnan(c)).alias(f"z_{i}") for i, c in enumerate(here)]).first()
    return [c for i, c in enumerate(here) if row[f"n_{i}"] and not row[f"z_{i}"]]


def clip_last_days(df: DataFrame, days: int, ts: str = "ts", end: Column | None = None) -> DataFrame:
    """Rows within ``days`` of the last stamp, or of ``end``; rows after ``end`` stay.

    The last stamp is looked up first, so that the filter is one on a constant, which the scan can use to skip files.
    """
    if end is None:
        end = F.lit(df.agg(F.max(ts).alias("_end")).first()[0]).cast(df.schema[ts].dataType)
    return df.where(F.col(ts) >= end - F.expr(f"INTERVAL {days} DAYS"))


def first_present(df: DataFrame, candidates: Sequence[str]) -> Column | None:
    """The values of the first candidate that is a column, falling back on the next where they are null."""
    here = _present(df, candidates)
    return F.coalesce(*[F.col(c) for c in here]) if here else None


def frame_visual_qc(images: DataFrame, dark: float = 10.0, saturated_share: float = 0.2) -> DataFrame:
    """(origin, luminance, saturated, flag) of rows of Spark's image source: ``dark``, ``saturated``, ``unreadable`` or ``ok``."""

    def run(batches):
        for pdf in batches:
            out = []
            for origin, h, w, ch, data in zip(pdf.origin, pdf.height, pdf.width, pdf.nChannels, pdf.data):
                if not data or h <= 0 or w <= 0 or ch < 3:
                    out.append((origin, None, None, "unreadable"))
                    continue
                bgr = np.frombuffer(data, np.uint8).reshape(h, w, ch)[..., :3]
                light = float((bgr @ np.array([0.114, 0.587, 0.299])).mean())
                share = float((bgr >= 255).all(axis=2).mean())
                out.append((origin, light, share, "dark" if light < dark else "saturated" if share > saturated_share else "ok"))
            yield pd.DataFrame(out, columns=["origin", "luminance", "saturated", "flag"])

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, "origin string, luminance double, saturated double, flag string")


INFINITY = math.inf
