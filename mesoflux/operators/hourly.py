"""Time aggregation on complete grids: windows, vector means, calendars and spines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.atmosphere import wind_direction


def spine(df: DataFrame, ts: str = "ts", freq: str = "1 hour", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ts): every window start from the first to the last one of each station. One row a station is exploded."""
    start = lambda agg: F.window(agg, freq)["start"]
    span = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi")).where(F.col("_lo").isNotNull())
    span = span.withColumns({"_lo": start(F.col("_lo"))}).withColumns({"_hi": start(F.col("_hi"))})
    return span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {freq}"))).alias(ts))


def _enough(c: Column, value: Column, k: int) -> Column:
    return F.when(F.count(c) >= k, value)


def vector_mean(direction: str, speed: str | None, min_samples: int) -> Column:
    """Bearing of the speed-weighted mean vector of a window; unit weights where the speed has too few samples."""
    d = F.radians(direction)

    def mean(w: Column) -> Column:
        return wind_direction(F.avg(-w * F.sin(d)), F.avg(-w * F.cos(d)))

    plain = mean(F.lit(1.0))
    if speed is not None:
        plain = F.when(F.count(speed) >= min_samples, mean(F.col(speed))).otherwise(plain)
    return _enough(F.col(direction), plain, min_samples)


def aggregate_hourly(df: DataFrame, values: Sequence[str], *, sums: Sequence[str] = (), directions: Sequence[str] = (), speeds: Mapping[str, str] | None = None, keys: Sequence[str] = (), ts: str = "ts", freq: str = "1 hour", min_samples: int = 6, complete: bool = True) -> DataFrame:
    """Means, sums and vector means of tumbling windows, labelled by their start; too few samples give null.

    With ``complete`` every window between a station's first and last is emitted. Partial aggregates shrink the shuffle to one row a
    window and task.
    """
    speeds = {d: s for d, s in (speeds or {}).items() if s in df.columns}
    out = [_enough(F.col(c), F.sum(c) if c in sums else F.avg(c), min_samples).alias(c) for c in values if c not in directions]
    out += [vector_mean(c, speeds.get(c), min_samples).alias(c) for c in directions]
    hourly = df.groupBy(*keys, F.window(ts, freq)["start"].alias(ts)).agg(*out)
    return spine(df, ts, freq, keys).join(hourly, [*keys, ts], "left") if complete else hourly


def ok_fraction(df: DataFrame, status: str, keys: Sequence[str] = (), ts: str = "ts", freq: str = "1 hour", ok: str = "OK") -> DataFrame:
    share = F.avg(F.when(F.col(status) == ok, 1.0).when(F.col(status).isNotNull(), 0.0))
    return df.groupBy(*keys, F.window(ts, freq)["start"].alias(ts)).agg(share.alias("ok_fraction"))


def _on_domain(df: DataFrame, part: Column, name: str, low: int, high: int, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    means = df.groupBy(*keys, part.alias(name)).agg(*[F.avg(c).alias(c) for c in values])
    domain = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(name))
    domain = df.select(*keys).distinct().crossJoin(F.broadcast(domain)) if keys else domain  # a calendar is 24 or 12 rows
    return domain.join(means, [*keys, name], "left")


def diurnal_cycle(df: DataFrame, values: Sequence[str], keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    return _on_domain(df, F.hour(ts), "hour", 0, 23, values, keys)


def monthly_means(df: DataFrame, values: Sequence[str], keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    return _on_domain(df, F.month(ts), "month", 1, 12, values, keys)


def season(ts: Column) -> Column:
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").when(m.isNotNull(), "SON")


def with_subsets(df: DataFrame, ts: str = "ts", subsets: Sequence[str] = ("all", "DJF", "JJA")) -> DataFrame:
    """Each row once for ``all`` and once for its season, where that is wanted."""
    labels = F.array_intersect(F.array(F.lit("all"), season(F.col(ts))), F.array(*[F.lit(s) for s in subsets]))
    return df.withColumn("subset", F.explode(labels))


def daily_totals(df: DataFrame, column: str, keys: Sequence[str] = (), ts: str = "ts", how: str = "sum") -> DataFrame:
    """(keys, day, column) on a complete calendar; null where a day has no value."""
    day = F.to_date(ts)
    days = df.groupBy(*keys, day.alias("day")).agg((F.sum(column) if how == "sum" else F.avg(column)).alias(column))
    span = df.groupBy(*keys).agg(F.min(day).alias("lo"), F.max(day).alias("hi")).where(F.col("lo").isNotNull())
    calendar = span.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return calendar.join(days, [*keys, "day"], "left")


def bulk_ratio(a: Column, b: Column, floor: float | None = None) -> Column:
    """Sum over sum, not the mean of ratios; with ``floor`` only rows whose denominator is above it."""
    ok = a.isNotNull() & b.isNotNull() & (b > floor if floor is not None else F.lit(True))
    return F.try_divide(F.sum(F.when(ok, a)), F.sum(F.when(ok, b)))


def coverage_panel(df: DataFrame, values: Sequence[str], ts: str = "ts") -> DataFrame:
    """(variable, kind, label, hours, years): valid hours by year and by season."""
    long = df.unpivot([F.col(ts)], list(values), "variable", "value").where(F.col("value").isNotNull())
    parts = F.array(F.struct(F.lit("year").alias("kind"), F.year(ts).cast("string").alias("label")), F.struct(F.lit("season").alias("kind"), season(F.col(ts)).alias("label")))
    flat = long.select("variable", F.year(ts).alias("year"), F.inline(parts))
    return flat.groupBy("variable", "kind", "label").agg(F.count("*").alias("hours"), F.array_sort(F.collect_set("year")).alias("years"))


def regular_grid(df: DataFrame, freq: str, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Re-index to the complete cadence from the first stamp on; a stamp off the grid fails the job."""
    span = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi")).where(F.col("_lo").isNotNull())
    grid = span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {freq}"))).alias("_at"), F.lit(True).alias("_on"))
    joined = grid.join(df.withColumnRenamed(ts, "_ts"), [*[F.col(f"grid.{k}") == F.col(f"df.{k}") for k in []], F.col("_at") == F.col("_ts")], "full_outer") if not keys else grid.join(df.withColumn("_at", F.col(ts)).withColumnRenamed(ts, "_ts"), [*keys, "_at"], "full_outer")
    stamp = F.when(F.col("_on").isNull(), F.raise_error(F.concat(F.lit("stamp off the grid: "), F.col("_ts").cast("string"))).cast("timestamp_ntz")).otherwise(F.col("_at"))
    return joined.withColumn(ts, stamp).select(*df.columns)


def centred_hourly_mean(df: DataFrame, values: Sequence[str], directions: Sequence[str] = (), speeds: Mapping[str, str] | None = None, ts: str = "ts", min_samples: int = 6) -> DataFrame:
    """Windows from half past to half past, labelled by the hour in their middle."""
    speeds = speeds or {}
    out = [_enough(F.col(c), F.avg(c), min_samples).alias(c) for c in values] + [vector_mean(c, speeds.get(c), min_samples).alias(c) for c in directions]
    return df.groupBy((F.window(ts, "1 hour", "1 hour", "30 minutes")["start"] + F.expr("INTERVAL 30 MINUTES")).alias(ts)).agg(*out)
