"""Foreign station networks made alike, and the monthly and hourly summaries that compare them with a model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import atmosphere
from . import metrics

KNOT, INCH = 0.514444, 25.4
#: An hourly energy of 1 kJ/m2 as a mean flux in W/m2.
KILOJOULE_HOUR = 16.6667 / 60
#: Floors under which a pair of values counts as missing, by variable; others have 0.
FLOORS = {"H": -100.0}


def local_time(utc: Column, offset_hours: int) -> Column:
    return utc + F.expr(f"INTERVAL {offset_hours} HOURS")


def normalise_metar(df: DataFrame, offset_hours: int = -3, ts: str = "valid") -> DataFrame:
    """Airport reports in canonical units: local time, degrees Celsius, m/s and its components, mm. ``df``: valid, tmpf, dwpf, relh, drct, sknt, p01i, mslp."""
    speed = F.col("sknt") * KNOT
    u, v = atmosphere.wind_components(speed, F.col("drct"))
    celsius = lambda c: (F.col(c) - 32) * 5 / 9
    return df.where(F.col(ts).isNotNull()).select(
        local_time(F.col(ts), offset_hours).alias("ts"), celsius("tmpf").alias("T"), celsius("dwpf").alias("DP"), F.col("relh").alias("ur"), F.col("drct").alias("WD"),
        speed.alias("WS"), u.alias("u"), v.alias("v"), (F.col("p01i") * INCH).alias("precip"), F.col("mslp").alias("p"),
    )


def normalise_hourly_network(df: DataFrame, pairs: Mapping[str, tuple[str, str]], energies: Mapping[str, str] = {}, others: Mapping[str, str] = {}, date: str = "date", hour: str = "hour", offset_hours: int = -3) -> DataFrame:
    """A network's hourly rows under canonical names: a stamp from a date and an hour (``HH`` or ``HHMM``) in UTC, means of the hour's
    greatest and least value (``pairs``: name -> the two columns; one missing leaves the other), energies in kJ/m2 as W/m2."""
    hours = F.substring(F.lpad(F.regexp_replace(F.col(hour).cast("string"), r"\D", ""), 2, "0"), 1, 2)
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.regexp_replace(F.col(date).cast("string"), "/", "-"), hours), F.lit("yyyy-MM-dd HH")).cast("timestamp_ntz")
    middle = lambda a, b: F.coalesce((F.col(a) + F.col(b)) / 2, F.col(a), F.col(b))
    columns = [middle(*p).alias(n) for n, p in pairs.items()] + [(F.col(c) * KILOJOULE_HOUR).alias(n) for n, c in energies.items()] + [F.col(c).alias(n) for n, c in others.items()]
    return df.select(local_time(stamp, offset_hours).alias("ts"), *columns).where("ts IS NOT NULL")


def _floored(c: Column, variable: str) -> Column:
    return F.when(c > FLOORS.get(variable, 0.0), c)


def scores_by_hour(paired: DataFrame, variables: Sequence[str], months: Sequence[int] | None = None, station: str = "station", ts: str = "ts") -> DataFrame:
    """(station, variable, hour, n, rmse, mae, mbe, r): overall (hour null) and by hour. ``paired``: <variable>_obs and <variable>_model.

    Values at or below a variable's floor are missing. Overall and hourly rows come from one grouping-set aggregate.
    """
    rows = paired if months is None else paired.where(F.month(ts).isin(*months))
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), _floored(F.col(f"{v}_obs"), v).alias("obs"), _floored(F.col(f"{v}_model"), v).alias("pred")) for v in variables])
    long = rows.select(station, F.hour(ts).alias("hour"), F.inline(pairs))
    o, p = F.col("obs"), F.col("pred")
    sets = [[F.col(station), F.col("variable")], [F.col(station), F.col("variable"), F.col("hour")]]
    named = {"n": metrics.n_pairs(o, p), "rmse": metrics.rmse(o, p), "mae": metrics.mae(o, p), "mbe": metrics.mbe(o, p), "r": metrics.pearson(o, p)}
    return long.groupingSets(sets, station, "variable", "hour").agg(*[c.alias(n) for n, c in named.items()]).select(station, "variable", "hour", *named)


def monthly_mean_pairs(paired: DataFrame, variables: Sequence[str], station: str = "station", ts: str = "ts") -> DataFrame:
    """(station, month, variable, obs, model): means over the stamps that have both."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"{v}_obs").alias("o"), F.col(f"{v}_model").alias("p")) for v in variables])
    long = paired.select(station, F.month(ts).alias("month"), F.inline(pairs)).where("o IS NOT NULL AND p IS NOT NULL")
    return long.groupBy(station, "month", "variable").agg(F.avg("o").alias("obs"), F.avg("p").alias("model"))


def hourly_mean_error(df: DataFrame, value: str, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """(by, hour, n, mean, error): the mean of each hour of the day and its standard error, the population deviation over the root of n."""
    return df.groupBy(*by, F.hour(ts).alias("hour")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.try_divide(F.stddev_pop(value), F.sqrt(F.count(value))).alias("error"))


def monthly_positive_means(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """(by, year, month, columns): means of the strictly positive values of each flux."""
    return df.groupBy(*by, F.year(ts).alias("year"), F.month(ts).alias("month")).agg(*[F.avg(F.when(F.col(c) > 0, F.col(c))).alias(c) for c in columns])
