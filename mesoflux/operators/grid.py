"""Operators on gridded model runs in long form: (domain, step, y, x[, level], fields)."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import atmosphere

CELL = ("domain", "step", "y", "x")
#: Constants of the sea-level reduction.
GRAVITY, DRY_AIR, LAPSE = 9.81, 287.04, 0.0065
DROP_PA, HOT_K, RELAX = 10_000.0, 273.16 + 17.5, 0.005


def rain_increment(df: DataFrame, column: str, keys: Sequence[str] = ("domain", "y", "x"), step: str = "step") -> DataFrame:
    return df.withColumn(column, F.col(column) - F.lag(column).over(Window.partitionBy(*keys).orderBy(step)))


def blank_cold_start(df: DataFrame, columns: Sequence[str], glw: str = "GLW", by: Sequence[str] = ("domain", "step")) -> DataFrame:
    """Blank radiation columns at steps whose downwelling longwave is 0 everywhere; a map-side aggregate and a small join."""
    cold = df.groupBy(*by).agg((F.max(F.abs(F.col(glw))) == 0).alias("_cold"))
    return df.join(cold, list(by)).withColumns({c: F.when(~F.col("_cold"), F.col(c)) for c in columns}).drop("_cold")


def publishes_step(df: DataFrame, value: str, daylight_only: bool, local: str = "local_time", by: Sequence[str] = ("domain", "step")) -> DataFrame:
    """Steps to publish: some value there and, for daylight variables, a local hour of 6 to 18."""
    some = df.where(F.hour(local).between(6, 18)) if daylight_only else df
    return some.groupBy(*by).agg(F.count(value).alias("n")).where("n > 0").drop("n")


def vertical_interpolate(df: DataFrame, value: str, height: str, target: float, keys: Sequence[str] = CELL) -> DataFrame:
    """(keys, value): linear in height from the two levels around the target, extrapolated from the outer two; one level gives its own.

    Four bounded aggregates a cell, no sort of the column: the nearest level at or below, the nearest above, and for
    extrapolation the two lowest and two highest.
    """
    ok = df.where(F.col(value).isNotNull() & F.col(height).isNotNull())
    level = F.struct(F.col(height).alias("h"), F.col(value).alias("v"))
    column = ok.groupBy(*keys).agg(F.array_sort(F.collect_list(level)).alias("c"))
    below = F.filter("c", lambda p: p["h"] <= target)
    k = F.greatest(F.lit(1), F.least(F.size(below), F.size("c") - 1))
    a, b = F.element_at("c", k), F.element_at("c", F.least(k + 1, F.size("c")))
    line = a["v"] + (b["v"] - a["v"]) * F.try_divide(F.lit(target) - a["h"], b["h"] - a["h"])
    return column.select(*keys, F.when(F.size("c") == 1, F.element_at("c", 1)["v"]).otherwise(F.coalesce(line, a["v"])).alias(value))


def destagger(df: DataFrame, column: str, axis: str, keys: Sequence[str]) -> DataFrame:
    """Mean of neighbours along a staggered axis; the last face has none and goes."""
    nxt = F.lead(column).over(Window.partitionBy(*keys).orderBy(axis))
    return df.withColumn(column, (F.col(column) + nxt) / 2).where(F.col(column).isNotNull())


def wind_at_heights(levels: DataFrame, heights: Sequence[float] = (50.0, 100.0, 150.0), every: int = 1) -> DataFrame:
    """(domain, step, y, x, height, u, v, speed, bearing). ``levels``: destaggered u, v and height above ground ``agl``, a row a level.

    u, v and the speed are each linear in height as in ``vertical_interpolate``, so the speed is not that of the interpolated vector; a level
    that lacks one of the components takes no part. One exchange brings a column's levels together for all heights. ``every``: only cells
    whose y and x it divides, for drawing arrows; they are chosen before the exchange.
    """
    h = F.col("h")
    rows = levels.where((F.col("y") % every == 0) & (F.col("x") % every == 0)) if every > 1 else levels
    whole = rows.where(F.col("agl").isNotNull() & F.col("u").isNotNull() & F.col("v").isNotNull())
    level = F.struct(F.col("agl").alias("h"), "u", "v", F.sqrt(F.col("u") ** 2 + F.col("v") ** 2).alias("speed"))
    column = whole.groupBy(*CELL).agg(F.array_sort(F.collect_list(level)).alias("c"))  # a model's levels, some tens
    at = column.select(*CELL, "c", F.explode(F.array(*[F.lit(float(z)) for z in heights])).alias("h"))
    low = F.greatest(F.lit(1), F.least(F.size(F.filter("c", lambda p: p["h"] <= h)), F.size("c") - 1))
    at = at.select(*CELL, "h", F.element_at("c", low).alias("a"), F.element_at("c", F.least(low + 1, F.size("c"))).alias("b"))
    share = F.coalesce(F.try_divide(h - F.col("a.h"), F.col("b.h") - F.col("a.h")), F.lit(0.0))
    at = at.select(*CELL, h.alias("height"), *[(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * share).alias(c) for c in ("u", "v", "speed")])
    return at.withColumn("bearing", atmosphere.flow_bearing(F.col("u"), F.col("v")))


def sea_level_pressure(levels: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """(keys, slp) in hPa. ``levels``: level, p (Pa), z (m), tk (K), qv; a cell without a level 100 hPa up fails the job."""
    tv = F.col("tk") * (1 + 0.608 * F.col("qv"))
    cell = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level", F.col("p").alias("p"), F.col("z").alias("z"), tv.alias("tv")))).alias("c"))
    low = F.element_at("c", 1)
    ref = low["p"] - DROP_PA
    up = F.array_position(F.transform("c", lambda r: r["p"] < F.element_at("c", 1)["p"] - DROP_PA), F.lit(True)).cast("int")
    checked = F.when(up < 2, F.raise_error(F.lit("no level lies 100 hPa above the surface")).cast("int")).otherwise(up)
    base = cell.withColumns({"_l": low, "_ref": ref, "_u": checked}).withColumns({"_a": F.element_at("c", F.col("_u")), "_b": F.element_at("c", F.col("_u") - 1)})
    weight = F.log(F.col("_ref") / F.col("_a.p")) / F.log(F.col("_b.p") / F.col("_a.p"))
    at = lambda n: F.col(f"_a.{n}") - (F.col(f"_a.{n}") - F.col(f"_b.{n}")) * weight
    base = base.withColumns({"_t": at("tv"), "_z": at("z")})
    surface = F.col("_t") * F.pow(F.col("_l.p") / F.col("_ref"), F.lit(LAPSE * DRY_AIR / GRAVITY))
    sea = F.col("_t") + LAPSE * F.col("_z")
    sea = F.when(surface > HOT_K, F.lit(HOT_K) - RELAX * F.pow(surface - HOT_K, 2)).otherwise(F.least(sea, F.lit(HOT_K)))
    return base.select(*keys, (F.col("_l.p") * F.exp(2 * GRAVITY * F.col("_l.z") / (DRY_AIR * (sea + surface))) / 100).alias("slp"))


def smooth(df: DataFrame, value: str, sigma: float = 1.5, truncate: float = 4.0, by: Sequence[str] = ("domain", "step")) -> DataFrame:
    """Gaussian filter along y, then x, edges reflected. Each cell is sent to its 2r + 1 neighbours and summed with map-side combining."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / sum(raw)).alias("w")) for k, w in zip(range(-radius, radius + 1), raw)])

    def along(d: DataFrame, axis: str, other: str) -> DataFrame:
        size = d.groupBy(*by).agg((F.max(axis) + 1).alias("_n"))
        # a filter reads cell a at place a + k; sent the other way round, mirrored places give every reader its share
        wide = d.join(F.broadcast(size) if by == ("domain", "step") else size, list(by)).select(*by, axis, other, value, "_n", F.explode(F.sequence(-F.col("_n"), F.col("_n"), F.col("_n"))).alias("_tile"))
        image = F.when(F.col("_tile") == 0, F.col(axis)).when(F.col("_tile") < 0, -F.col(axis) - 1).otherwise(2 * F.col("_n") - 1 - F.col(axis))
        images = wide.withColumn("_at", image).where(F.col("_at").between(-radius, F.col("_n") - 1 + radius))
        spread = images.select(*by, other, "_n", "_at", value, F.inline(weights)).withColumn(axis, F.col("_at") + F.col("k")).where(F.col(axis).between(0, F.col("_n") - 1))
        return spread.groupBy(*by, axis, other).agg(F.sum(F.col(value) * F.col("w")).alias(value))

    return along(along(df, "y", "x"), "x", "y")


def local_hour_label(df: DataFrame, ts: str = "valid_time", utc_offset: int = -3, keys: Sequence[str] = ("domain",), tolerance_minutes: int = 5) -> DataFrame:
    """Stamps rounded to the hour and shifted; more drift than the tolerance, or steps that aren't hourly, fail the job."""
    hour = F.date_trunc("hour", F.col(ts) + F.expr("INTERVAL 30 MINUTES")).cast("timestamp_ntz")
    drift = F.abs(F.unix_seconds(hour.cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp")))
    base = df.withColumns({"_h": hour, "_d": drift})
    steps = base.select(*keys, "_h", "_d").distinct().withColumn("_p", F.lag("_h").over(Window.partitionBy(*keys).orderBy("_h")))
    bad = (F.col("_d") > tolerance_minutes * 60) | F.coalesce(F.col("_h") != F.col("_p") + F.expr("INTERVAL 1 HOUR"), F.lit(False))
    marked = steps.groupBy(*keys).agg(F.bool_or(bad).alias("_bad"))
    label = F.when(F.col("_bad"), F.raise_error(F.lit("steps must be whole hours in a row")).cast("timestamp_ntz")).otherwise(F.col("_h") + F.expr(f"INTERVAL {utc_offset} HOURS"))
    return base.join(F.broadcast(marked), list(keys)).withColumn("local_time", label).drop("_h", "_d", "_bad")


#: A catalogue of point-record columns: name -> (sources it needs, expression). Further names pass through if the source has them.
CATALOGUE: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "T": (("T2",), lambda: F.col("T2") - 273.15), "p": (("PSFC",), lambda: F.col("PSFC") / 100.0), "q": (("Q2",), lambda: F.col("Q2") * 1000.0),
    "e": (("Q2", "PSFC"), lambda: atmosphere.vapor_pressure(F.col("Q2"), F.col("PSFC")) / 100.0),
    "ur": (("Q2", "PSFC", "T2"), lambda: atmosphere.relative_humidity(F.col("Q2"), F.col("PSFC"), F.col("T2") - 273.15, clip=False)),
    "WS": (("U10", "V10"), lambda: F.sqrt(F.col("U10") ** 2 + F.col("V10") ** 2)), "WD": (("U10", "V10"), lambda: atmosphere.wind_direction(F.col("U10"), F.col("V10"))),
    "Swdw": (("SWDOWN",), lambda: F.col("SWDOWN")), "Swup_calc": (("SWDOWN", "ALBEDO"), lambda: F.col("ALBEDO") * F.col("SWDOWN")), "Lwdw_glw": (("GLW",), lambda: F.col("GLW")),
    "Lwup_calc": (("EMISS", "TSK", "GLW"), lambda: atmosphere.radiation_budget(F.lit(0.0), F.lit(0.0), F.col("GLW"), F.col("EMISS"), F.col("TSK"))["lwup"]),
    "H": (("HFX",), lambda: F.col("HFX")), "LE": (("LH",), lambda: F.col("LH")), "rain": (("RAINC", "RAINNC"), lambda: F.col("RAINC") + F.col("RAINNC")),
}
COLD_START = ("Swdw", "Swup_calc", "Lwdw_glw", "Lwup_calc")


def operational_columns(df: DataFrame, keys: Sequence[str], wanted: Sequence[str] | None = None, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """The catalogue's columns; null where a source is missing, and radiation null where the longwave is 0."""
    catalogue = {n: (c() if set(need) <= set(df.columns) else F.lit(None).cast("double")) for n, (need, c) in CATALOGUE.items()} | dict(extra or {})
    names = list(wanted) if wanted is not None else list(catalogue)
    unknown = [n for n in names if n not in catalogue and n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    warm = F.col("GLW") != 0 if "GLW" in df.columns else F.lit(True)
    value = lambda n: catalogue[n] if n in catalogue else F.col(n)
    return df.select(*keys, *[(F.when(warm, value(n)) if n in COLD_START else value(n)).alias(n) for n in names])


@dataclass(frozen=True)
class RecordColumn:
    """One column of the operational record. Without one of ``sources`` it is null; ``instead`` is taken in place of the expression
    where the run carries it; ``increments`` are accumulated fields whose step differences it reads; physics is blank at a cold start."""

    sources: tuple[str, ...]
    value: Callable[[], Column]
    instead: str | None = None
    increments: tuple[str, ...] = ()
    physics: bool = False


def _plain(name: str) -> RecordColumn:
    return RecordColumn((name,), lambda: F.col(name), physics=True)


def _absent() -> RecordColumn:
    return RecordColumn((), lambda: F.lit(None).cast("double"))


def _earth_wind(part: int) -> Callable[[], Column]:
    return lambda: atmosphere.rotate_to_earth(F.col("U10"), F.col("V10"), F.col("COSALPHA"), F.col("SINALPHA"))[part]


_WIND = ("U10", "V10", "COSALPHA", "SINALPHA")
_SIGMA = 5.670374419e-08
#: The names of the record's columns, in their order, and the model fields that they come from.
RECORD: dict[str, RecordColumn] = {
    "t2_c": RecordColumn(("T2",), lambda: F.col("T2") - 273.15),
    "rh_pct": RecordColumn(("T2", "PSFC", "Q2"), lambda: atmosphere.relative_humidity(F.col("Q2"), F.col("PSFC"), F.col("T2") - 273.15, clip=False)),
    "psfc_hpa": RecordColumn(("PSFC",), lambda: F.col("PSFC") / 100.0),
    "e_hpa": RecordColumn(("PSFC", "Q2"), lambda: atmosphere.vapor_pressure(F.col("Q2"), F.col("PSFC")) / 100.0),
    "es_pa": RecordColumn(("T2",), lambda: atmosphere.saturation_vapor_pressure(F.col("T2") - 273.15)),
    "q2_g_kg": RecordColumn(("Q2",), lambda: F.col("Q2") * 1000.0),
    "wind_speed_m_s": RecordColumn(_WIND, lambda: F.sqrt(F.pow(_earth_wind(0)(), 2) + F.pow(_earth_wind(1)(), 2))),
    "wind_dir_deg": RecordColumn(_WIND, lambda: atmosphere.wind_direction(_earth_wind(0)(), _earth_wind(1)())),
    "u10_m_s": RecordColumn(_WIND, _earth_wind(0)),
    "v10_m_s": RecordColumn(_WIND, _earth_wind(1)),
    "swdown_w_m2": _plain("SWDOWN"),
    "swdnb_w_m2": _plain("SWDNB"),
    "swdown_farms_w_m2": _absent(),
    "swupb_w_m2": _plain("SWUPB"),
    "swup_w_m2": RecordColumn(("ALBEDO", "SWDOWN"), lambda: F.col("ALBEDO") * F.col("SWDOWN"), physics=True),
    "swddif_w_m2": _plain("SWDDIF"),
    "swddif_farms_w_m2": _absent(),
    "swddir_w_m2": _plain("SWDDIR"),
    "swddir_farms_w_m2": _absent(),
    "glw_w_m2": _plain("GLW"),
    "lwdnb_w_m2": RecordColumn(("GLW",), lambda: F.col("GLW"), instead="LWDNB", physics=True),
    "lwup_w_m2": RecordColumn(("EMISS", "TSK", "GLW"), lambda: F.col("EMISS") * _SIGMA * F.pow("TSK", F.lit(4.0)) + (1 - F.col("EMISS")) * F.col("GLW"), instead="LWUPB", physics=True),
    "lwup_air_w_m2": RecordColumn(("EMISS", "T2"), lambda: F.col("EMISS") * _SIGMA * F.pow("T2", F.lit(4.0)), physics=True),
    "albedo": _plain("ALBEDO"),
    "emissivity": _plain("EMISS"),
    "hfx_w_m2": _plain("HFX"),
    "lh_w_m2": _plain("LH"),
    "grdflx_w_m2": _plain("GRDFLX"),
    "ustar_m_s": _plain("UST"),
    "pblh_m": _plain("PBLH"),
    "sst_c": RecordColumn(("SST",), lambda: F.col("SST") - 273.15),
    "precip_mm": RecordColumn((), lambda: F.col("_step_RAINC") + F.col("_step_RAINNC"), increments=("RAINC", "RAINNC")),
}


def operational_record(df: DataFrame, keys: Sequence[str], wanted: Sequence[str] | None = None, ts: str = "valid_time") -> DataFrame:
    """(keys, ts, columns): the record of points. A wanted name that the catalogue lacks is a field of the run, passed through and, as
    nothing tells whether it is physics, blank at a cold start (downwelling longwave of 0)."""
    names = list(wanted) if wanted is not None else list(RECORD)
    unknown = [n for n in names if n not in RECORD and n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    chosen = {n: RECORD.get(n) or _plain(n) for n in names}
    series = Window.partitionBy(*keys).orderBy(ts)
    steps = {f: F.col(f) - F.lag(f).over(series) for c in chosen.values() for f in c.increments if f in df.columns}
    base = df.withColumns({f"_step_{f}": c for f, c in steps.items()}) if steps else df
    warm = F.col("GLW") != 0 if "GLW" in df.columns else F.lit(True)

    def value(c: RecordColumn) -> Column:
        if not {*c.sources, *c.increments} <= set(df.columns):
            return F.lit(None).cast("double")
        v = F.col(c.instead) if c.instead in df.columns else c.value()
        return F.when(warm, v) if c.physics else v

    return base.select(*keys, ts, *[value(c).alias(n) for n, c in chosen.items()])
