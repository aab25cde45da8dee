"""Wind, humidity, radiation-budget and unit formulas as column expressions. A null input gives a null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Physical constants.
STEFAN_BOLTZMANN = 5.670374419e-08
MOLAR_MASS_RATIO = 0.622
BOLTON = (611.2, 17.67, 243.5)
ZERO_CELSIUS = 273.15
DRY_AIR = 287.05
MIN_COS_ZENITH = 0.1736


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    c = c.cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)  # NaN compares as greater than any number


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns evaluated here and now.

    They leave a generator as plain attributes, so filters and projections above don't repeat their expressions. For long formulas
    that several later steps use.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    return df.select(*[F.col(f"`{c}`") for c in kept], made).select(*[F.col(f"`{c}`") for c in kept], "_made.*")


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """(u, v), towards which the wind blows, from the bearing that it comes from."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def wind_direction(u: Column, v: Column) -> Column:
    """The bearing from which the wind comes, in [0, 360); null at calm."""
    raw = F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))
    return F.when((u != 0) | (v != 0), F.when(raw >= 360.0, F.lit(0.0)).otherwise(raw))


def resolve_direction(direction: Column | None, u: Column | None = None, v: Column | None = None) -> Column:
    """The direction itself, else that of the components."""
    parts = [c for c in (direction, wind_direction(u, v) if u is not None and v is not None else None) if c is not None]
    if not parts:
        raise ValueError("neither a direction nor components are given")
    return F.coalesce(*parts)


def flow_bearing(u: Column, v: Column) -> Column:
    """The bearing towards which the wind blows."""
    return F.pmod(F.degrees(F.atan2(u, v)), F.lit(360.0))


def rotate_to_earth(u: Column, v: Column, cosa: Column | None = None, sina: Column | None = None) -> tuple[Column, Column]:
    if cosa is None or sina is None:
        return u, v
    return u * cosa + v * sina, v * cosa - u * sina


def vapor_pressure(mixing_ratio: Column, pressure: Column) -> Column:
    return mixing_ratio * pressure / (F.lit(MOLAR_MASS_RATIO) + mixing_ratio)


def saturation_vapor_pressure(celsius: Column) -> Column:
    """Pa."""
    a, b, c = BOLTON
    return F.lit(a) * F.exp(F.lit(b) * celsius / (celsius + F.lit(c)))


def relative_humidity(mixing_ratio: Column, pressure: Column, celsius: Column, clip: bool = True) -> Column:
    """Percent; grids clip to [0, 100], point series don't."""
    rh = F.lit(100.0) * vapor_pressure(mixing_ratio, pressure) / saturation_vapor_pressure(celsius)
    return F.when(rh.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), rh))) if clip else rh


UNITS = {
    ("K", "C"): lambda c: c - F.lit(ZERO_CELSIUS), ("C", "K"): lambda c: c + F.lit(ZERO_CELSIUS), ("Pa", "hPa"): lambda c: c / F.lit(100.0),
    ("kg/kg", "g/kg"): lambda c: c * F.lit(1000.0), ("F", "C"): lambda c: (c - F.lit(32.0)) * F.lit(5.0 / 9.0),
    ("kt", "m/s"): lambda c: c * F.lit(0.514444), ("in", "mm"): lambda c: c * F.lit(25.4), ("kJ/m2/h", "W/m2"): lambda c: c * F.lit(16.6667 / 60.0),
}


def convert(c: Column, source: str, target: str) -> Column:
    if source == target:
        return c
    if (source, target) not in UNITS:
        raise ValueError(f"no conversion from {source} to {target}")
    return UNITS[source, target](c)


def radiation_budget(swdown: Column, albedo: Column, glw: Column, emissivity: Column, skin: Column, cosz: Column | None = None, air: Column | None = None, top: Column | None = None) -> dict[str, Column]:
    """Upwelling, net and derived streams. ``skin`` and ``air`` in K; the reflected sky part of the longwave is included."""
    sigma = F.lit(STEFAN_BOLTZMANN)
    out = {"swup": albedo * swdown, "lwup": emissivity * sigma * F.pow(skin, F.lit(4.0)) + (F.lit(1.0) - emissivity) * glw}
    out |= {"swnet": swdown - out["swup"], "lwnet": glw - out["lwup"]}
    out["rnet"] = out["swnet"] + out["lwnet"]
    if air is not None:
        out["sky_emissivity"] = F.try_divide(glw, sigma * F.pow(air, F.lit(4.0)))
    if cosz is not None and top is not None:
        out["kt"] = F.when(cosz >= MIN_COS_ZENITH, F.try_divide(swdown, top))
    return out


def air_density(pressure: Column, kelvin: Column, mixing_ratio: Column) -> Column:
    return pressure / (F.lit(DRY_AIR) * kelvin * (F.lit(1.0) + F.lit(0.61) * mixing_ratio))


def wind_power_density(density: Column, speed: Column) -> Column:
    return F.lit(0.5) * density * speed * speed * speed
