"""Solar geometry, clear-sky and diffuse-fraction models as column expressions.

Stamps are station-local wall time (TIMESTAMP_NTZ); the offset from UTC is a parameter. Every function but ``with_sun`` takes and
returns a Column and stays inside whole-stage code generation. A null input gives a null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .atmosphere import computed

#: Constants of the published formulas.
SOLAR_CONSTANT = 1361.0
CEILING_SOLAR_CONSTANT = 1367.0
HAURWITZ_A, HAURWITZ_B = 1098.0, 0.057
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)
EQUATION_OF_TIME = (7.5e-05, 0.001868, -0.032077, -0.014615, -0.040849)
ECCENTRICITY = (1.00011, 0.034221, 0.00128, 0.000719, 7.7e-05)
ERBS_MID = (0.9511, -0.1604, 4.388, -16.638, 12.336)
LEMOS = (-4.41, 7.87, -0.088, -0.0049, 1.47, 1.1)
RIDLEY = (-5.38, 6.63, -0.006, -0.007, 1.75, 1.31)
SKY_BOUNDS = (0.35, 0.55, 0.65)


@dataclass(frozen=True)
class Site:
    latitude: float
    longitude: float
    utc_offset: float | None = None

    @property
    def offset(self) -> float:
        return float(round(self.longitude / 15.0)) if self.utc_offset is None else self.utc_offset


def _hours(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60.0) + F.second(ts) / F.lit(3600.0)


def fractional_year(ts: Column) -> Column:
    return F.lit(2.0 * math.pi / 365.0) * (F.dayofyear(ts) - F.lit(1.0) + (_hours(ts) - F.lit(12.0)) / F.lit(24.0))


def _fourier(g: Column, terms: tuple[float, ...]) -> Column:
    out = F.lit(terms[0])
    for k, value in enumerate(terms[1:]):
        angle = g * F.lit(float(k // 2 + 1))
        out = out + F.lit(value) * (F.sin(angle) if k % 2 else F.cos(angle))
    return out


def declination(ts: Column) -> Column:
    return _fourier(fractional_year(ts), DECLINATION)


def equation_of_time(ts: Column) -> Column:
    """Minutes."""
    return F.lit(229.18) * _fourier(fractional_year(ts), EQUATION_OF_TIME)


def eccentricity(ts: Column) -> Column:
    return _fourier(fractional_year(ts), ECCENTRICITY)


def hour_angle(ts: Column, site: Site) -> Column:
    """Degrees, 0 at solar noon."""
    minutes = _hours(ts) * F.lit(60.0) + equation_of_time(ts) + F.lit(4.0 * site.longitude - 60.0 * site.offset)
    return minutes / F.lit(4.0) - F.lit(180.0)


def apparent_solar_time(ts: Column, site: Site) -> Column:
    return F.lit(12.0) + hour_angle(ts, site) / F.lit(15.0)


def _clip(c: Column, low: float, high: float, given: Column) -> Column:
    """``c`` within bounds; null where ``given``, on which alone ``c`` depends, is. So ``c`` stands in the tree once."""
    return F.when(given.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def cos_zenith(ts: Column, site: Site) -> Column:
    lat, d, h = math.radians(site.latitude), declination(ts), F.radians(hour_angle(ts, site))
    return _clip(F.lit(math.sin(lat)) * F.sin(d) + F.lit(math.cos(lat)) * F.cos(d) * F.cos(h), -1.0, 1.0, ts)


def with_sun(df: DataFrame, site: Site, ts: str = "ts", bearing: bool = False) -> DataFrame:
    """``df`` with ``_mu`` (cosine of the zenith angle), ``_e0`` (eccentricity correction) and, if ``bearing``, ``_azimuth``: the same values as of the
    functions, but each part of the formula is evaluated once."""
    kept = list(df.columns)
    base = computed(df, {"_g": fractional_year(F.col(ts)), "_h": _hours(F.col(ts))})
    g, lat = F.col("_g"), math.radians(site.latitude)
    minutes = F.col("_h") * F.lit(60.0) + F.lit(229.18) * _fourier(g, EQUATION_OF_TIME) + F.lit(4.0 * site.longitude - 60.0 * site.offset)
    base = computed(base, {"_e0": _fourier(g, ECCENTRICITY), "_d": _fourier(g, DECLINATION), "_a": minutes / F.lit(4.0) - F.lit(180.0)})
    mu = _clip(F.lit(math.sin(lat)) * F.sin("_d") + F.lit(math.cos(lat)) * F.cos("_d") * F.cos(F.radians("_a")), -1.0, 1.0, F.col(ts))
    base = computed(base, {"_mu": mu})
    if bearing:
        base = computed(base, {"_azimuth": _bearing(F.col("_mu"), F.col("_d"), F.col("_a"), site, F.col(ts))})
    return base.select(*[f"`{c}`" for c in kept], "_mu", "_e0", *(["_azimuth"] if bearing else []))


def elevation(ts: Column, site: Site) -> Column:
    return F.degrees(F.asin(cos_zenith(ts, site)))


def azimuth(ts: Column, site: Site) -> Column:
    """Degrees clockwise from north."""
    return _bearing(cos_zenith(ts, site), declination(ts), hour_angle(ts, site), site, ts)


def _bearing(cosz: Column, decl: Column, hours: Column, site: Site, given: Column) -> Column:
    lat = math.radians(site.latitude)
    below = F.lit(math.cos(lat)) * F.sin(F.acos(cosz))
    ratio = F.when(F.abs(below) > 1e-12, (F.lit(math.sin(lat)) * cosz - F.sin(decl)) / below).otherwise(F.lit(0.0))
    turn = F.degrees(F.acos(_clip(ratio, -1.0, 1.0, given)))
    west = F.pmod(hours + 180.0, F.lit(360.0)) - 180.0 > 0
    return F.pmod(F.when(west, turn + 180.0).otherwise(F.lit(540.0) - turn), F.lit(360.0))


def extraterrestrial(ts: Column, site: Site, constant: float = SOLAR_CONSTANT) -> Column:
    return _clip(F.lit(constant) * eccentricity(ts) * cos_zenith(ts, site), 0.0, math.inf, ts)


def clearness_index(ghi: Column, ts: Column, site: Site) -> Column:
    top = extraterrestrial(ts, site)
    return F.when(top > 0, ghi / top)


def haurwitz(cosz: Column) -> Column:
    return F.when(cosz > 0, F.lit(HAURWITZ_A) * cosz * F.exp(F.lit(-HAURWITZ_B) / cosz)).when(cosz.isNotNull(), F.lit(0.0))


def clear_sky_index(ghi: Column, ts: Column, site: Site, min_elevation: float = 10.0) -> Column:
    clear = haurwitz(cos_zenith(ts, site))
    return F.when((elevation(ts, site) >= min_elevation) & (clear > 0), ghi / clear)


def erbs(kt: Column) -> Column:
    power = lambda n: kt if n == 1 else F.pow(kt, F.lit(float(n)))
    mid = F.lit(ERBS_MID[0])
    for n, value in enumerate(ERBS_MID[1:], 1):
        mid = mid + F.lit(value) * power(n)
    return _clip(F.when(kt <= 0.22, F.lit(1.0) - F.lit(0.09) * kt).when(kt <= 0.8, mid).when(kt > 0.8, F.lit(0.165)), 0.0, 1.0, kt)


def pseudo_diffuse(ghi: Column, kt: Column) -> Column:
    return erbs(kt) * ghi


def marques_filho(kt: Column) -> Column:
    return F.lit(0.13) + F.lit(0.86) / (F.lit(1.0) + F.exp(F.lit(-6.29) + F.lit(12.26) * kt))


def logistic_diffuse(kt: Column, solar_time: Column, elev: Column, daily: Column, persistence: Column, terms: tuple[float, ...]) -> Column:
    """The diffuse fraction of ``LEMOS`` or ``RIDLEY``."""
    x = F.lit(terms[0])
    for value, c in zip(terms[1:], (kt, solar_time, elev, daily, persistence)):
        x = x + F.lit(value) * c
    return F.lit(1.0) / (F.lit(1.0) + F.exp(x))


def sky_class(kt: Column, elev: Column | None = None, min_elevation: float | None = None) -> Column:
    """0..3 by clearness, -1 where it is missing or the sun is below ``min_elevation``."""
    out = F.when(kt.isNull() | F.isnan(kt), F.lit(-1))
    for k, bound in enumerate(SKY_BOUNDS):
        out = out.when(kt <= bound, F.lit(k))
    out = out.otherwise(F.lit(3))
    return out if min_elevation is None else F.when(elev >= min_elevation, out).otherwise(F.lit(-1))


def clear_sky_reference(ts: Column, site: Site, target: str) -> Column:
    """What a clear sky would give: 1 for ``kstar``, the clearness index for ``kt``, Erbs's diffuse part for ``dhi``."""
    if target == "kstar":
        return F.lit(1.0)
    clear = haurwitz(cos_zenith(ts, site))
    kt = F.try_divide(clear, extraterrestrial(ts, site))
    if target == "kt":
        return kt
    if target == "dhi":
        return pseudo_diffuse(clear, kt)
    raise ValueError(f"no clear-sky reference for {target!r}")
