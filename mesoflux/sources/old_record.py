"""The first layout of the operational point record, brought to the present one as text.

A line has 35 fields, or 47 where a later extraction appended two fluxes behind ten cells of its own and left the named ones empty.
Every repair can be made from the row alone, so reading, repairing, counting and writing are one scan without an exchange.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import atmosphere
from .records import number

#: Names of the first layout in its order, each with its present name.
OLD_TO_NEW = {
    "year": "year", "month": "month", "day": "day", "hour": "hour", "T": "t2_c", "ur": "rh_pct", "pressure": "psfc_hpa", "e": "e_hpa", "es": "es_pa", "q": "q2_g_kg", "WS": "wind_speed_m_s", "WD": "wind_dir_deg", "u": "u10_m_s", "v": "v10_m_s",
    "Swdw": "swdown_w_m2", "Swdw_b": "swdnb_w_m2", "Swdw_farms": "swdown_farms_w_m2", "Swup_b": "swupb_w_m2", "Swup_calc": "swup_w_m2", "Swdf": "swddif_w_m2", "Swdf_farms": "swddif_farms_w_m2", "Swdr": "swddir_w_m2", "Swdr_farms": "swddir_farms_w_m2",
    "Lwdw_glw": "glw_w_m2", "Lwdw_b": "lwdnb_w_m2", "Lwup_b": "lwup_w_m2", "Lwup_calc": "lwup_air_w_m2", "ALBD": "albedo", "EMISS": "emissivity", "H": "hfx_w_m2", "LE": "lh_w_m2", "G": "grdflx_w_m2", "ustar": "ustar_m_s", "PBLH": "pblh_m", "TSM": "sst_c",
}
OLD = tuple(OLD_TO_NEW)
#: What has no meaning before the radiation scheme's first call; the width and places of the appended cells; the
#: emissivity of rows that carry none and how far a row may be from its own.
PHYSICS = tuple(c for c in OLD if c.startswith(("Sw", "Lw")) or c in ("ALBD", "EMISS", "H", "LE", "G", "ustar", "PBLH"))
WIDE, APPENDED = 47, {"Swup_calc": 45, "Lwup_calc": 46}
EMISSIVITY, TOLERANCE = 0.88, 0.02
KELVIN, SIGMA = 273.15, 5.670374419e-08
REPAIRED = ("ALBD", "EMISS", "Swup_calc", "Lwup_calc", "e", "ur")


@dataclass(frozen=True)
class Migration:
    """Rows written, cells taken from the appended places, and cells repaired and blanked, by present column names."""

    rows: int
    recovered: int
    repaired: Mapping[str, int] = field(default_factory=dict)
    blanked: Mapping[str, int] = field(default_factory=dict)


def read_old_record(spark: SparkSession, path: str) -> DataFrame:
    """The old columns as the text that the files hold, and ``_recovered``, the cells taken from the appended places.

    ``path`` may be a folder. Blank lines are skipped. A file whose only header isn't the old one is an error, and so is a row of another
    width; a look at one row a file comes first, the widths are judged while the rows are read. No file at all is Spark's error.
    """
    header = ",".join(OLD)
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"), F.col("_metadata.file_path").alias("file")).where("trim(line) <> ''")
    is_head = F.col("line").rlike(r"^\s*[A-Za-z]")
    heads = lines.groupBy("file").agg(F.count_if(is_head).alias("n"), F.max(F.when(is_head, F.col("line"))).alias("head"))
    wrong = heads.where((F.col("n") != 1) | (F.col("head") != header)).orderBy("file").limit(1).collect()
    if wrong:
        new = (wrong[0].head or "").split(",")[: len(OLD)] == list(OLD_TO_NEW.values())
        raise ValueError(f"{wrong[0].file} " + ("has the present layout already" if new else "does not have the old record's header, once"))
    cells = lines.where(~is_head).select(F.split("line", ",", -1).alias("c"), "file", "line")
    known = F.size("c").isin(len(OLD), WIDE)
    message = F.concat(F.col("file"), F.lit(": a row has "), F.size("c").cast("string"), F.lit(f" fields, not {len(OLD)} or {WIDE}: "), F.substring("line", 1, 60))
    cells = cells.select(F.when(known, F.col("c")).otherwise(F.raise_error(message).cast("array<string>")).alias("c"))
    spare = {c: F.trim(F.get("c", F.lit(k))) for c, k in APPENDED.items()}
    taken = {c: F.coalesce((F.size("c") == WIDE) & (v != ""), F.lit(False)) for c, v in spare.items()}
    named = [F.when(taken[c], spare[c]).otherwise(F.col("c")[k]).alias(c) if c in spare else F.col("c")[k].alias(c) for k, c in enumerate(OLD)]
    return cells.select(*named, sum((t.cast("int") for t in taken.values()), F.lit(0)).alias("_recovered"))


def _text(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.4f", c))


def repaired_record(old: DataFrame) -> DataFrame:
    """``old`` with repaired cells as text of four decimals, under present names, with ``precip_mm`` (never sampled: nan), ``_recovered``,
    ``_repaired`` and ``_blanked`` (arrays of the present names changed in the row). Cells that no rule touches keep their text.

    * ALBD and EMISS were stored less 273.15; the reflected shortwave was short of 273.15 times the downward one.
    * The upwelling longwave took the temperature in Celsius and that emissivity: it is made anew in Kelvin, with the row's emissivity or
      0.88. A cell that the old formula does not explain to 0.02 of emissivity fails the job; a repair would invent a flux.
    * Vapour pressure is made anew from the mixing ratio in g/kg, relative humidity from it, above 100 too.
    * Where the downward longwave is 0, physics cells that hold anything become nan.

    A cell whose inputs aren't finite numbers is left as it is.
    """
    n = {c: number(F.col(c)) for c in ("T", "q", "pressure", "es", "Swdw", "Swup_calc", "Lwup_calc", "Lwdw_glw", "ALBD", "EMISS")}
    emiss = _text(n["EMISS"] + KELVIN)
    used = F.coalesce(emiss.try_cast("double"), F.lit(EMISSIVITY))
    celsius4 = SIGMA * F.pow(n["T"], F.lit(4.0))
    strange = F.abs(n["Lwup_calc"] - (used - KELVIN) * celsius4) > TOLERANCE * celsius4
    where = F.concat_ws("-", "year", "month", "day", "hour")
    lw = F.when(strange, F.raise_error(F.concat(F.lit("the old formula does not explain Lwup_calc at "), where)).cast("double")).otherwise(used * SIGMA * F.pow(n["T"] + KELVIN, F.lit(4.0)))
    vapor = atmosphere.vapor_pressure(n["q"] / 1000.0, n["pressure"])
    dry = n["es"] == 0
    made = {
        "ALBD": n["ALBD"] + KELVIN, "EMISS": n["EMISS"] + KELVIN, "Swup_calc": n["Swup_calc"] + KELVIN * n["Swdw"],
        "Lwup_calc": F.when(n["Lwup_calc"].isNotNull() & n["T"].isNotNull(), lw), "e": vapor, "ur": F.when(~dry, 100.0 * vapor * 100.0 / n["es"]),
    }
    # each formula is made once; a filter or flag above would repeat it at every reference
    rows = atmosphere.computed(old, {f"_m_{c}": v for c, v in made.items()})
    cold = F.coalesce(number(F.col("Lwdw_glw")) == 0, F.lit(False))
    got = {c: F.coalesce(_text(F.col(f"_m_{c}")), F.col(c)) if c in REPAIRED else F.col(c) for c in OLD}
    blank = {c: cold & (F.trim(got[c]) != "") for c in PHYSICS}
    named = lambda flags: F.array_compact(F.array(*[F.when(f, F.lit(OLD_TO_NEW[c])) for c, f in flags.items()]))
    out = [F.when(blank[c], F.lit("nan")).otherwise(got[c]).alias(OLD_TO_NEW[c]) if c in blank else got[c].alias(OLD_TO_NEW[c]) for c in OLD]
    return rows.select(*out, F.lit("nan").alias("precip_mm"), "_recovered", named({c: F.col(f"_m_{c}").isNotNull() for c in REPAIRED}).alias("_repaired"), named(blank).alias("_blanked"))


def migrate_old_record(spark: SparkSession, source: str, target: str) -> Migration:
    """The old record of ``source`` written to ``target`` as CSV in the present layout, and what was changed, counted by the same scan.

    ``target`` must not exist; ``source`` is left as it is, so a second run repairs nothing twice. Rows keep their order within a file's parts.
    """
    rows = repaired_record(read_old_record(spark, source))
    seen = Observation()
    has = lambda kind, name: F.count_if(F.array_contains(kind, name))
    counts = [has("_repaired", OLD_TO_NEW[c]).alias(f"r:{OLD_TO_NEW[c]}") for c in REPAIRED] + [has("_blanked", OLD_TO_NEW[c]).alias(f"b:{OLD_TO_NEW[c]}") for c in PHYSICS]
    rows.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum("_recovered"), F.lit(0)).alias("recovered"), *counts).drop("_recovered", "_repaired", "_blanked").write.option("header", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(target)
    got = seen.get
    part = lambda p: {k[2:]: v for k, v in got.items() if k.startswith(p) and v}
    return Migration(got["rows"], got["recovered"], part("r:"), part("b:"))
