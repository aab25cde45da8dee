"""The sample manifest: features, targets, flags, validation, and its evaluation table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import atmosphere, solar
from ..functions.solar import Site
from ..sources.scratch import scratch_path
from . import joins, metrics, windows

#: Bits of the flag column.
LOW_SUN, SENSOR_GAP, ALIGNMENT_FAR, KT_ARTIFACT, FRAME_UNREADABLE = 1, 2, 4, 8, 256
VERSION = "v2"
MET_CHANNELS = ("AirT1_C_Avg", "DP1_C_Avg", "RH1", "BP1_mbar_Avg", "WS_ms")
SETS = {"minimal": ("solar",), "safe": ("solar", "season", "wind", "met"), "extended": ("solar", "season", "wind", "met", "clear")}
FORBIDDEN = ("CM3Up_Wm2_Avg", "PSP_Wm2_Avg", "target_")


def day_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def sample_id(ts: Column, prefix: str = "sky") -> Column:
    return F.concat(F.lit(prefix + "-"), F.date_format(ts, "yyyyMMdd-HHmm"))


def relative_path(path: Column, root: str) -> Column:
    """The path under ``root``; an absolute rest or a ``..`` in it fails the job."""
    rest = F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), "^" + root.rstrip("/") + "/", "")
    bad = rest.startswith("/") | rest.rlike(r"(^|/)\.\.(/|$)")
    return F.when(bad, F.raise_error(F.concat(F.lit("not below the root: "), path)).cast("string")).otherwise(rest)


def unique_or_fail(df: DataFrame, column: str) -> DataFrame:
    twice = df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{column} {twice[0][0]!r} occurs {twice[0].n} times")
    return df


def feature_columns(df: DataFrame, site: Site, feature_set: str = "safe", ts: str = "ts", direction: str = "WindDir", sun: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """Name -> expression of a feature set, in policy order; leaky sources are refused.

    ``sun``: the cosine of the zenith angle and the azimuth where they are columns already, as of ``solar.with_sun``; the formulas are long.
    """
    if feature_set not in SETS:
        raise ValueError(f"unknown feature set {feature_set!r}")
    t, turn = F.col(ts), 2 * 3.141592653589793
    mu, azimuth = sun or (solar.cos_zenith(t, site), solar.azimuth(t, site))
    elevation = F.degrees(F.asin(mu))
    groups = {
        "solar": {"solar_elevation": elevation, "solar_zenith": F.lit(90.0) - elevation, "azimuth_sin": F.sin(F.radians(azimuth)), "azimuth_cos": F.cos(F.radians(azimuth))},
        "season": {"doy_sin": F.sin(F.lit(turn) * F.dayofyear(t) / 365.25), "doy_cos": F.cos(F.lit(turn) * F.dayofyear(t) / 365.25)},
        "wind": {"wind_sin": F.sin(F.radians(direction)), "wind_cos": F.cos(F.radians(direction))} if direction in df.columns else {},
        "met": {c: F.col(c) for c in MET_CHANNELS if c in df.columns},
        "clear": {"clear_sky_ghi": solar.haurwitz(mu)},
    }
    out = {n: c for g in SETS[feature_set] for n, c in groups[g].items()}
    leaky = [n for n in out if any(n.startswith(f) for f in FORBIDDEN)]
    if leaky:
        raise ValueError(f"features {leaky} leak the target")
    return out


def qc_flags(elevation: Column, distance_minutes: Column, kt: Column, low_sun: float = 10.0, far_minutes: float = 2.5, kt_top: float = 1.2) -> Column:
    bit = lambda cond, b: F.when(F.coalesce(cond, F.lit(False)), F.lit(b)).otherwise(F.lit(0))
    return (bit(elevation < low_sun, LOW_SUN) + bit(kt.isNull(), SENSOR_GAP) + bit(distance_minutes > far_minutes, ALIGNMENT_FAR) + bit(kt > kt_top, KT_ARTIFACT)).cast("long")


def build_manifest(frames: DataFrame, sensors: DataFrame, site: Site, keys: Sequence[str] = (), ts: str = "ts", ghi: str = "CM3Up_Wm2_Avg", dhi: str = "PSP_Wm2_Avg", feature_set: str = "safe", min_elevation: float = 0.0, max_distance: str = "5 minutes", k_kind: str = "kstar") -> DataFrame:
    """Frames paired with the nearest sensor row, with features, targets, sky class, flags and ids; night and gaps in features go."""
    first = F.row_number().over(Window.partitionBy(*keys, ts).orderBy("frame_path"))
    once = frames.withColumn("_k", first).where("_k = 1").drop("_k")
    paired = joins.pair_frames(once, sensors, keys, ts, max_distance)
    # the sun once, then what hangs on it: as single expressions these are more than can be compiled
    sunny = solar.with_sun(paired, site, ts, bearing=True)
    features = feature_columns(sunny, site, feature_set, ts, sun=(F.col("_mu"), F.col("_azimuth")))
    base = atmosphere.computed(sunny, features)
    finite = atmosphere.finite
    complete = None
    for n in features:
        complete = finite(F.col(n)).isNotNull() if complete is None else complete & finite(F.col(n)).isNotNull()
    base = base.where(complete & (F.col("solar_elevation") >= min_elevation))
    t, g = F.col(ts), F.col(ghi)
    top, clear = F.lit(solar.SOLAR_CONSTANT) * F.col("_e0") * F.col("_mu"), solar.haurwitz(F.col("_mu"))
    kt = F.when(top > 0, g / top)
    kstar = F.when((F.col("solar_elevation") >= 10.0) & (clear > 0), g / clear)
    measured = finite(F.col(dhi)) if dhi in sensors.columns else F.lit(None).cast("double")
    base = atmosphere.computed(base, {"target_kt": kt, "target_kindex": kstar if k_kind == "kstar" else kt})
    base = base.withColumns({
        "target_dhi": F.coalesce(measured, solar.pseudo_diffuse(g, F.col("target_kt"))),
        "target_source": F.when(measured.isNotNull(), "measured").otherwise("erbs"), "kindex_kind": F.lit(k_kind),
        "sky_class": solar.sky_class(F.col("target_kt"), F.col("solar_elevation"), 10.0).cast("long"),
        "qc_flags": qc_flags(F.col("solar_elevation"), F.col("distance_minutes"), F.col("target_kt")),
        "sample_id": sample_id(t), "day_id": day_id(t), "timestamp_utc": (t - F.expr(f"INTERVAL {int(site.offset * 60)} MINUTES")).cast("timestamp"), "dataset_version": F.lit(VERSION),
    })
    out = ["sample_id", *keys, "timestamp_utc", ts, "day_id", *[c for c in ("frame_path", "index", "video") if c in base.columns], *features, "target_dhi", "target_source", "target_kindex", "kindex_kind", "target_kt", "sky_class", "qc_flags", "distance_minutes", "dataset_version"]
    return base.select(*out)


def validate_manifest(df: DataFrame, features: Sequence[str], min_elevation: float = 0.0, constant: Sequence[str] = ("kindex_kind", "normalizer_version", "provenance"), keys: Sequence[str] = ()) -> DataFrame:
    """(severity, check, n, sample): every broken rule of a manifest, how often, and the least id that breaks it, from one pass and one
    grouped count for each kind of duplicate. ``constant``: columns that must have one value throughout. ``keys``: the station, where there
    are several; a stamp is a duplicate only within one."""
    required = ["sample_id", "timestamp_utc", "day_id", "qc_flags", "dataset_version", *features, *keys]
    missing = [c for c in required if c not in df.columns]
    leaks = [c for c in features if any(c.startswith(f) for f in FORBIDDEN)]
    spark = df.sparkSession
    schema = "severity string, check string, n long, sample string"
    static = [("error", f"missing column {c}", 1, None) for c in missing] + [("error", f"forbidden feature {c}", 1, None) for c in leaks]
    if "timestamp_utc" in df.columns and df.schema["timestamp_utc"].dataType.typeName() != "timestamp":
        static.append(("error", "timestamp_utc has no zone", 1, None))
    if missing:
        return spark.createDataFrame(static, schema)
    rules = [("error", "version", F.col("dataset_version") != VERSION), ("error", "null id", F.col("sample_id").isNull()), ("error", "null stamp", F.col("timestamp_utc").isNull())]
    rules += [("error", f"non-finite {c}", atmosphere.finite(F.col(c)).isNull()) for c in features]
    if "solar_elevation" in df.columns:
        rules.append(("error", "sun below the floor", F.col("solar_elevation") < min_elevation))
    for c, low, high in (("target_dhi", 0, 1500), ("target_kt", 0, 2), ("target_kindex", 0, 3), ("cloud_fraction", 0, 1)):
        if c in df.columns:
            rules.append(("warning", f"{c} out of range", (F.col(c) < low) | (F.col(c) > high)))
    if "sky_class" in df.columns:
        rules.append(("error", "sky_class out of domain", ~F.col("sky_class").between(-1, 3)))
    broken = lambda c: F.coalesce(c, F.lit(False))
    found = [F.struct(F.lit(s).alias("severity"), F.lit(k).alias("check"), F.count_if(broken(c)).alias("n"), F.min(F.when(broken(c), F.col("sample_id").cast("string"))).alias("sample")) for s, k, c in rules]
    mixed = [F.struct(F.lit("error").alias("severity"), F.lit(f"mixed {c}").alias("check"), F.greatest(F.count_distinct(c) - 1, F.lit(0)).alias("n"), F.lit(None).cast("string").alias("sample")) for c in constant if c in df.columns]
    out = df.agg(F.array(*found, *mixed).alias("r")).select(F.inline("r"))

    def groups(by: Sequence[str], n: Column, severity: str, check: str) -> DataFrame:
        many = df.groupBy(*by).agg(n.alias("m"), F.min(F.col("sample_id").cast("string")).alias("sample")).where("m > 1")
        return many.agg(F.count("*").alias("n"), F.min("sample").alias("sample")).select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), "n", "sample")

    out = out.unionByName(groups(["sample_id"], F.count("*"), "error", "duplicate sample_id")).unionByName(groups([*keys, "timestamp_utc"], F.count("*"), "warning", "duplicate timestamp_utc"))
    if "split" in df.columns:
        out = out.unionByName(groups(["day_id"], F.count_distinct("split"), "error", "day in two splits"))
    out = out.unionByName(spark.createDataFrame(static, schema)) if static else out
    return out.where("n > 0")


def with_clear_sky(df: DataFrame, site: Site, target: str, ts: str = "ts") -> DataFrame:
    """``df`` with ``clear_sky``, as ``solar.clear_sky_reference``, and ``_elevation``.

    One step after the other, each a plain column for the next: as a single expression the sun is in it some hundred times over, more than
    can be compiled.
    """
    if target not in ("kstar", "kt", "dhi"):
        raise ValueError(f"no clear-sky reference for {target!r}")
    mu = atmosphere.computed(solar.with_sun(df, site, ts), {"_top": F.when(F.col("_mu").isNotNull(), F.greatest(F.lit(0.0), F.lit(solar.SOLAR_CONSTANT) * F.col("_e0") * F.col("_mu"))), "_elevation": F.degrees(F.asin("_mu"))}).drop("_e0")
    clear = atmosphere.computed(mu, {"_clear": solar.haurwitz(F.col("_mu"))})
    kt = atmosphere.computed(clear, {"_clear_kt": F.try_divide("_clear", "_top")})
    out = {"kstar": F.lit(1.0), "kt": F.col("_clear_kt"), "dhi": solar.pseudo_diffuse(F.col("_clear"), F.col("_clear_kt"))}[target]
    return atmosphere.computed(kt, {"clear_sky": out}).drop("_mu", "_top", "_clear", "_clear_kt")


def evaluate_predictions(df: DataFrame, target: str, site: Site, keys: Sequence[str] = (), ts: str = "ts", split: str | None = None, reference: str = "dhi") -> dict[str, DataFrame]:
    """Scores overall and by stratum, and skill against persistence and a clear sky. ``df``: obs_<target>, pred_<target>, day_id."""
    rows = df if split is None else df.where(F.col("split") == split)
    obs, pred = f"obs_{target}", f"pred_{target}"
    base = windows.persistence_reference(rows, obs, "day_id", keys, ts)
    base = with_clear_sky(base, site, reference, ts)
    strata = {"elevation": F.floor(F.col("_elevation") / 10) * 10, "hour": F.hour(ts), "month": F.month(ts)}
    if "obs_sky" in base.columns:
        strata["class"] = F.col("obs_sky")
    if "qc_flags" in base.columns:
        strata["qc"] = F.when(F.col("qc_flags") == 0, "clean").otherwise("flagged")
    # references, sun and strata are made once and then read for every table
    skies = [c for c in ("obs_sky", "pred_sky") if c in base.columns]
    path = scratch_path(df.sparkSession, "evaluated")
    made = base.select(obs, pred, f"persistence_{obs}", "clear_sky", *skies, *[c.cast("string").alias(f"_s_{k}") for k, c in strata.items()])
    made.write.parquet(path)
    base = df.sparkSession.read.schema(made.schema).parquet(path)
    strata = {k: F.col(f"_s_{k}") for k in strata}
    out = {
        "strata": metrics.stratified(base, obs, pred, strata, ["n", "rmse", "mae", "mbe", "nmae", "nrmse"]),
        "persistence": metrics.skill(base, obs, pred, f"persistence_{obs}"), "clear_sky": metrics.skill(base, obs, pred, "clear_sky"),
    }
    if {"obs_sky", "pred_sky"} <= set(base.columns):
        out["classes"] = metrics.classification(base, "obs_sky", "pred_sky", [0, 1, 2, 3])
        out["confusion"] = metrics.confusion(base, "obs_sky", "pred_sky", [0, 1, 2, 3])
    return out


def consolidate_parts(parts: Sequence[DataFrame], key: str = "sample_id") -> DataFrame:
    """Union of an index and part tables, one row a key: that of the last part which has it."""
    out = None
    for order, p in enumerate(parts):
        tagged = p.withColumn("_part", F.lit(order))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_part")))
    return out.withColumn("_k", last).where("_k = 1").drop("_k", "_part")


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """A deterministic distinct."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")
