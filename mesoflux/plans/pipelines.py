"""Composed pipelines: station archive, sensor folder, run comparison, point series, sky statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import solar
from ..functions.atmosphere import computed
from ..functions.solar import Site
from ..operators import calibration, grid, hourly, joins, metrics, quality, segments
from ..sources import publish, records

SHORTWAVE = ("Sw_dw", "Sw_dif", "Sw_up", "Sw_par")


@dataclass(frozen=True)
class ArchiveRules:
    sentinels: Sequence[quality.Sentinel] = ()
    ranges: Sequence[tuple[str, float | None, float | None]] = ()
    calibrations: Sequence[calibration.Calibration] = ()
    steps: Sequence[tuple[str, float, float, int]] = ()
    persistence: Sequence[tuple[str, int]] = ()
    switches: Sequence[calibration.Switch] = ()
    sums: Sequence[str] = ()
    directions: Mapping[str, str] = field(default_factory=dict)


def build_station_archive(raw: DataFrame, rules: ArchiveRules, site: Site, keys: Sequence[str] = (), ts: str = "ts", min_samples: int = 6, folder: str | None = None, step_seconds: float = 300.0, slice_rows: int = segments.ROWS) -> dict[str, DataFrame]:
    """``raw``, ``qc`` and ``hourly`` tables; with ``folder`` each is written there, by year, and the hours are made of the written one.

    Without keys the record is one series, whose statistical tests run on ranges of time of about ``slice_rows`` rows.

    The order matters: gates are in raw units and come before calibration, statistical
    tests before the second gate, and that before unification and the solar stage."""
    here = [c for c in SHORTWAVE if c in raw.columns]
    closes = {"Sw_dw", "Sw_up", "Lw_dw", "Lw_up"} <= set(raw.columns)
    df = quality.mask_sentinels(raw, rules.sentinels, ts)
    df = calibration.apply_calibrations(quality.range_gate(df, rules.ranges), rules.calibrations, ts)
    df = _statistical_tests(df, rules, keys, ts, step_seconds, slice_rows, raw)
    df = quality.range_gate(df, rules.ranges)
    if rules.switches:
        df = calibration.unify_columns(df, rules.switches, ts)
    if here or closes:
        df = quality.with_sun(df, site, ts)
    if here:
        df = quality.mask_corrupted_days(df, site, here, [*here, "Lw_dw", "Lw_up", "Net_CNR1"], keys, ts)
        df = quality.mask_nocturnal(quality.mask_impossible(df, site, ts), site, here, ts)
    if closes:
        df = quality.close_net_radiation(df, night=F.col("_mu") < 0)
    df = df.drop("_mu", "_e0")
    if folder is not None:
        spark = raw.sparkSession
        publish.write_archive_tables({"raw": raw, "qc": df}, folder, ts)
        raw, df = [spark.read.parquet(f"{folder}/{name}").drop("year") for name in ("raw", "qc")]
    ready = quality.drop_ungated(df)
    values = [f.name for f in ready.schema.fields if f.dataType.typeName() == "double"]
    out = hourly.aggregate_hourly(ready, values, sums=rules.sums, directions=[c for c in rules.directions if c in values], speeds=rules.directions, keys=keys, ts=ts, min_samples=min_samples)
    if folder is not None:
        publish.write_archive_tables({"hourly": out}, folder, ts)
        out = raw.sparkSession.read.parquet(f"{folder}/hourly").drop("year")
    return {"raw": raw, "qc": df, "hourly": out}


def _statistical_tests(df: DataFrame, rules: ArchiveRules, keys: Sequence[str], ts: str, step_seconds: float, slice_rows: int, stamps: DataFrame) -> DataFrame:
    """Step and persistence tests in their order. Rules of different columns share one pass over ranges of time; a second rule of a column needs the first one's result around its edges."""
    layers: list[list[tuple]] = [[]]
    for rule in [("step", *r) for r in rules.steps] + [("run", *r) for r in rules.persistence]:
        if rule[1] in df.columns:
            if rule[1] in {r[1] for r in layers[-1]}:
                layers.append([])
            layers[-1].append(rule)

    def tested(layer: Sequence[tuple]):
        def run(rows: DataFrame, by: Sequence[str]) -> DataFrame:
            for kind, column, *args in layer:
                rows = quality.step_excursions(rows, column, *args, by, ts, step_seconds) if kind == "step" else quality.persistent_runs(rows, column, *args, by, ts, f"{step_seconds} seconds")
            return rows

        return run

    for layer in filter(None, layers):
        if keys:
            df = tested(layer)(df, keys)
            continue
        reach = step_seconds * max(2 * (r[-1] + 2) if r[0] == "step" else r[-1] + 1 for r in layer)
        calm = [(r[1], r[2], r[4]) for r in layer if r[0] == "step"]
        df = segments.scan(df, tested(layer), ts=ts, before=reach, after=reach, calm=calm, step_seconds=step_seconds, stamps=stamps, rows=slice_rows)
    return df


def process_sensor_folder(spark: SparkSession, folder: str, target: str, ranges: Sequence = (), records_: Sequence[calibration.Calibration] = (), freq: str = "1 hour", min_samples: int = 6, decimals: int = 3, **read) -> None:
    """Logger files of a folder merged, gated, calibrated, averaged and exported; windows that open off the hour fail the export."""
    merged = records.scan_directory(spark, folder, **read)
    gated = calibration.apply_calibrations(quality.range_gate(merged, ranges), records_)
    values = [f.name for f in gated.schema.fields if f.dataType.typeName() == "double"]
    publish.export_csv(hourly.aggregate_hourly(gated, values, freq=freq, min_samples=min_samples), target, decimals=decimals)


def load_station_hourly(spark: SparkSession, path: str, *, prepared: bool | None = None, calibrations: Sequence[calibration.Calibration] = (), columns: Sequence[str] | None = None, types: Mapping[str, str] | None = None, limit: int | None = None, freq: str | None = "1 hour", min_samples: int = 6, **read) -> DataFrame:
    """A station's hours, ``ts`` and its channels, from a prepared table or from a folder of logger files.

    A path that ends in ``.csv`` or ``.parquet`` is a prepared table, unless ``prepared`` says otherwise. Its stamp is ``ts``, or the first column of
    a Parquet table without one; of CSV, what ``read_timeseries_csv`` takes for it. Stamps that don't parse go. Its values are taken as they are:
    calibrations and windows are for folders only. A folder without matching files is an error; ``freq=None`` keeps the logging interval.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if prepared if prepared is not None else suffix in ("csv", "parquet"):
        if suffix == "parquet":
            raw = spark.read.parquet(path)
            stamp = "ts" if "ts" in raw.columns else raw.columns[0]
            at = F.try_to_timestamp(stamp) if raw.schema[stamp].dataType.typeName() == "string" else F.col(f"`{stamp}`")
            out = raw.select(at.cast("timestamp_ntz").alias("ts"), *[F.col(f"`{c}`") for c in raw.columns if c != stamp]).where("ts IS NOT NULL")
        else:
            out = records.read_timeseries_csv(spark, path)
    else:
        out = calibration.apply_calibrations(records.scan_directory(spark, path, **read), calibrations)
        if freq is not None:
            values = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
            out = hourly.aggregate_hourly(out, values, freq=freq, min_samples=min_samples)
    if columns is not None:
        out = out.select("ts", *[F.col(f"`{c}`") for c in columns if c != "ts"])
    out = out.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in (types or {}).items()})
    return out if limit is None else out.orderBy("ts").limit(limit)


def compare_runs(obs: DataFrame, model: DataFrame, keys: Sequence[str] = (), ts: str = "ts", tolerance: str | None = "30 minutes") -> DataFrame:
    """Scores of every column that both have; no common column, or no pair at all, is an error."""
    common = [c for c in obs.columns if c in model.columns and c not in (*keys, ts)]
    if not common:
        raise ValueError("the runs have no column in common")
    if tolerance is None:
        paired = joins.join_on_index(obs, model, [*keys, ts], ("_obs", "_model"))
    else:
        paired = joins.asof_nearest(obs, model, keys, ts, tolerance, common)
    table = metrics.paired_table(paired, common)
    if not table.limit(1).count():
        raise ValueError("the runs have no pair of values in common")
    return table


def publish_station_series(fields: DataFrame, stations: DataFrame, domains: DataFrame, cells: DataFrame, path: str, wanted: Sequence[str] | None = None, batch: tuple[str, int] | None = None) -> bool:
    """Stations to their finest domain and nearest cell, the catalogue's columns at that cell, appended unless already there; whether there were any new rows.

    One plan for any number of domains; the append happens once or not at all.
    """
    placed = joins.assign_domains(stations, domains).where("domain IS NOT NULL")
    if placed.isEmpty():
        raise ValueError("no station lies in any domain")
    located = joins.nearest_cell(placed, cells, by=["domain"])
    at = fields.join(located.select("name", "domain", "y", "x"), ["domain", "y", "x"])
    series = grid.operational_record(at, ["name"], wanted).withColumnRenamed("valid_time", "ts")
    return publish.append_block(series, path, ["name", "ts"], batch=batch)


def ktkd_table(df: DataFrame, site: Site, ghi: str = "Sw_dw", dhi: str = "Sw_dif", keys: Sequence[str] = (), ts: str = "ts", min_ghi: float = 50.0) -> DataFrame:
    """Hours with kt, kd, apparent solar time, elevation, the day's clearness and its neighbours' mean, and three model fractions."""
    base = quality.prepare_clearness(df, site, ghi, ts)
    base = joins.neighbour_mean(joins.daily_ratio(base, ghi, "e0", keys, ts), "kt", keys, ts)
    mid = F.col(ts) + F.expr("INTERVAL 30 MINUTES")
    base = computed(base, {"kd": F.try_divide(F.col(dhi), F.col(ghi)), "ast": solar.apparent_solar_time(mid, site), "elevation": solar.elevation(mid, site)})
    kept = base.where((F.col(ghi) > min_ghi) & F.col("kt").between(0, 1.2) & F.col("kd").between(0, 1.2))
    args = [F.col(c) for c in ("kt", "ast", "elevation", "daily_kt", "psi")]
    return kept.withColumns({"marques_filho": solar.marques_filho(args[0]), "lemos": solar.logistic_diffuse(*args, solar.LEMOS), "ridley": solar.logistic_diffuse(*args, solar.RIDLEY)})


def radiation_plausibility(df: DataFrame, site: Site, ghi: str = "Sw_dw", dhi: str = "Sw_dif", rain: str = "precip", keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """The chained tests of hourly radiation; one row with the survivors after each."""
    base = computed(df, {"_e": solar.extraterrestrial(F.col(ts), site), "_el": solar.elevation(F.col(ts), site)})
    g, d, e = F.col(ghi), F.col(dhi), F.col("_e")
    w = joins.Window.partitionBy(*keys).orderBy(ts) if keys else joins.Window.partitionBy(F.lit(0)).orderBy(ts)
    next_hour = F.col(ts) == F.lag(ts).over(w) + F.expr("INTERVAL 1 HOUR")
    change = lambda c, top: ~F.coalesce(next_hour & (F.abs(c - F.lag(c).over(w)) >= top), F.lit(False))
    tests = {
        "rain": F.coalesce(F.col(rain) <= 0, F.lit(True)), "elevation": F.col("_el") > 10, "global": F.try_divide(g, e) < 1, "diffuse": F.try_divide(d, e) <= 0.8, "ratio": F.try_divide(d, g) <= 1.1,
        "global_change": change(F.try_divide(g, e), 0.75), "diffuse_change": change(F.try_divide(d, e), 0.35),
    }
    flags = base.withColumns({f"_t_{n}": F.coalesce(t, F.lit(False)) for n, t in tests.items()})
    out, so_far = [], F.col(ghi).isNotNull()
    for n in tests:
        so_far = so_far & F.col(f"_t_{n}")
        out.append(F.count_if(so_far).alias(n))
    return flags.agg(F.count(ghi).alias("all"), *out)
