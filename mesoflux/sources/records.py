"""Readers of station logger files, time-series tables, model point records, station lists, rules and grids.

Files are parsed by Spark; only headers, which are a few names, come to the driver. Missing values become null at the scan.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.atmosphere import finite, saturation_vapor_pressure

STAMP = "TIMESTAMP"


def number(c: Column, sentinel: float | None = None) -> Column:
    """Text to a finite double; null for anything else and for values at or below the sentinel."""
    v = finite(c.try_cast("double"))
    return v if sentinel is None else F.when(v > sentinel, v)


def _split_csv(line: str, sep: str) -> list[str]:
    return [p.strip().strip('"') for p in line.rstrip("\r\n").split(sep)]


def read_toa5(spark: SparkSession, path: str, *, sep: str = ",", timestamp_column: str = STAMP, drop: Sequence[str] = ("RECORD",), sentinel: float | None = -900.0, text_columns: Sequence[str] = (), header_line: int = 1, header_lines: int = 4) -> DataFrame:
    """One logger file: names on the second line, then units and aggregation lines, then rows. ``path`` may be a folder that holds the file in
    parts, in name order, with the header in the first.

    Bad stamps and repeated ones (the first row of a stamp stays) are dropped.
    """
    lines = spark.read.text(path)
    parts = sorted(f.rsplit("/", 1)[-1] for f in lines.inputFiles())
    top = lines if len(parts) < 2 else lines.where(F.col("_metadata.file_name").isin(parts[0], unquote(parts[0])))
    head = [r.value for r in top.limit(header_lines).collect()]
    if len(head) <= header_line or timestamp_column not in _split_csv(head[header_line], sep):
        raise ValueError(f"{path} has no {timestamp_column} column on line {header_line + 1}")
    names = _split_csv(head[header_line], sep)
    if len(set(names)) != len(names):
        raise ValueError(f"{path} names a column twice")
    raw = spark.read.option("sep", sep).option("quote", '"').schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    ts = F.try_to_timestamp(timestamp_column).cast("timestamp_ntz")
    kept = [n for n in names if n != timestamp_column and n not in drop]
    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]
    rows = raw.select(ts.alias("ts"), *place, *[(F.col(f"`{n}`") if n in text_columns else number(F.col(f"`{n}`"), sentinel)).alias(n) for n in kept]).where("ts IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("ts").orderBy("_path", "_block", "_line"))
    return rows.withColumn("_k", first).where("_k = 1").drop("_k", "_path", "_block", "_line")


def merge_sources(frames: Sequence[DataFrame], keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Union of all columns; rows of one stamp collapse column by column, the first frame that has a value winning.

    ``min_by`` over the frame's number combines on the map side, so hot stamps cost nothing extra.
    """
    out = None
    for order, f in enumerate(frames):
        tagged = f.withColumn("_file", F.lit(order))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    values = [c for c in out.columns if c not in (*keys, "_file")]
    return out.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_file"))).alias(c) for c in values])


@dataclass(frozen=True)
class Repair:
    """shift_until: stamps up to it move an hour ahead; drop_from: rows from it on go; keep: only [start, end) stays."""

    shift_until: str | None = None
    drop_from: str | None = None
    keep: tuple[str | None, str | None] = (None, None)


def apply_repair(df: DataFrame, repair: Repair, ts: str = "ts") -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    if repair.shift_until is not None:
        df = df.withColumn(ts, F.when(F.col(ts) <= at(repair.shift_until), F.col(ts) + F.expr("INTERVAL 1 HOUR")).otherwise(F.col(ts)))
    if repair.drop_from is not None:
        df = df.where(F.col(ts) < at(repair.drop_from))
    low, high = repair.keep
    if low is not None:
        df = df.where(F.col(ts) >= at(low))
    return df.where(F.col(ts) < at(high)) if high is not None else df


def scan_manifest(spark: SparkSession, entries: Sequence[Mapping], folder: str, *, sep: str = ",", timestamp_column: str = STAMP, drop: Sequence[str] = ("RECORD",), sentinel: float | None = -900.0, text_columns: Sequence[str] = ()) -> DataFrame:
    """Ordered file entries ({path, repair}) as one merged record: of each stamp, column by column, the first value in the order of the entries.

    One scan of all files; the entries' repairs are a table beside it, joined on the file's path. A missing file, or one without a header,
    fails before anything is read as data.
    """
    local = spark._jvm.org.apache.hadoop.fs.Path
    places = [local(f"{folder}/{e['path']}") for e in entries]
    raw_paths = [p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().getRawPath() for p in places]
    if len(set(raw_paths)) != len(raw_paths):
        raise ValueError("the manifest names a file twice")
    repairs = [e.get("repair") or Repair() for e in entries]
    manifest = spark.createDataFrame(
        [(k, p, r.shift_until, r.drop_from, *r.keep) for k, (p, r) in enumerate(zip(raw_paths, repairs))], "_order int, _raw string, _shift string, _end string, _low string, _high string"
    ).select("_order", "_raw", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("_shift", "_end", "_low", "_high")])
    lines = spark.read.text([f"{folder}/{e['path']}" for e in entries]).select("value", F.expr("parse_url(_metadata.file_path, 'PATH')").alias("_raw"), F.monotonically_increasing_id().alias("_line"))
    lines = lines.join(F.broadcast(manifest), "_raw").withColumnRenamed("_order", "_path")  # a row an entry
    heads = _heads(lines, timestamp_column, sep)
    bare = manifest.join(heads, F.col("_order") == F.col("_path"), "left_anti").select("_raw").limit(5).collect()
    if bare:
        raise ValueError(f"no {timestamp_column} column in {[r[0] for r in bare]}")

    def repaired(rows: DataFrame) -> DataFrame:
        moved = rows.withColumn("ts", F.when(F.col("ts") <= F.col("_shift"), F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")))
        kept = (F.col("ts") < F.col("_end"), F.col("ts") >= F.col("_low"), F.col("ts") < F.col("_high"))
        return moved.where(reduce(lambda a, b: a & b, [F.coalesce(k, F.lit(True)) for k in kept]))

    return _merged(lines, heads, sep, timestamp_column, drop, sentinel, text_columns, repaired, ("_shift", "_end", "_low", "_high"))


def scan_directory(spark: SparkSession, folder: str, pattern: str = "*.dat", *, sep: str = ",", timestamp_column: str = STAMP, drop: Sequence[str] = ("RECORD",), sentinel: float | None = -900.0, text_columns: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """All logger files of a folder as one record: of each stamp, column by column, the first value in name order of the files.

    ``keys``: columns, kept as text, that tell stations of one folder apart; a stamp is then one row for each of them. All files have them.

    One scan, whatever the number of files. The line with the stamp's name is a file's header; files with the same header are parsed
    together, so the plan grows with the number of different headers alone. The other header lines have no stamp and go.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(folder).select("value", F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_line"))
    heads = _heads(lines, timestamp_column, sep)
    if heads.isEmpty():
        raise ValueError(f"no {pattern} with a {timestamp_column} column in {folder}")
    return _merged(lines, heads, sep, timestamp_column, drop, sentinel, text_columns, keys=keys)


def _heads(lines: DataFrame, timestamp_column: str, sep: str) -> DataFrame:
    """(_path, _head): the header line of each file."""
    token = rf"(^|{re.escape(sep)})\"?{re.escape(timestamp_column)}\"?({re.escape(sep)}|\r?$)"
    return lines.where(F.col("value").rlike(token)).groupBy("_path").agg(F.min_by("value", "_line").alias("_head"))


def _merged(lines: DataFrame, heads: DataFrame, sep: str, timestamp_column: str, drop: Sequence[str], sentinel: float | None, text_columns: Sequence[str], repaired=lambda rows: rows, beside: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """The record of all files: ``_path`` orders them, ``_line`` the rows of a file; ``beside``: columns that ``repaired`` reads; ``keys``: what
    identifies a row together with the stamp."""
    variants = sorted(r[0] for r in heads.select("_head").distinct().collect())  # loggers have a handful
    tagged, rows = lines.join(heads, "_path"), None
    for head in variants:
        names = _split_csv(head, sep)
        if len(set(names)) != len(names):
            raise ValueError(f"a file names a column twice: {head}")
        if not set(keys) <= set(names):
            raise ValueError(f"a file lacks one of the keys {list(keys)}: {head}")
        parsed = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": sep, "quote": '"'})
        kept = [n for n in names if n in keys or (n != timestamp_column and n not in drop)]
        one = tagged.where(F.col("_head") == head).select("_path", "_line", *beside, parsed.alias("_row"))
        field = lambda n: F.col("_row").getField(n)
        one = one.select(F.try_to_timestamp(field(timestamp_column)).cast("timestamp_ntz").alias("ts"), "_path", "_line", *beside, *[(field(n) if n in text_columns or n in keys else number(field(n), sentinel)).alias(n) for n in kept])
        one = repaired(one.where("ts IS NOT NULL")).drop(*beside)
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    values = [c for c in rows.columns if c not in ("ts", "_path", "_line", *keys)]
    once = rows.groupBy("_path", "ts", *keys).agg(F.min_by(F.struct(*values), "_line").alias("_row"))
    return once.groupBy("ts", *keys).agg(*[F.min_by(F.col("_row").getField(c), F.when(F.col("_row").getField(c).isNotNull(), F.col("_path"))).alias(c) for c in values])


PARTS = ("year", "month", "day", "hour", "minute")


def stamp_from_parts(df: DataFrame) -> Column:
    lower = {c.lower(): c for c in df.columns}
    part = lambda n, other: F.col(lower[n]).try_cast("int") if n in lower else F.lit(other)
    return F.make_timestamp_ntz(part("year", 1970), part("month", 1), part("day", 1), part("hour", 0), part("minute", 0), F.lit(0))


def read_timeseries_csv(spark: SparkSession, path: str, sep: str = ",", timestamp_columns: Sequence[str] | None = None) -> DataFrame:
    """Stamp from its parts (year, month, day at least), from a TIMESTAMP column, or from the first column; the rest as numbers."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    lower = {c.lower(): c for c in raw.columns}
    used = [lower[p] for p in PARTS if p in lower]
    if timestamp_columns:
        used = list(timestamp_columns)
        ts = F.try_to_timestamp(F.concat_ws(" ", *used)).cast("timestamp_ntz")
    elif len(used) >= 3:
        ts = stamp_from_parts(raw)
    else:
        used = [lower.get("timestamp", raw.columns[0])]
        ts = F.try_to_timestamp(F.col(f"`{used[0]}`")).cast("timestamp_ntz")
    return raw.select(ts.alias("ts"), *[number(F.col(f"`{c}`")).alias(c) for c in raw.columns if c not in used]).where("ts IS NOT NULL")


def load_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, types: Mapping[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """CSV or Parquet by suffix, with projection, casts and a head."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).option("inferSchema", not types).csv(path)
    if columns is not None:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    df = df.withColumns({c: F.col(c).try_cast(t) for c, t in (types or {}).items()})
    return df if limit is None else df.limit(limit)


def read_model_record(spark: SparkSession, path: str, renames: Mapping[str, str] | None = None, spin_up_hour: int | None = 21) -> DataFrame:
    """The operational point record: unnamed columns go, old names change, the last row of a stamp stays, the spin-up hour goes."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    raw = raw.drop(*[c for c in raw.columns if c.startswith("_c") or not c.strip()])
    raw, _ = rename_version(raw, renames or {})
    rows = raw.select(stamp_from_parts(raw).alias("ts"), F.monotonically_increasing_id().alias("_line"), *[number(F.col(f"`{c}`")).alias(c) for c in raw.columns if c.lower() not in PARTS]).where("ts IS NOT NULL")
    last = F.row_number().over(Window.partitionBy("ts").orderBy(F.desc("_line")))
    out = rows.withColumn("_k", last).where("_k = 1").drop("_k", "_line")
    return out if spin_up_hour is None else out.where(F.hour("ts") != spin_up_hour)


def rename_version(df: DataFrame, renames: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """Old spellings renamed where they occur, and which they were."""
    found = [c for c in df.columns if c in renames]
    return df.withColumnsRenamed({c: renames[c] for c in found}), found


def migrate_record(df: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Repairs of the first schema: ALBD and EMISS were stored less 273.15 and what follows from them is recomputed.

    Physics columns are null where the downwelling longwave is 0. A row whose stored upwelling longwave doesn't fit the old
    formula within the tolerance fails the job.
    """
    sigma, t = 5.670374419e-08, F.col("T") + 273.15
    emiss, down = F.col("EMISS") + 273.15, F.col("Lwdw_glw")
    old = F.col("EMISS") * sigma * F.pow(t, 4.0)
    lw = emiss * sigma * F.pow(t, 4.0) + (1 - emiss) * down
    wrong = F.abs(F.col("Lwup_calc") - old) > tolerance * F.greatest(F.abs(old), F.lit(1.0))
    checked = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.concat(F.lit("inconsistent longwave at "), F.col("ts").cast("string"))).cast("double")).otherwise(lw)
    vapor = F.col("q") * F.col("p") / (F.lit(0.622) + F.col("q"))
    new = {"ALBD": F.col("ALBD") + 273.15, "EMISS": emiss, "Swup_calc": F.col("Swup_calc") + 273.15 * F.col("Swdw"), "Lwup_calc": checked, "e": vapor, "ur": F.lit(100.0) * vapor / (saturation_vapor_pressure(F.col("T")) / 100.0)}
    warm = down != 0
    return df.withColumns({c: F.when(warm, v) for c, v in new.items() if c in df.columns})


def read_station_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, lat, lon) from ``name,lat,lon`` or ``name:lat:lon`` lines; comments and a header are skipped, bad rows fail the job."""
    parts = F.split(F.trim("value"), r"[,:]")
    rows = spark.read.text(path).where(~F.trim("value").rlike(r"^(#|$)")).select(F.trim(parts[0]).alias("name"), parts[1].try_cast("double").alias("lat"), parts[2].try_cast("double").alias("lon"))
    rows = rows.where(~((F.lower("name") == "name") & F.col("lat").isNull()))
    ok = F.col("name").rlike(r"^[A-Za-z0-9_\-]+$") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    twice = F.count("*").over(Window.partitionBy("name")) > 1
    bad = F.when(~F.coalesce(ok, F.lit(False)) | twice, F.raise_error(F.concat(F.lit("bad station: "), F.coalesce("name", F.lit("?"))))).otherwise(F.col("name"))
    return rows.withColumn("_bad", bad.cast("string")).select(F.col("_bad").alias("name"), "lat", "lon")


def read_geometry_factors(spark: SparkSession, path: str, column: str = "fc") -> DataFrame:
    """(ts, fc) of the shade-ring table; of Parquet only the wanted column is read."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("ts", F.col(column).alias("fc"))
    raw = spark.read.option("header", True).csv(path)
    return raw.select(stamp_from_parts(raw).alias("ts"), number(F.col(column)).alias("fc"))


def convert_geometry(spark: SparkSession, source: str, target: str) -> None:
    raw = spark.read.option("header", True).csv(source)
    values = [c for c in raw.columns if c.lower() not in PARTS]
    raw.select(stamp_from_parts(raw).alias("ts"), *[number(F.col(c)).alias(c) for c in values]).write.option("compression", "zstd").mode("overwrite").parquet(target)


def scan_grid(spark: SparkSession, path: str, domain: str | None = None, steps: tuple[int, int] | None = None, fields: Sequence[str] | None = None, utc_offset_hours: float = -3.0) -> DataFrame:
    """Rows of a gridded run partitioned by domain and step; both filters prune partitions, fields prune columns.

    ``steps``: from the first to before the second; the second may lie beyond the run, an empty or negative block is an error.
    """
    if steps is not None and not 0 <= steps[0] < steps[1]:
        raise ValueError(f"no block of steps {steps}")
    df = spark.read.parquet(path)
    if domain is not None:
        df = df.where(F.col("domain") == domain)
    if steps is not None:
        df = df.where((F.col("step") >= steps[0]) & (F.col("step") < steps[1]))
    local = F.col("valid_time") + F.expr(f"INTERVAL {int(utc_offset_hours * 60)} MINUTES")
    names = ["domain", "step", "valid_time", "y", "x"]
    return df.select(*names, local.alias("local_time"), *(fields if fields is not None else [c for c in df.columns if c not in names]))


def has_field(df: DataFrame, name: str) -> bool:
    return name in df.columns


def one_run_per_domain(df: DataFrame, run: str = "run") -> DataFrame:
    """``df``, or an error where a domain's rows come from more than one run; a small aggregate is looked at first."""
    mixed = df.groupBy("domain").agg(F.count_distinct(run).alias("n")).where("n > 1").limit(1).collect()
    if mixed:
        raise ValueError(f"domain {mixed[0].domain} comes from {mixed[0].n} runs")
    return df


def grid_times(df: DataFrame, text: str = "times") -> DataFrame:
    return df.withColumn("valid_time", F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd_HH:mm:ss")))


#: Weekdays of captions, from Monday on.
WEEKDAYS = ("Segunda", "Terça", "Quarta", "Quinta", "Sexta", "Sábado", "Domingo")


def run_day(text: str) -> str:
    """The day of a run as yyyyMMdd, from digits with or without ``-`` or ``/`` between them; an hour may follow. Anything else is an error."""
    digits = text.replace("-", "").replace("/", "")
    if not re.fullmatch(r"[0-9]{8,}", digits):
        raise ValueError(f"a run is named by its day, yyyyMMdd, not by {text!r}")
    return digits[:8]


def run_steps(df: DataFrame, skip_first: int = 0, utc_offset_hours: float = -3.0, time: str = "valid_time") -> DataFrame:
    """(domain, step, time, local_time, name_suffix, caption, skip): a row a step of each domain of a gridded run.

    The first ``skip_first`` steps of a domain are marked, not left out, so that steps keep their places. The caption names the domain's first
    time and the step's local hour and weekday. A step with two times fails the job; one without any has null times. Cells combine on
    the map side; what is ordered afterwards is a row a step.
    """
    t, domain = F.col(time), Window.partitionBy("domain")
    steps = df.groupBy("domain", "step").agg(F.min(time).alias(time), F.max(time).alias("_last"))
    name = F.concat(F.col("domain").cast("string"), F.lit(" "), F.col("step").cast("string"))
    mixed = F.when(t != F.col("_last"), F.raise_error(F.concat(F.lit("a step with several times: "), name)).cast("boolean"))
    local = t + F.expr(f"INTERVAL {int(utc_offset_hours * 60)} MINUTES")
    day = F.get(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(local))
    # a step that was checked has no flag, so the filter keeps it
    steps = steps.where(mixed.isNull()).withColumns({"_start": F.min_by(time, "step").over(domain), "_place": F.row_number().over(domain.orderBy("step"))})
    caption = F.concat(F.lit("Início Análise: "), F.date_format("_start", "dd/MM/yyyy HH"), F.lit(" (UTC)\nPrevisão: "), F.date_format(local, "dd/MM/yyyy HH"), F.lit("HL ("), day, F.lit(")"))
    suffix = F.concat(F.col("domain").cast("string"), F.lit("_"), F.lpad(F.col("step").cast("string"), 3, "0"))
    return steps.select("domain", "step", time, local.alias("local_time"), suffix.alias("name_suffix"), caption.alias("caption"), (F.col("_place") <= skip_first).alias("skip"))


def load_rules(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Rule tables of a YAML file, each with a strict schema; a missing file gives a warning and empty ones. The file may lie in any store that Spark reads."""
    schemas = {
        "ranges": "column string, lower double, upper double", "steps": "column string, threshold double, return_tol double, max_len int", "persistence": "column string, min_run int",
        "calibrations": "column string, start string, end string, factor double", "switches": "unified string, column string, start string, end string",
    }
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        data = yaml.safe_load("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())) or {}
    else:
        warnings.warn(f"no rules at {path}; nothing is gated, calibrated or switched", stacklevel=2)
        data = {}
    unknown = set(data) - set(schemas)
    if unknown:
        raise ValueError(f"unknown rule tables {sorted(unknown)}")
    out = {}
    for name, ddl in schemas.items():
        fields = [f.split()[0] for f in ddl.split(", ")]
        kinds = [f.split()[1] for f in ddl.split(", ")]
        cast = {"string": str, "double": float, "int": int}
        rows = [tuple(None if r.get(f) is None else cast[k](r[f]) for f, k in zip(fields, kinds)) for r in data.get(name, [])]
        out[name] = spark.createDataFrame(rows, ddl)
    return out


def scan_frames(spark: SparkSession, folder: str, minutes_per_frame: float, start_hour: int = 0, pattern: str = "*.png", day: str = r"(\d{8})", number_: str = r"(\d+)\.\w+$") -> DataFrame:
    """(frame_path, video, index, timestamp): stamps from the day and the number of the frame, which ``day`` and ``number_`` find in the path below ``folder``.

    Only names are listed, no frame is read. Paths without a day are left out; without a number, or with a day that does not exist, the stamp is null.
    """
    paths = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path")
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    below = F.when(F.startswith("path", F.lit(root)), F.substring("path", len(root) + 1, 1 << 20)).otherwise(F.col("path"))
    found = paths.select(F.col("path").alias("frame_path"), F.regexp_extract(below, day, 1).alias("video"), F.regexp_extract(below, number_, 1).try_cast("bigint").alias("index"))
    start = F.try_to_timestamp("video", F.lit("yyyyMMdd")).cast("timestamp_ntz")
    at = F.timestamp_micros((F.unix_micros(start.cast("timestamp")) + start_hour * 3_600_000_000 + F.col("index") * int(minutes_per_frame * 60_000_000)).cast("long")).cast("timestamp_ntz")
    return found.where("video <> ''").withColumn("timestamp", at)


def parse_timestamp_strict(c: Column, fmt: str) -> Column:
    """A naive stamp in exactly that format; anything else fails the job."""
    return F.to_timestamp_ntz(c, F.lit(fmt))


def read_embeddings(spark: SparkSession, path: str, key: str = "sample_id", wanted: DataFrame | None = None) -> DataFrame:
    """(key, embedding); with ``wanted`` only its ids."""
    df = spark.read.parquet(path).select(key, "embedding")
    return df if wanted is None else df.join(wanted.select(key).distinct(), key)
