"""Sinks: tables, reports and JSON payloads. Every write is one Spark job over distributed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.atmosphere import finite, flow_bearing
from ..operators.stats import content_hash
from . import commits

DECIMALS = {"C": 1, "K": 1, "hPa": 1, "%": 0, "m/s": 1, "deg": 0, "W/m2": 0, "mm": 1}
MISSING_INT = -(2**31)


def round_for_publication(c: Column, unit: str | None = None, digits: int | None = None) -> Column:
    """Half-even rounding by unit; what isn't finite is null."""
    n = digits if digits is not None else DECIMALS.get(unit or "", 2)
    return F.bround(finite(c), n)


def export_csv(df: DataFrame, path: str, ts: str = "ts", sep: str = ",", na: str = "nan", decimals: int = 3, parts: bool = True) -> None:
    """Stamp as year, month, day, hour (a null or sub-hourly stamp fails the job), values with fixed decimals."""
    values = [c for c in df.columns if c != ts]
    off = F.col(ts).isNull() | (F.date_trunc("hour", ts).cast("timestamp_ntz") != F.col(ts))
    stamp = F.when(off, F.raise_error(F.lit("stamps must be whole hours")).cast("timestamp_ntz")).otherwise(F.col(ts))
    head = [fn(stamp).alias(n) for n, fn in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour))] if parts else [F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts)]
    text = lambda c: F.when(finite(F.col(c)).isNull(), F.lit(na)).otherwise(F.format_string(f"%.{decimals}f", F.col(c).cast("double")))
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long")}
    df.select(*head, *[(text(c) if c in numeric else F.col(c)).alias(c) for c in values]).write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def write_archive_tables(tables: Mapping[str, DataFrame], folder: str, ts: str = "ts") -> None:
    """One Parquet table a stage, by year."""
    for name, df in tables.items():
        df.withColumn("year", F.year(ts)).write.mode("overwrite").partitionBy("year").option("compression", "zstd").parquet(f"{folder}/{name}")


def archive_report(changes: DataFrame, facts: DataFrame) -> DataFrame:
    """One JSON text: ``changes`` (stage, column, removed) nested by stage, beside the one row of ``facts``."""
    stages = changes.groupBy("stage").agg(F.sort_array(F.collect_list(F.struct("column", "removed"))).alias("columns"))
    sorted_ = F.sort_array(F.collect_list(F.struct("stage", "columns")))
    nested = F.map_from_entries(F.transform(sorted_, lambda s: F.struct(s["stage"], F.map_from_entries(s["columns"]))))
    return stages.agg(nested.alias("removed")).crossJoin(facts).select(F.to_json(F.struct("removed", *facts.columns)).alias("value"))


def monitoring_payload(df: DataFrame, values: Mapping[str, str], freq: str, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """(keys, value): JSON with a regular axis (start, step, count) and one rounded nullable array a channel. ``values``: name -> unit."""
    span = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi")).where("_lo IS NOT NULL")
    grid = span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {freq}"))).alias(ts))
    rows = grid.join(df, [*keys, ts], "left")
    series = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), *[round_for_publication(F.col(c), u).alias(c) for c, u in values.items()])))
    got = rows.groupBy(*keys).agg(series.alias("s"))
    field = lambda name: lambda r: r[name]
    arrays = F.struct(*[F.transform("s", field(c)).alias(c) for c in values])
    axis = F.struct(F.get("s", F.lit(0))["t"].alias("start"), F.lit(freq).alias("step"), F.size("s").alias("count"))
    return got.select(*keys, F.to_json(F.struct(axis.alias("axis"), arrays.alias("series")), {"ignoreNullFields": "false"}).alias("value"))


def climatology_payload(histograms: DataFrame, shapes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, value): edges, counts and density of each group beside its statistics, as JSON."""
    bars = histograms.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "low", "high", "n", "density"))).alias("bars"))
    edges = F.concat(F.transform("bars", lambda b: b["low"]), F.array(F.element_at("bars", -1)["high"]))
    facts = F.struct(*[c for c in shapes.columns if c not in by])
    joined = bars.join(shapes, list(by)) if by else bars.crossJoin(shapes)
    doc = F.struct(edges.alias("edges"), F.transform("bars", lambda b: b["n"]).alias("counts"), F.transform("bars", lambda b: b["density"]).alias("density"), facts.alias("stats"))
    return joined.select(*by, F.to_json(doc).alias("value"))


def density_payload(cells: DataFrame, rows: int, columns: int) -> DataFrame:
    """One JSON text with the dense matrix of (i, j, n) cells and its largest count."""
    one = cells.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(",", "i", "j").alias("k"), "n"))).alias("m"), F.max("n").alias("top"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: F.coalesce(F.try_element_at("m", F.concat_ws(",", i, j)), F.lit(0))))
    return one.select(F.to_json(F.struct(grid.alias("counts"), F.coalesce("top", F.lit(0)).alias("max_count"))).alias("value"))


def cell_series(df: DataFrame, value: str, by: Sequence[str] = ("domain",)) -> DataFrame:
    """(by, y, x, series): integers of value times 100 in step order, a marker where missing; an overflow fails the job."""
    scaled = F.bround(finite(F.col(value)) * 100, 0)
    too_big = F.abs(scaled) >= 2**31
    cell = F.when(scaled.isNull(), F.lit(MISSING_INT)).when(too_big, F.raise_error(F.lit("value too large for the scaled matrix")).cast("int")).otherwise(scaled.cast("int"))
    got = df.groupBy(*by, "y", "x").agg(F.array_sort(F.collect_list(F.struct("step", cell.alias("v")))).alias("s"))
    return got.select(*by, "y", "x", F.transform("s", lambda r: r["v"]).alias("series"))


def step_summary(df: DataFrame, value: str, by: Sequence[str] = ("domain", "step")) -> DataFrame:
    v = finite(F.col(value))
    return df.groupBy(*by).agg(F.bround(F.avg(v), 2).alias("mean"), F.bround(F.min(v), 2).alias("min"), F.bround(F.max(v), 2).alias("max"), F.count(v).alias("n"))


def step_values(df: DataFrame, value: str, bounds: DataFrame, by: Sequence[str] = ("domain",)) -> DataFrame:
    """(by, step, values, scale): row-major values of each step and six points of its scale; bounds that aren't finite fail the job."""
    got = df.groupBy(*by, "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", F.bround(finite(F.col(value)), 2).alias("v")))), lambda r: r["v"]).alias("values"))
    low, high = finite(F.col("scale_min")), finite(F.col("scale_max"))
    bad = low.isNull() | high.isNull()
    scale = F.when(bad, F.raise_error(F.lit("scale bounds are not finite")).cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: low + (high - low) * k / 5))
    return got.join(bounds, list(by)).select(*by, "step", "values", scale.alias("scale"))


def availability(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, first, last): published steps as runs of consecutive numbers."""
    w = Window.partitionBy(*by).orderBy("step")
    runs = steps.select(*by, "step").distinct().withColumn("_run", F.col("step") - F.row_number().over(w))
    return runs.groupBy(*by, "_run").agg(F.min("step").alias("first"), F.max("step").alias("last")).drop("_run")


def common_range(steps: DataFrame, over: str) -> DataFrame:
    """(first, last) of the steps that every value of ``over`` has."""
    n = steps.select(over).distinct().count()
    return steps.groupBy("step").agg(F.count_distinct(over).alias("n")).where(F.col("n") == n).agg(F.min("step").alias("first"), F.max("step").alias("last"))


def variable_ranges(steps: DataFrame, requested: Sequence[str] = ()) -> DataFrame:
    """(variable, first, last) of what every domain published of a variable; ``steps``: domain, variable, step (null: tried, none written).

    Counted are the steps from the latest first to the earliest last step of the domains. A variable that has them all is left out, one
    that has none, a requested one that wrote nothing included, has a row of nulls, so that no one takes an old file for a new one.
    """
    known = steps.where("step IS NOT NULL").select("domain", "variable", "step").distinct()
    ends = known.groupBy("domain").agg(F.min("step").alias("lo"), F.max("step").alias("hi")).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    tried = steps.select("domain", "variable").distinct().groupBy("variable").agg(F.count("*").alias("domains"))
    shared = known.groupBy("variable", "step").agg(F.count("*").alias("have")).join(tried, "variable").where("have = domains").crossJoin(F.broadcast(ends)).where("step BETWEEN lo AND hi")
    whole = shared.groupBy("variable", "lo", "hi").agg(F.count("*").alias("n")).where("n = hi - lo + 1").select("variable")
    runs = availability(shared, ["variable"])
    names = tried.select("variable")
    if requested:
        names = names.union(steps.sparkSession.createDataFrame([(v,) for v in requested], "variable string")).distinct()
    return names.join(whole, "variable", "left_anti").join(runs, "variable", "left")


def run_is_clean(units: DataFrame) -> Column:
    """For an aggregate over ``units`` (error, missing, kind): whether no unit that writes matrices failed or lacked its variable."""
    bad = F.col("kind").isin("values", "heights") & (F.col("error").isNotNull() | F.coalesce(F.col("missing"), F.lit(False)))
    return F.count_if(bad) == 0


def vector_overlay(df: DataFrame, u: str, v: str, stride: int = 4, by: Sequence[str] = ("domain", "step"), width: int | None = None) -> DataFrame:
    """(by, vectors): bearing, magnitude and row-major index of every ``stride``-th cell; ``width``: cells a row, else that of the widest."""
    some = df.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0) & F.col(u).isNotNull() & F.col(v).isNotNull())
    if width is None:
        width = (df.agg(F.max("x")).first()[0] or 0) + 1
    index = F.col("y") * F.lit(width) + F.col("x")
    return some.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(index.alias("index"), F.bround(flow_bearing(F.col(u), F.col(v)), 1).alias("bearing"), F.bround(F.sqrt(F.col(u) ** 2 + F.col(v) ** 2), 2).alias("speed")))).alias("vectors"))


def grid_cells(cells: DataFrame, by: Sequence[str] = ("domain",)) -> DataFrame:
    """Cell bounds: midpoints between neighbours, half a cell beyond the edges; and whether each edge is shared by its row or column."""
    row, col = Window.partitionBy(*by, "y").orderBy("x"), Window.partitionBy(*by, "x").orderBy("y")

    def edges(c: str, w, before: str, after: str) -> dict[str, Column]:
        prev, nxt = F.lag(c).over(w), F.lead(c).over(w)
        low = F.coalesce((F.col(c) + prev) / 2, F.col(c) - (nxt - F.col(c)) / 2)
        high = F.coalesce((F.col(c) + nxt) / 2, F.col(c) + (F.col(c) - prev) / 2)
        return {before: low, after: high}

    out = cells.withColumns(edges("lon", row, "west", "east") | edges("lat", col, "south", "north"))
    flat = lambda c, axis: F.min(c).over(Window.partitionBy(*by, axis)) == F.max(c).over(Window.partitionBy(*by, axis))
    return out.withColumn("separable", flat("west", "x") & flat("east", "x") & flat("south", "y") & flat("north", "y"))


def absent_rows(new: DataFrame, old: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows of ``new``, one a key, whose keys (a station and a stamp) ``old`` lacks; of ``old`` only the span of the new stamps is read."""
    once = new.dropDuplicates(list(keys))
    if ts not in keys:
        return once.join(old.select(*keys), list(keys), "left_anti")
    low, high = new.agg(F.min(ts), F.max(ts)).first()
    if low is None:
        return once
    return once.join(old.where(F.col(ts).between(F.lit(low), F.lit(high))).select(*keys), list(keys), "left_anti")


def append_block(new: DataFrame, path: str, keys: Sequence[str] | None = None, ts: str = "ts", force: bool = False, batch: tuple[str, int] | None = None) -> bool:
    """Append the rows of the block whose ``keys`` (a station and a stamp) the table lacks; whether there were any.

    The block is appended as a whole or not at all, also where a job is lost or two writers meet (``commits``); ``batch`` (writer, number)
    is not appended again. Without ``keys`` the stamp alone is the key, as in the table of one station; a row that differs from another of
    its stamp is then an error. With ``force`` the block is appended as it is. Columns that the table lacks are refused, missing ones are null.
    """
    by = list(keys or (ts,))
    if not keys and not force and not new.groupBy(ts).agg(F.count_distinct(_whole_row(new)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("rows of one stamp differ: give the station as a key")

    def rows(old: DataFrame | None) -> DataFrame | None:
        if old is None:
            return new if force else new.dropDuplicates(by)
        extra = [c for c in new.columns if c not in old.columns]
        if extra:
            raise ValueError(f"the table has no columns {extra}; evolve its schema first")
        if not keys and not force:
            before = old.select(F.col(ts).alias("_ts"), _whole_row(old.select(*new.columns)).alias("_row"))
            if not new.join(before, F.col(ts) == F.col("_ts")).where(_whole_row(new) != F.col("_row")).isEmpty():
                raise ValueError("the table has another row of a stamp: give the station as a key")
        fresh = new if force else absent_rows(new, old, by, ts)
        fill = {f.name: F.lit(None).cast(f.dataType) for f in old.schema.fields if f.name not in new.columns}
        return fresh.withColumns(fill).select(*old.columns)

    return commits.append(new.sparkSession, path, rows, batch)


def _whole_row(df: DataFrame) -> Column:
    """A hash of all columns, named so that it stays apart from those of another frame."""
    return F.xxhash64(*[df[c] for c in sorted(df.columns)])


def evolve_schema(old: DataFrame, new: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Old rows and new ones under the old columns and the wanted further ones; a wanted name that nobody has is an error."""
    missing = [c for c in wanted if c not in old.columns and c not in new.columns]
    if missing:
        raise ValueError(f"no source has {missing}")
    columns = [*old.columns, *[c for c in wanted if c not in old.columns]]
    return old.unionByName(new.select(*[c for c in columns if c in new.columns]), allowMissingColumns=True).select(*columns)


def write_with_meta(df: DataFrame, path: str, order: Sequence[str], extra: Mapping[str, str] | None = None) -> None:
    """The table, and beside it one JSON row: row count, content hash, the order it is hashed in, and what else is given."""
    df.write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.parquet(path)
    facts = {"order": ",".join(order)} | dict(extra or {})
    content_hash(written, order).withColumns({k: F.lit(v) for k, v in facts.items()}).write.mode("overwrite").json(path.rstrip("/") + ".meta")


def stored_meta(spark, path: str) -> dict:
    """The meta row of a table as a dictionary; empty where there is none."""
    try:
        row = spark.read.json(path.rstrip("/") + ".meta").first()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return {}
    return row.asDict() if row else {}


def load_verified(spark, path: str, expected: str | None = None) -> DataFrame:
    """A table written with its meta row, after its content was hashed again; another content, or another id than ``expected``, is an error."""
    meta = stored_meta(spark, path)
    if not meta:
        raise ValueError(f"{path} has no meta row")
    df = spark.read.parquet(path)
    found = content_hash(df, meta["order"].split(",")).first().hash
    if found != meta["hash"] or expected not in (None, found):
        raise ValueError(f"{path} holds {found}, not {expected or meta['hash']}")
    return df


def save_guarded(df: DataFrame, path: str, order: Sequence[str], force: bool = False) -> bool:
    """Write; equal content is left alone, other content is an error unless forced."""
    old = stored_meta(df.sparkSession, path).get("hash")
    new = content_hash(df, order).first().hash
    if old == new:
        return False
    if old is not None and not force:
        raise ValueError(f"{path} holds another version")
    write_with_meta(df, path, order)
    return True


def rebuild_if_changed(inputs: Mapping[str, tuple[DataFrame, Sequence[str]]], path: str, build) -> bool:
    """Run ``build()`` and write its table only if the inputs' hashes differ from those it was last built from."""
    import hashlib

    digest = hashlib.sha256("".join(f"{n}={content_hash(df, order).first().hash};" for n, (df, order) in sorted(inputs.items())).encode()).hexdigest()
    spark = next(iter(inputs.values()))[0].sparkSession
    if stored_meta(spark, path).get("inputs") == digest:
        return False
    table, order = build()
    write_with_meta(table, path, order, {"inputs": digest})
    return True


def compare_experiments(spark, paths: Sequence[str]) -> DataFrame:
    """One row an experiment's metrics document, flattened one level."""
    out = None
    for p in paths:
        doc = spark.read.option("multiLine", True).json(p)
        flat = []
        for f in doc.schema.fields:
            flat += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType.fields] if f.dataType.typeName() == "struct" else [F.col(f"`{f.name}`")]
        row = doc.select(F.lit(p).alias("source"), *flat)
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out
