"""Registered queries, continued: manifests of logger files, station publication, experiments side by side, guarded tables, series in ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, quality, segments, windows
from ..sources import publish, records
from ..sources.scratch import scratch_path
from . import pipelines
from .catalogue import r6, register, table


def logger_lines(spark: SparkSession, sf_dir: str, name) -> DataFrame:
    """(file, part, k, value): events as lines of logger files, one for each value of the column ``name``; part 0 is a file's header."""
    e = table(spark, sf_dir, "events").withColumn("file", name)
    line = F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit('",'), F.col("event_id").cast("string"), F.lit(","), F.col("value").cast("string"), F.lit(","), F.when(F.col("event_type") == "view", F.lit('"NAN"')).otherwise((F.col("value") * 2).cast("string")))
    rows = e.select("file", F.lit(1).alias("part"), F.col("event_id").alias("k"), line.alias("value"))
    heads = ['"TOA5","CR1000"', '"TIMESTAMP","RECORD","T","U"', '"TS","RN","C","C"', '"","","Avg","Avg"']
    tops = rows.select("file").distinct().select("file", F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), F.array_join(F.array(*[F.lit(h) for h in heads]), "\n").alias("value"))
    return rows.unionByName(tops)


def logger_files(spark: SparkSession, sf_dir: str, folder: str, name) -> None:
    """``logger_lines`` in sub-folders ``file=...``, one file each."""
    files = logger_lines(spark, sf_dir, name).repartition("file").sortWithinPartitions("file", "part", "k")
    files.select("file", "value").write.partitionBy("file").text(folder)


def paths_below(spark: SparkSession, folder: str) -> list[str]:
    """The files of ``logger_files``, relative to the folder, in the order of their sub-folders."""
    found = [r[0] for r in spark.read.text(folder).select("_metadata.file_path").distinct().collect()]
    return sorted(p[p.index("/file=") + 1 :] for p in found)


_REPAIRED = """WITH e AS (SELECT event_id, ts, value, event_type, user_id % 3 AS f FROM events),
    r AS (SELECT f, event_id, CASE WHEN f = 0 AND ts <= TIMESTAMP '2024-01-05' THEN ts + INTERVAL 1 HOUR ELSE ts END AS ts, value, CASE WHEN event_type <> 'view' THEN value * 2 END AS u FROM e),
    k AS (SELECT * FROM r WHERE (f <> 1 OR ts < TIMESTAMP '2024-01-20') AND (f <> 2 OR (ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25'))),
    o AS (SELECT f, ts, arg_min(struct_pack(t := value, u := u), event_id) AS row FROM k GROUP BY f, ts)
    SELECT ts, arg_min(row.t, f) FILTER (row.t IS NOT NULL) AS "T", arg_min(row.u, f) FILTER (row.u IS NOT NULL) AS "U" FROM o GROUP BY ts"""


@register(_REPAIRED)
def manifest_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logger files named by a manifest, each with its repair, in one scan."""
    folder = scratch_path(spark, "manifest")
    logger_files(spark, sf_dir, folder, (F.col("user_id") % 3).cast("string"))
    repairs = [records.Repair(shift_until="2024-01-05"), records.Repair(drop_from="2024-01-20"), records.Repair(keep=("2024-01-03", "2024-01-25"))]
    return records.scan_manifest(spark, [{"path": p, "repair": r} for p, r in zip(paths_below(spark, folder), repairs)], folder)


@register("""SELECT ts, value AS "T", CASE WHEN event_type <> 'view' THEN value * 2 END AS "U" FROM events QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id) = 1""")
def one_logger_file_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logger file of all events, in parts that are ranges of it, so that no task writes or sorts it whole."""
    folder = scratch_path(spark, "one-logger")
    logger_lines(spark, sf_dir, F.lit("all")).orderBy("part", "k").select("value").write.text(folder)
    return records.read_toa5(spark, folder)


#: Grids of three domains, of 9, 3 and 1 degrees a cell, and the stations of customer on them.
_DOMAINS = [("D01", 9.0, 0.0, 90.0, 0.0, 90.0), ("D02", 3.0, 15.0, 60.0, 15.0, 60.0), ("D03", 1.0, 30.0, 40.0, 30.0, 40.0)]
_FIELDS = "domain string, dx double, south double, north double, west double, east double"

_PUBLISHED = f"""WITH d({_FIELDS.replace(' string', '').replace(' double', '')}) AS (VALUES {', '.join(map(str, _DOMAINS))}),
    p AS (SELECT c_custkey AS name, ((c_custkey * 37) % 900) / 10.0 AS lat, ((c_custkey * 53) % 900) / 10.0 AS lon FROM customer),
    a AS (SELECT p.*, domain, dx, south, west FROM p JOIN d ON lat BETWEEN south AND north AND lon BETWEEN west AND east QUALIFY row_number() OVER (PARTITION BY name ORDER BY dx, domain) = 1),
    c AS (SELECT domain, y, x, south + y * dx AS clat, west + x * dx AS clon FROM d, (SELECT unnest(range(0, 46)) AS y), (SELECT unnest(range(0, 46)) AS x) WHERE y * dx <= north - south AND x * dx <= east - west),
    n AS (SELECT name, a.domain, y, x FROM a JOIN c ON a.domain = c.domain QUALIFY row_number() OVER (PARTITION BY name ORDER BY sqrt(pow(clat - lat, 2) + pow(clon - lon, 2)), y, x) = 1),
    f AS (SELECT domain, y, x, v.day::TIMESTAMP AS ts, 280 + v.m / 20 + y - x AS t2 FROM c, (SELECT date_trunc('day', ts) AS day, avg(value) AS m FROM events GROUP BY 1) v)
    SELECT name, ts, round(t2 - 273.15, 6) AS t2_c FROM n JOIN f USING (domain, y, x)"""


@register(_PUBLISHED)
def station_series_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations on nested grids: finest domain, nearest cell, the record's column there, appended in two overlapping blocks of days."""
    k = F.col("c_custkey")
    stations = table(spark, sf_dir, "customer").select(k.alias("name"), ((k * 37 % 900) / 10.0).alias("lat"), ((k * 53 % 900) / 10.0).alias("lon"))
    domains = spark.createDataFrame(_DOMAINS, _FIELDS)
    steps = lambda low, high: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(high) - F.col(low)) / F.col("dx"))))
    cells = domains.withColumn("y", steps("south", "north")).withColumn("x", steps("west", "east"))
    cells = cells.select("domain", "y", "x", (F.col("south") + F.col("y") * F.col("dx")).alias("lat"), (F.col("west") + F.col("x") * F.col("dx")).alias("lon"))
    days = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("valid_time")).agg(F.avg("value").alias("m"))
    fields = cells.crossJoin(F.broadcast(days)).select("domain", "y", "x", "valid_time", (280 + F.col("m") / 20 + F.col("y") - F.col("x")).alias("T2"))  # a row a day
    path = scratch_path(spark, "published")
    for block in (fields.where("day(valid_time) <= 20"), fields.where("day(valid_time) > 10"), fields):
        pipelines.publish_station_series(block, stations, domains, cells, path, ["t2_c"])
    return spark.read.parquet(path).select("name", "ts", r6("t2_c").alias("t2_c"))


@register("""SELECT l_returnflag AS experiment, round(avg(l_quantity), 6) AS metrics_mean, max(l_quantity) AS metrics_most, count(*) AS rows FROM lineitem GROUP BY ALL""")
def experiments_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metrics document for each return flag, written as JSON and read side by side."""
    folder = scratch_path(spark, "experiments")
    scores = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("experiment")).agg(F.avg("l_quantity").alias("mean"), F.max("l_quantity").alias("most"), F.count("*").alias("rows"))
    scores.select("experiment", F.col("experiment").alias("e"), F.struct("mean", "most").alias("metrics"), "rows").write.partitionBy("e").json(folder)
    found = publish.compare_experiments(spark, [f"{folder}/e={k}" for k in ("A", "N", "R")])
    return found.select("experiment", r6("metrics_mean").alias("metrics_mean"), "metrics_most", "rows")


@register("""SELECT user_id, count(*) AS n, true AS written, false AS again, true AS refused FROM events GROUP BY user_id""")
def split_saved_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written once, left alone when it comes again, and kept from other content."""
    path = scratch_path(spark, "split")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    written, again = publish.save_guarded(rows, path, ["user_id"]), publish.save_guarded(rows.repartition(3), path, ["user_id"])
    try:
        publish.save_guarded(rows.withColumn("n", F.col("n") + 1), path, ["user_id"])
        refused = False
    except ValueError:
        refused = True
    return publish.load_verified(spark, path).select("user_id", "n", F.lit(written).alias("written"), F.lit(again).alias("again"), F.lit(refused).alias("refused"))


@register("""WITH e AS (SELECT event_id, ts, CASE WHEN event_type = 'view' THEN value END AS v FROM events),
    w AS (SELECT event_id, ts, v, last_value(v IGNORE NULLS) OVER a AS b, last_value(CASE WHEN v IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER a AS bt,
          last_value(v IGNORE NULLS) OVER z AS n, last_value(CASE WHEN v IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER z AS nt
          FROM e WINDOW a AS (ORDER BY ts, event_id), z AS (ORDER BY ts DESC, event_id DESC))
    SELECT event_id, round(coalesce(v, b + (n - b) * (epoch_us(ts) - bt) / nullif(nt - bt, 0)), 6) AS line, b AS filled FROM w""")
def one_series_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series without a station: gaps filled in ranges of time."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_type") == "view", F.col("value")).alias("v"))
    both = windows.ffill(e.withColumn("filled", F.col("v")), ["filled"], sliced=2048)
    return windows.interpolate_time(both.withColumn("line", F.col("v")), "line", sliced=2048).select("event_id", r6("line").alias("line"), "filled")


@register("""WITH s AS (SELECT event_id, value, ts, CASE WHEN floor(value / 50) = lag(floor(value / 50)) OVER (ORDER BY ts, event_id) THEN 0 ELSE 1 END AS b FROM (SELECT event_id, value, TIMESTAMP '2020-01-01' + row_number() OVER (ORDER BY event_id) * INTERVAL 5 MINUTE AS ts FROM events)),
    r AS (SELECT *, sum(b) OVER (ORDER BY ts) AS run FROM s) SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY run) <= 2 THEN floor(value / 50) END AS v FROM r""")
def one_series_stuck_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series on a five-minute grid: stuck values masked in ranges of time."""
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") / 50).cast("double").alias("v"))
    placed = e.repartitionByRange(8, "event_id").withColumn("ts", F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("event_id").cast("int") * 5))
    return segments.scan(placed, lambda rows, by: quality.persistent_runs(rows, "v", 2, by), before=1800, after=1800, rows=2048).select("event_id", "v")
