"""Joins on time, on windows and on place, and set checks between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from . import segments


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str = "ts", tolerance: str = "30 minutes", columns: Sequence[str] | None = None, suffixes: tuple[str, str] = ("_obs", "_model"), sliced: int | None = None) -> DataFrame:
    """Every left row beside the right row nearest in time within the tolerance; of two as near, the earlier.

    One union and one shuffle on the keys: in time order the last right row is carried along, in the order of time reversed the next
    one, each frame growing from its start, so the work is linear in the rows. Without a match the right columns are null. Right rows with the same stamp must be made one beforehand.
    Give ``keys`` (a station) wherever there are several; ``sliced`` cuts long series into ranges of about so many rows.
    """
    names = list(columns if columns is not None else [c for c in left.columns if c in right.columns and c not in (*keys, ts)])
    payload = lambda df: F.struct(F.col(ts).alias("_at"), *[F.col(c).alias(c) for c in names])
    none = F.lit(None)
    a = left.select(*keys, ts, F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), none.cast(right.select(payload(right)).schema[0].dataType).alias("_r"))
    b = right.select(*keys, ts, F.lit(0).alias("_side"), none.cast(a.schema["_row"].dataType).alias("_row"), payload(right).alias("_r"))
    both = a.unionByName(b)
    if sliced:
        # stamps of both sides order rows; the side decides between equal ones, for which a right row counts as before and after
        cut = segments.cut(both, keys, ts, segments.edges(left.select(ts), ts, sliced)).withColumn("_order", 2 * segments.micros(both, ts) + F.col("_side"))
        found = segments.carried(segments.carried(cut, {"_before": F.col("_r")}, keys, "_order"), {"_after": F.col("_r")}, keys, "_order", backwards=True).drop("_slice", "_cuts", "_order")
        both = found.where("_side = 1")
    else:
        w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(ts, "_side")
        both = both.withColumn("_before", F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        back_in_time = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc(ts), F.desc("_side"))
        both = both.withColumn("_after", F.last("_r", ignorenulls=True).over(back_in_time.rowsBetween(Window.unboundedPreceding, 0))).where("_side = 1")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    back, ahead = micros(F.col(ts)) - micros(F.col("_before._at")), micros(F.col("_after._at")) - micros(F.col(ts))
    pick = F.when(ahead.isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    gap = F.when(ahead.isNull() | (back <= ahead), back).otherwise(ahead)
    limit = micros(F.expr(f"timestamp '1970-01-01 00:00:00' + INTERVAL {tolerance}")) - micros(F.lit("1970-01-01 00:00:00").cast("timestamp"))
    found = both.withColumns({"_gap": gap, "_pick": F.when(gap <= limit, pick)})
    return found.select(
        *keys, ts, *[F.col(f"_row.{c}").alias(f"{c}{suffixes[0]}" if c in names else c) for c in left.columns if c not in (*keys, ts)],
        *[F.col(f"_pick.{c}").alias(f"{c}{suffixes[1]}") for c in names], F.when(gap <= limit, gap / 1e6).alias("gap_seconds"),
    )


def pair_frames(frames: DataFrame, sensors: DataFrame, keys: Sequence[str], ts: str = "ts", max_distance: str = "5 minutes") -> DataFrame:
    """Frames with the sensor row nearest in time, and ``distance_minutes``; frames without one are left out."""
    columns = [c for c in sensors.columns if c not in (*keys, ts)]
    joined = asof_nearest(frames, sensors, keys, ts, max_distance, columns, ("_frame", ""))
    return joined.where(F.col("gap_seconds").isNotNull()).withColumn("distance_minutes", F.col("gap_seconds") / 60).drop("gap_seconds")


def join_on_index(a: DataFrame, b: DataFrame, on: Sequence[str] = ("ts",), suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    both = set(a.columns) & set(b.columns) - set(on)
    return a.withColumnsRenamed({c: c + suffixes[0] for c in both}).join(b.withColumnsRenamed({c: c + suffixes[1] for c in both}), list(on))


def outer_combine(a: DataFrame, b: DataFrame, on: Sequence[str] = ("ts",)) -> DataFrame:
    """Full outer join that takes only the columns of ``b`` that ``a`` lacks."""
    return a.join(b.select(*on, *[c for c in b.columns if c not in a.columns]), list(on), "full_outer")


def interval_join(rows: DataFrame, rules: DataFrame, key: str, ts: str = "ts", start: str = "start", end: str = "end", how: str = "inner", max_rules: int = 10_000, bucket_days: int = 30) -> DataFrame:
    """Rows beside the rules whose inclusive window holds their stamp. ``rules`` shares ``key`` with ``rows``.

    Up to ``max_rules`` rules are broadcast (counted first). Beyond that both sides are cut into buckets of days, so that the join
    is an equi-join on key and bucket instead of a nested loop.
    """
    kept = rules.withColumnsRenamed({c: f"rule_{c}" for c in rules.columns if c in rows.columns and c != key})
    inside = (F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))
    if rules.limit(max_rules + 1).count() <= max_rules:
        named = kept.withColumnRenamed(key, "_key")
        return rows.join(F.broadcast(named), (F.col(key) == F.col("_key")) & inside, how).drop("_key")
    day = lambda c: F.floor(F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")) / bucket_days)
    wide = kept.withColumnRenamed(key, "_key").withColumn("_b", F.explode(F.sequence(day(F.col(start)), day(F.col(end)))))
    return rows.withColumn("_rb", day(F.col(ts))).join(wide, (F.col(key) == F.col("_key")) & (F.col("_rb") == F.col("_b")) & inside, how).drop("_key", "_b", "_rb")


def nearest_cell(points: DataFrame, cells: DataFrame, lat: str = "lat", lon: str = "lon", outside: str = "error", by: Sequence[str] = ()) -> DataFrame:
    """``points`` with the y, x of the nearest cell (by the hypotenuse of degrees; the least y, x on ties) and km.

    ``by`` names the columns that say which grid a point and a cell belong to; one plan serves any number of grids, each with tiles of
    its own size. Distinct places of both sides meet by an equi-join on square tiles. A place is settled once its nearest cell is no
    farther than the rings of tiles that were searched; for the others the rings are doubled. Every row of ``points`` stays, repeated
    ones too; where there is no place or no cell, y, x and km are null. A place beyond the cells' centres fails the job, since its
    nearest cell would be the grid's edge; with ``outside="nearest"`` it gets that cell.
    """
    if outside not in ("error", "nearest"):
        raise ValueError(f"unknown handling of outside places: {outside}")
    spark, grid = points.sparkSession, [f"_b_{c}" for c in by]
    own = [F.col(c).alias(f"_b_{c}") for c in by]
    sites = cells.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(*own, F.col(lat).cast("double").alias("_clat"), F.col(lon).cast("double").alias("_clon")).agg(F.min(F.struct("y", "x")).alias("_c"))
    boxes = sites.groupBy(*grid).agg(F.count("*").alias("_n"), *[f(c).alias(k) for k, f, c in (("_s", F.min, "_clat"), ("_t", F.max, "_clat"), ("_w", F.min, "_clon"), ("_e", F.max, "_clon"))]).where("_n > 0")
    tall, wide = F.col("_t") - F.col("_s"), F.col("_e") - F.col("_w")
    boxes = boxes.withColumn("_side", F.greatest(F.sqrt(tall * wide / F.col("_n")) * 2, F.greatest(tall, wide) * 2 / F.col("_n"), F.lit(1e-9)))  # a few cells a tile
    path = scratch_path(spark, "grids")
    boxes.withColumns({"_rows": F.floor(tall / F.col("_side")) + 1, "_columns": F.floor(wide / F.col("_side")) + 1}).write.parquet(path)
    boxes = spark.read.schema(", ".join([*[f"`_b_{c}` {cells.schema[c].dataType.simpleString()}" for c in by], "_n long, _s double, _t double, _w double, _e double, _side double, _rows long, _columns long"])).parquet(path)
    beside = lambda df: df.join(boxes, grid) if grid else df.crossJoin(F.broadcast(boxes))  # noqa: E731  # without ``by`` a row at most
    tile = lambda c, low: F.floor((F.col(c) - F.col(low)) / F.col("_side"))
    tiled = beside(sites).select(*grid, tile("_clat", "_s").alias("_ti"), tile("_clon", "_w").alias("_tj"), "_clat", "_clon", "_c")
    places = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*own, F.col(lat).cast("double").alias("_plat"), F.col(lon).cast("double").alias("_plon")).distinct()
    rest, ring, found = beside(places), 1, None
    while True:
        last = F.lit(ring) >= F.greatest("_rows", "_columns")
        # beyond the grid the last rings are counted from its edge, so that they hold the whole grid
        edge = lambda t, most: F.when(last, F.least(F.greatest(t, F.lit(0)), F.col(most))).otherwise(t)
        span = lambda t, most: F.sequence(F.greatest(t - ring, F.lit(0).cast("long")), F.least(t + ring, F.col(most)))
        near = rest.withColumns({"_i": edge(tile("_plat", "_s"), "_rows"), "_j": edge(tile("_plon", "_w"), "_columns"), "_last": last})
        near = near.where((F.col("_i") + ring >= 0) & (F.col("_i") - ring <= F.col("_rows")) & (F.col("_j") + ring >= 0) & (F.col("_j") - ring <= F.col("_columns")))
        near = near.withColumn("_ti", F.explode(span(F.col("_i"), "_rows"))).withColumn("_tj", F.explode(span(F.col("_j"), "_columns"))).select(*grid, "_plat", "_plon", "_side", "_last", "_ti", "_tj")
        d = F.sqrt(F.pow(F.col("_clat") - F.col("_plat"), 2) + F.pow(F.col("_clon") - F.col("_plon"), 2))
        best = near.join(tiled, [*grid, "_ti", "_tj"]).groupBy(*grid, "_plat", "_plon", "_side", "_last").agg(F.min(F.struct(d.alias("d"), F.col("_c.y"), F.col("_c.x"), "_clat", "_clon")).alias("b"))
        settled = best.where(F.col("_last") | (F.col("b.d") < ring * F.col("_side") * (1 - 1e-9))).select(*grid, "_plat", "_plon", "b")
        found = settled if found is None else found.union(settled)
        rest = rest.where(~last).join(settled.select(*grid, "_plat", "_plon"), [*grid, "_plat", "_plon"], "left_anti")
        if rest.isEmpty():
            break
        ring *= 2
    km = F.sqrt(F.pow((F.col("b._clat") - F.col(lat)) * 111.32, 2) + F.pow((F.col("b._clon") - F.col(lon)) * 111.32 * F.cos(F.radians(lat)), 2))
    joined = points.join(found, [*[F.col(c) == F.col(f"_b_{c}") for c in by], F.col(lat).cast("double") == F.col("_plat"), F.col(lon).cast("double") == F.col("_plon")], "left").drop(*grid)
    y = F.col("b.y")
    if outside == "error":
        joined = joined.join(boxes, [F.col(c) == F.col(f"_b_{c}") for c in by], "left") if by else joined.join(F.broadcast(boxes), F.lit(True), "left")
        inside = F.col(lat).between(F.col("_s"), F.col("_t")) & F.col(lon).between(F.col("_w"), F.col("_e"))
        y = F.when(F.coalesce(~inside, F.lit(False)), F.raise_error(F.format_string("a place lies outside the grid: %s, %s", lat, lon)).cast("long")).otherwise(y)
    return joined.select(*points.columns, y.alias("y"), F.col("b.x").alias("x"), km.alias("distance_km"))


def assign_domains(stations: DataFrame, domains: DataFrame) -> DataFrame:
    """Each station with the finest domain whose bounds hold it (by dx, then name); null where none does.

    ``domains``: domain, dx, south, north, west, east; Spark broadcasts it while it is small. Equal stations stay as they are.
    """
    d = domains.select("domain", "dx", "south", "north", "west", "east")
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    places = stations.select("lat", "lon").distinct()
    best = places.join(d, inside).groupBy(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).agg(F.min(F.struct("dx", "domain")).alias("_b"))
    joined = stations.join(best, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")), "left")
    return joined.select(*stations.columns, F.col("_b.domain").alias("domain"))


def point_series(fields: DataFrame, located: DataFrame, values: Sequence[str], time: str = "valid_time") -> DataFrame:
    """Values at located points: an equi-join on (domain, y, x); rows without a stamp go."""
    return fields.where(F.col(time).isNotNull()).join(located, ["domain", "y", "x"]).select("name", time, *values)


def neighbour_mean(df: DataFrame, column: str, keys: Sequence[str] = (), ts: str = "ts", step: str = "1 hour") -> DataFrame:
    """``psi``: mean of the values exactly a step before and after; the one there is; else the row's own."""
    gap = F.expr(f"INTERVAL {step}")
    w = Window.partitionBy(*keys).orderBy(ts) if keys else Window.orderBy(ts)
    before = F.when(F.lag(ts).over(w) == F.col(ts) - gap, F.lag(column).over(w))
    after = F.when(F.lead(ts).over(w) == F.col(ts) + gap, F.lead(column).over(w))
    base = df.withColumns({"_p": before, "_n": after})
    return base.withColumn("psi", F.coalesce((F.col("_p") + F.col("_n")) / 2, "_p", "_n", column)).drop("_p", "_n")


def daily_ratio(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), ts: str = "ts", name: str = "daily_kt") -> DataFrame:
    """The day's sum of ``a`` over its sum of ``b``, on each row of the day; a missing hour counts 0 in its own sum."""
    w = Window.partitionBy(*keys, F.to_date(ts))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return df.withColumn(name, F.try_divide(F.sum(zero(a)).over(w), F.sum(zero(b)).over(w)))


def map_label(df: DataFrame, labels: DataFrame, on: str, column: str) -> DataFrame:
    """Fill ``column`` from a table (on, column), keeping what no label covers."""
    joined = df.join(labels.select(on, F.col(column).alias("_new")), on, "left")
    old = F.col(column) if column in df.columns else F.lit(None)
    return joined.withColumn(column, F.coalesce("_new", old)).drop("_new").select(*df.columns, *([] if column in df.columns else [column]))


def or_flags(df: DataFrame, flags: DataFrame, on: str = "sample_id", column: str = "qc_flags") -> DataFrame:
    merged = flags.groupBy(on).agg(F.bit_or(column).alias("_f"))
    return df.join(merged, on, "left").withColumn(column, F.coalesce(F.col(column), F.lit(0)).bitwiseOR(F.coalesce("_f", F.lit(0)))).drop("_f")


def pending_work(days: DataFrame, ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """(day_key, kind): steps of ``wanted`` (kind, params, destination) that the ledger doesn't hold with equal parameters."""
    steps = days.crossJoin(F.broadcast(wanted))  # a handful of kinds
    done = ledger.select("day_key", "kind", "params", "destination").distinct()
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")) for c in ("day_key", "kind", "params", "destination")]
    return steps.alias("s").join(done.alias("d"), same, "left_anti").select("day_key", "kind")


def coverage_check(wanted: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, problem): ids that are missing from the index, and ids that it holds twice."""
    missing = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(index, key, "left_anti").withColumn("problem", F.lit("missing"))
    twice = index.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("duplicate").alias("problem"))
    return missing.unionByName(twice)


def temporal_coverage(videos: DataFrame, sensors: DataFrame, day: str = "day", ts: str = "ts") -> DataFrame:
    span = F.broadcast(sensors.agg(F.to_date(F.min(ts)).alias("_lo"), F.to_date(F.max(ts)).alias("_hi")))
    return videos.crossJoin(span).where(F.col(day).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def window_members(df: DataFrame, half_seconds: int, day: str, member: Column, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """``members``: the rows of the same day within half a window either way, in time order."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*keys, day).orderBy(micros).rangeBetween(-half_seconds * 1_000_000, half_seconds * 1_000_000)
    return df.withColumn("members", F.collect_list(member).over(w))


def reindex_to(times: DataFrame, sensors: DataFrame, on: Sequence[str] = ("ts",)) -> DataFrame:
    return times.join(sensors, list(on), "left")


def missing_steps(wanted: DataFrame, published: DataFrame, on: Sequence[str]) -> DataFrame:
    """What of ``wanted`` is not published, each once."""
    return wanted.select(*on).subtract(published.select(*on))


def disjoint_check(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; empty if the sets are disjoint."""
    return a.select(key).intersect(b.select(key))


def ordered_outer_merge(tables: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """Outer merge on all shared columns, one table after the other; rows equal in all of them collapse."""
    out = tables[0]
    for t in tables[1:]:
        shared = [c for c in out.columns if c in t.columns]
        right = t.withColumnsRenamed({c: f"_r_{c}" for c in shared})
        joined = out.join(right, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in shared], "full_outer")
        out = joined.select(*[F.coalesce(c, f"_r_{c}").alias(c) for c in shared], *[c for c in out.columns if c not in shared], *[c for c in t.columns if c not in shared])
    return out.orderBy(*order)
