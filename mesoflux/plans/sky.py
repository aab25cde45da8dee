"""Published sky documents: the cumulative clearness index by subset, and diffuse fraction against clearness with models and points."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import solar
from ..functions.atmosphere import finite
from ..operators import metrics, quality, stats
from ..sources import publish
from ..sources.scratch import scratch_path
from . import pipelines

#: Edges of both axes: fifty bins of 0.02.
EDGES = tuple(round(0.02 * k, 2) for k in range(51))
CLASSES = (0, 1, 2, 3)


def _class_document(counts: Column) -> Column:
    """Bounds, labelable rows and (class from 1, from, to, n, share) of a map class -> rows."""
    n = lambda k: F.coalesce(F.try_element_at(counts, F.lit(k)), F.lit(0).cast("long"))
    total = sum((n(k) for k in CLASSES), F.lit(0).cast("long"))
    edge = lambda k: F.lit(float(solar.SKY_BOUNDS[k])) if 0 <= k < len(solar.SKY_BOUNDS) else F.lit(None).cast("double")
    rows = [F.struct(F.lit(k + 1).alias("condition"), F.array(edge(k - 1), edge(k)).alias("kt_range"), n(k).alias("count"), F.try_divide(n(k), total).alias("fraction")) for k in CLASSES]
    return F.struct(F.array(*[F.lit(float(b)) for b in solar.SKY_BOUNDS]).alias("kt_upper_bounds"), total.alias("n"), F.array(*rows).alias("conditions"))


def cumulative_documents(df: DataFrame, subsets: Mapping[str, tuple[str, Column]], column: str = "kt", edges: Sequence[float] = EDGES) -> DataFrame:
    """(value): one JSON text with the edges and, for each subset (id -> (label, condition)), n, counts, below, above, F at each upper
    edge to six decimals, and the sky conditions. Missing and infinite values don't count; a subset without rows has no F.

    The rows are scanned once: each goes to the subsets that it is in, and counts of (subset, bin, class) are all that is left of them.
    """
    v = finite(F.col(column))
    last = len(edges) - 1
    place = F.when(v < edges[0], F.lit(-1)).when(v > edges[-1], F.lit(last)).otherwise(stats.bin_index(v, edges))
    inside = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, (_, (_, c)) in enumerate(subsets.items())]))
    cells = df.where(v.isNotNull()).select(F.explode(inside).alias("k"), place.alias("bin"), solar.sky_class(v).alias("sky")).groupBy("k", "bin", "sky").agg(F.count("*").alias("n"))
    # from here on at most len(subsets) * len(edges) * len(CLASSES) rows
    bins = cells.groupBy("k", "bin").agg(F.sum("n").alias("n")).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    skies = cells.groupBy("k", "sky").agg(F.sum("n").alias("n")).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("sky", "n"))).alias("skies"))
    names = df.sparkSession.createDataFrame([(k, name, label) for k, (name, (label, _)) in enumerate(subsets.items())], "k int, name string, label string")
    rows = names.join(bins, "k", "left").join(skies, "k", "left")
    at = lambda k: F.coalesce(F.try_element_at("bins", k), F.lit(0).cast("long"))
    rows = rows.withColumns({"counts": F.transform(F.sequence(F.lit(0), F.lit(last - 1)), at), "below": at(F.lit(-1)), "above": at(F.lit(last))})
    rows = rows.withColumn("n", F.aggregate("counts", F.col("below") + F.col("above"), lambda a, x: a + x))
    running = F.transform(F.sequence(F.lit(1), F.lit(last)), lambda k: F.round(F.try_divide(F.aggregate(F.slice("counts", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x), F.col("n")), 6))
    doc = F.struct("label", "n", "counts", F.when(F.col("n") > 0, running).otherwise(F.array().cast("array<double>")).alias("cumulative"), "below", "above", _class_document(F.coalesce("skies", F.create_map().cast("map<int,bigint>"))).alias("sky_conditions"))
    one = rows.select("k", "name", doc.alias("doc")).agg(F.array_sort(F.collect_list(F.struct("k", "name", "doc"))).alias("all"))
    by_name = F.map_from_entries(F.transform("all", lambda r: F.struct(r["name"], r["doc"])))
    head = F.struct(F.lit("clearness_index_cumulative").alias("variable"), F.array(*[F.lit(float(e)) for e in edges]).alias("edges"), by_name.alias("subsets"))
    return one.select(F.to_json(head, {"ignoreNullFields": "false"}).alias("value"))


def cell_points(df: DataFrame, x: str, y: str, edges: Sequence[float], per_cell: int, ts: str = "ts") -> DataFrame:
    """(i, j, x, y, ts): of each density cell the ``per_cell`` rows whose stamps have the least digests, or all if there are fewer.

    A row's place in that order does not hang on other rows, so the choice is the same for any partitioning, and Spark cuts every cell to
    ``per_cell`` rows before the exchange. Rows outside the edges, or without a value, are in no cell. Equal stamps go by x, then y.
    """
    cells = df.select(stats.bin_index(F.col(y), edges).alias("i"), stats.bin_index(F.col(x), edges).alias("j"), x, y, ts).where("i IS NOT NULL AND j IS NOT NULL")
    digest = F.md5(F.unix_micros(F.col(ts).cast("timestamp")).cast("string").cast("binary"))
    order = Window.partitionBy("i", "j").orderBy("_d", x, y)
    return cells.withColumn("_d", digest).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_cell).drop("_d", "_k")


def ktkd_document(table: DataFrame, curves: Mapping[str, tuple[str, Callable[[Column], Column]]], bands: Mapping[str, str], edges: Sequence[float] = EDGES, min_samples: int = 30, per_cell: int | None = 8, facts: Mapping[str, str] | None = None, ts: str = "ts") -> DataFrame:
    """(value): one JSON text: period, density, models with their scores, sky conditions and points of hours with ``kt`` and ``kd``.

    ``curves``: id -> (column, formula) of a model of kt alone, whose formula is drawn at the bins' centres; ``bands``: id -> column of a
    model with more inputs, drawn as median, p10 and p90 of each kt bin that holds ``min_samples``. Both are scored over pairs of finite values. ``per_cell``: points a density cell (None: no points); so the document's
    size hangs on the bins, not on the rows. No row at all is an error, so that no empty document is published.
    """
    spark = table.sparkSession
    path = scratch_path(spark, "ktkd")
    models = {m: c for m, (c, _) in curves.items()} | dict(bands)
    table.select(ts, *[finite(F.col(c)).alias(c) for c in ("kt", "kd", *models.values())]).where("kt IS NOT NULL AND kd IS NOT NULL").write.parquet(path)  # what several aggregates read
    rows = spark.read.parquet(path)
    if rows.isEmpty():
        raise ValueError("no hour has both kt and kd")
    scored = [F.struct(F.lit(m).alias("id"), metrics.rmse(F.col("kd"), F.col(c)).alias("rmse"), metrics.mbe(F.col("kd"), F.col(c)).alias("mbe"), metrics.mae(F.col("kd"), F.col(c)).alias("mae"), metrics.n_pairs(F.col("kd"), F.col(c)).alias("n")) for m, c in models.items()]
    sky = solar.sky_class(F.col("kt"))
    known = F.map_from_arrays(F.array(*[F.lit(k) for k in CLASSES]), F.array(*[F.count_if(sky == k) for k in CLASSES]))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    whole = rows.agg(F.struct(stamp(F.min(ts)).alias("start"), stamp(F.max(ts)).alias("end"), F.count("*").alias("n")).alias("period"), known.alias("_classes"), F.array(*scored).alias("scores"))
    whole = whole.select("period", _class_document(F.col("_classes")).alias("sky_conditions"), "scores")
    size = len(edges) - 1
    density = publish.density_payload(stats.histogram_2d(rows, "kt", "kd", edges, edges), size, size).select(F.from_json("value", "counts array<array<bigint>>, max_count bigint").alias("density"))
    one = whole.crossJoin(density)  # a row each, as below
    drawn = []
    for m, c in bands.items():
        band = stats.quantile_band(rows, "kt", c, edges, min_samples)
        name = f"_b{len(drawn)}"
        one = one.crossJoin(band.agg(F.array_sort(F.collect_list(F.struct("bin", F.col("centre").alias("kt"), "n", "median", "p10", "p90"))).alias(name)))
        drawn.append(F.struct(F.lit(m).alias("id"), F.lit("band").alias("kind"), F.col(name).alias("bins")))
    centres = [(low + high) / 2 for low, high in zip(edges, edges[1:])]
    for m, (_, formula) in curves.items():
        null = F.lit(None).cast("double")
        bins = [F.struct(F.lit(k).alias("bin"), F.lit(c).alias("kt"), F.lit(None).cast("long").alias("n"), formula(F.lit(c)).alias("median"), null.alias("p10"), null.alias("p90")) for k, c in enumerate(centres)]
        drawn.append(F.struct(F.lit(m).alias("id"), F.lit("curve").alias("kind"), F.array(*bins).alias("bins")))
    parts = ["period", "density", F.array(*drawn).alias("models") if drawn else F.array().alias("models"), "scores", "sky_conditions"]
    if per_cell is not None:
        triple = F.array(F.round("kt", 3).cast("string"), F.round("kd", 3).cast("string"), stamp(F.col(ts)))
        chosen = cell_points(rows, "kt", "kd", edges, per_cell, ts)
        one = one.crossJoin(chosen.agg(F.transform(F.array_sort(F.collect_list(F.struct(ts, "kt", "kd", triple.alias("p")))), lambda r: r["p"]).alias("points")))  # per_cell a cell at most
        parts += ["points", F.array(F.lit("kt"), F.lit("kd"), F.lit("t")).alias("points_format")]
    told = [F.lit(v).alias(k) for k, v in (facts or {}).items()]
    return one.select(F.to_json(F.struct(*told, *parts), {"ignoreNullFields": "false"}).alias("value"))


def sky_documents(hourly: DataFrame, site: solar.Site, ghi: str = "Sw_dw", dhi: str = "Sw_dif", keys: Sequence[str] = (), ts: str = "ts", per_cell: int | None = 8) -> dict[str, DataFrame]:
    """Both documents of an hourly table: the clearness of all hours with the global channel (year, summer, winter), and kt against kd."""
    clear = quality.prepare_clearness(hourly, site, ghi, ts)
    month = F.month(ts)
    seasons = {"observed_all": ("all year", F.lit(True)), "observed_djf": ("December to February", month.isin(12, 1, 2)), "observed_jja": ("June to August", month.isin(6, 7, 8))}
    pairs = pipelines.ktkd_table(hourly, site, ghi, dhi, keys, ts)
    curves = {"marques_filho_2016": ("marques_filho", solar.marques_filho)}
    return {"kt_cumulative": cumulative_documents(clear, seasons), "ktkd": ktkd_document(pairs, curves, {"lemos_2017": "lemos", "ridley_brl_2010": "ridley"}, per_cell=per_cell, ts=ts)}
