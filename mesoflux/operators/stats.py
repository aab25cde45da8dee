"""Distribution-free statistics: moments, histograms, bins, sectors, circular means, running shares."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .metrics import correlation


def describe_shape(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, std (n - 1), min, p1, p25, p50, p75, p99, max, and bias-corrected skewness and excess kurtosis."""
    c = F.col(column)
    n = F.count(c).cast("double")
    skew = F.when((n > 2) & (F.var_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when((n > 3) & (F.var_pop(c) > 0), (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(c) + 6))
    one = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), skew.alias("skew"), kurt.alias("kurtosis"))
    q = ranks.quantiles(df, column, (0.01, 0.25, 0.5, 0.75, 0.99), by).select(*[F.col(k).alias(f"_q_{k}") for k in by], F.col("q").alias("_q"))
    one = one.join(q, [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in by], "left") if by else one.crossJoin(q)  # a row each
    return one.select(*by, "n", "mean", "std", "min", *[F.col("_q")[k].alias(f"p{p}") for k, p in enumerate((1, 25, 50, 75, 99))], "max", "skew", "kurtosis")


def linear_edges(low: float, high: float, step: float) -> list[float]:
    n = round((high - low) / step)
    return [low + k * step for k in range(n + 1)]


def rain_edges(quantum: float = 0.254, linear: int = 20, top: float = 120.0, log_bins: int = 20) -> list[float]:
    """Half-quantum edges for the first tips, then edges even in the logarithm, snapped to half-quanta."""
    out = [quantum * (k + 0.5) for k in range(linear)]
    last = out[-1]
    ratio = (top / last) ** (1 / log_bins)
    for k in range(1, log_bins + 1):
        snapped = (math.floor(last * ratio**k / quantum) + 0.5) * quantum
        if snapped > out[-1]:
            out.append(snapped)
    return out


def bin_index(c: Column, edges: Sequence[float], close_last: bool = True) -> Column:
    """0-based bin of a value on ascending edges; null outside. The last bin is closed unless told otherwise."""
    array = F.array(*[F.lit(float(e)) for e in edges])
    inside = (c >= edges[0]) & (c <= edges[-1] if close_last else c < edges[-1])
    index = F.size(F.filter(array, lambda e: e <= c)) - 1
    return F.when(inside, F.least(index, F.lit(len(edges) - 2)))


def even_bin(c: Column, low: float, step: float, bins: int, close_last: bool = True) -> Column:
    """``bin_index`` for even edges, by arithmetic."""
    high = low + step * bins
    inside = (c >= low) & (c <= high if close_last else c < high)
    return F.when(inside, F.least(F.floor((c - low) / step).cast("int"), F.lit(bins - 1)))


def histogram(df: DataFrame, column: str, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, low, high, n, density, below, above): every bin, empty ones too; density over the values inside."""
    c = F.col(column)
    place = F.when(c < edges[0], -1).when(c > edges[-1], len(edges) - 1).otherwise(bin_index(c, edges))
    counts = df.where(c.isNotNull() & ~F.isnan(c)).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))
    one = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"),
        F.sum(F.when(F.col("bin").between(0, len(edges) - 2), F.col("n")).otherwise(0)).alias("inside"),
    )
    bins = F.array(*[F.struct(F.lit(k).alias("bin"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for k, (a, b) in enumerate(zip(edges, edges[1:]))])
    at = lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0))
    rows = one.select(*by, "m", "inside", F.inline(bins))
    n = at(F.col("bin"))
    return rows.select(*by, "bin", "low", "high", n.alias("n"), F.try_divide(n, F.col("inside") * (F.col("high") - F.col("low"))).alias("density"), at(F.lit(-1)).alias("below"), at(F.lit(len(edges) - 1)).alias("above"))


def histogram_2d(df: DataFrame, x: str, y: str, x_edges: Sequence[float], y_edges: Sequence[float]) -> DataFrame:
    """(i, j, n) of cells that hold something; i counts along y, j along x."""
    cells = df.select(bin_index(F.col(y), y_edges).alias("i"), bin_index(F.col(x), x_edges).alias("j")).where("i IS NOT NULL AND j IS NOT NULL")
    return cells.groupBy("i", "j").agg(F.count("*").alias("n"))


def quantile_band(df: DataFrame, x: str, y: str, edges: Sequence[float], min_samples: int) -> DataFrame:
    """(bin, centre, n, p10, median, p90) on right-open bins, the last edge excluded; null below ``min_samples``."""
    rows = df.where(F.col(y).isNotNull()).withColumn("bin", bin_index(F.col(x), edges, close_last=False)).where("bin IS NOT NULL")
    got = rows.groupBy("bin").agg(F.count("*").alias("n")).join(ranks.quantiles(rows, y, (0.1, 0.5, 0.9), ["bin"]), "bin")
    bins = df.sparkSession.createDataFrame([(k, (a + b) / 2) for k, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, centre double")
    enough = F.col("n") >= min_samples
    return bins.join(got, "bin", "left").select("bin", "centre", F.coalesce("n", F.lit(0)).alias("n"), *[F.when(enough, F.col("q")[k]).alias(name) for k, name in enumerate(("p10", "median", "p90"))])


def sector(direction: Column, sectors: int = 16) -> Column:
    """0 is the sector centred on north."""
    width = 360.0 / sectors
    return F.floor(F.pmod(F.pmod(direction, F.lit(360.0)) + width / 2, F.lit(360.0)) / width).cast("int")


def sector_frequencies(df: DataFrame, column: str, sectors: int = 16) -> DataFrame:
    """(sector, n, share) of every sector."""
    counts = df.where(F.col(column).isNotNull()).groupBy(sector(F.col(column), sectors).alias("sector")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(sectors).select(F.col("id").cast("int").alias("sector"))
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(0)))  # over 16 rows
    return every.join(counts, "sector", "left").select("sector", F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.coalesce("n", F.lit(0)), total).alias("share"))


def circular_summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean_direction, resultant, circular_variance) of degrees."""
    r = F.radians(column)
    c, s = F.avg(F.cos(r)), F.avg(F.sin(r))
    length = F.sqrt(c * c + s * s)
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)).alias("mean_direction"), length.alias("resultant"), (F.lit(1.0) - length).alias("circular_variance"))


def cumulative_frequency(bins: DataFrame, order: str, n: str, total: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Running share of binned counts; ``total`` may count rows that no bin holds."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    whole = F.sum(n).over(part) if total is None else total
    return bins.withColumn("cumulative", F.try_divide(F.sum(n).over(part.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), whole))


def class_shares(df: DataFrame, column: str, classes: Sequence[int]) -> DataFrame:
    """(class, n, share) of labelable rows, empty classes included."""
    counts = df.where(F.col(column).isin(*classes)).groupBy(F.col(column).cast("int").alias("class")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(int(c),) for c in classes], "class int")
    joined = every.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))
    return joined.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))))


def scale_bounds(df: DataFrame, value: str, by: Sequence[str], step: str = "step", high: float = 0.98, from_step: int = 1) -> DataFrame:
    """(by, scale_min, scale_max): the least value and a high percentile, without the first step."""
    rows = df.where((F.col(step) >= from_step) & F.col(value).isNotNull())
    q = ranks.quantiles(rows, value, (0.0, high), by)
    return q.select(*by, F.col("q")[0].alias("scale_min"), F.col("q")[1].alias("scale_max"))


def equal_count_bins(df: DataFrame, x: str, bins: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, mean, weight): bins of nearly equal count along the sorted covariate, larger ones first."""
    cut = ranks.ranked(df.select(*by, x), x, by).withColumn("bin", ranks.tile(bins))
    got = cut.groupBy(*by, "bin").agg(F.avg(x).alias("mean"), F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return got.withColumn("weight", F.col("n") / total).drop("n")


def linear_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = (), min_pairs: int = 100) -> DataFrame:
    """(by, n, slope, intercept, sigma): least squares, and the residuals' standard deviation (n - 1), from moments in one pass."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count("*")
    left = F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)
    fits = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.sqrt(F.greatest(left, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))).alias("sigma")]
    got = ok.groupBy(*by).agg(n.alias("n"), *fits)
    return got.select(*by, "n", *[F.when(F.col("n") >= min_pairs, F.col(c)).alias(c) for c in ("slope", "intercept", "sigma")])


def display_range(bins: DataFrame, tail: float = 0.001) -> DataFrame:
    """(first_low, last_high) of (low, high, n) bins once that share is cut off both tails; a few rows."""
    part = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(part)
    up, down = F.sum("n").over(part.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(part.orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, 0))
    kept = bins.withColumns({"_up": up, "_down": down, "_t": total}).where((F.col("_up") > tail * F.col("_t")) & (F.col("_down") > tail * F.col("_t")))
    return kept.agg(F.min("low").alias("first_low"), F.max("high").alias("last_high"))


def effective_sample_size(df: DataFrame, column: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, r1, n_eff): n (1 - r1) / (1 + r1), r1 the lag-1 correlation of the ordered sample."""
    base = ranks.previous(df.where(F.col(column).isNotNull()).select(*by, order, F.col(column).alias("_v")), ["_v"], order, by, "_before")
    got = base.groupBy(*by).agg(F.count("*").alias("n"), correlation(F.col("_v"), F.col("_v_before")).alias("r1"))
    return got.withColumn("n_eff", F.try_divide(F.col("n") * (1 - F.col("r1")), 1 + F.col("r1")))


def choose_interval(df: DataFrame, value: str, step: str = "step", choices: Sequence[tuple[float, float]] = ((16.0, 4.0), (8.0, 2.0)), finest: float = 1.0) -> DataFrame:
    """(step, interval, levels): one contour interval for all steps by their median range, and the levels inside each step's."""
    spans = df.where(F.col(value).isNotNull()).groupBy(step).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    middle = spans.agg(F.percentile(F.col("hi") - F.col("lo"), F.lit(0.5)).alias("m"))
    pick = None
    for bound, interval in choices:
        pick = (F if pick is None else pick).when(F.col("m") >= bound, F.lit(interval))
    joined = spans.crossJoin(F.broadcast(middle.select(pick.otherwise(F.lit(finest)).alias("interval"))))
    first = F.ceil(F.col("lo") / F.col("interval")) * F.col("interval")
    inside = F.when(first <= F.col("hi"), F.filter(F.sequence(first.cast("int"), F.col("hi").cast("int"), F.col("interval").cast("int")), lambda x: (x > F.col("lo")) & (x < F.col("hi"))))
    return joined.select(step, "interval", F.coalesce(inside, F.array().cast("array<int>")).alias("levels"))


def top_counts(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """(by, n): the ``n`` groups with the most rows, of equal ones the first by name. Spark keeps n rows a task."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(n)


#: Rows of a leaf of the hash tree, about.
LEAF_ROWS = 1024


def content_hash(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """(n, hash): a hash tree over the rows. ``order`` names the columns that identify a row.

    A leaf is the SHA-256 of the rows' hashes under a beginning of their keys' hash, which is as long as it takes for a leaf to hold
    about ``LEAF_ROWS`` rows (three digits at least); sixteen nodes at a time are hashed together up to three digits, and those 4,096 at
    last. So no array grows with the table, and the hash is the same however the rows are partitioned. Rows are counted first.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256)
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in order])
    digits = 3
    rows = df.count()
    while rows > LEAF_ROWS * 16**digits:
        digits += 1
    joined = lambda *by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, "h"))), lambda x: x["h"]), ""), 256).alias("h")
    level = df.select(F.substring(F.md5(key), 1, digits).alias("part"), key.alias("k"), row.alias("h")).groupBy("part").agg(F.count("*").alias("n"), joined("k"))
    for length in range(digits - 1, 2, -1):
        level = level.withColumn("up", F.substring("part", 1, length)).groupBy("up").agg(F.sum("n").alias("n"), joined("part")).withColumnRenamed("up", "part")
    top = level.select(F.conv("part", 16, 10).cast("int").alias("part"), "n", "h")
    return top.agg(F.sum("n").alias("n"), joined("part").alias("hash"))
