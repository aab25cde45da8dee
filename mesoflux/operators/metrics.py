"""Scores of predictions against observations, as aggregate columns.

All of them look at rows where both sides are finite. Building blocks are plain sums, so any grouping (or GROUPING SETS) works and
partial aggregates do most of it before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.atmosphere import finite


def _pair(obs: Column, pred: Column) -> tuple[Column, Column]:
    o, p = finite(obs), finite(pred)
    ok = o.isNotNull() & p.isNotNull()
    return F.when(ok, o), F.when(ok, p)


def rmse(obs: Column, pred: Column) -> Column:
    o, p = _pair(obs, pred)
    return F.sqrt(F.avg((p - o) * (p - o)))


def mae(obs: Column, pred: Column) -> Column:
    o, p = _pair(obs, pred)
    return F.avg(F.abs(p - o))


def mbe(obs: Column, pred: Column) -> Column:
    o, p = _pair(obs, pred)
    return F.avg(p - o)


def n_pairs(obs: Column, pred: Column) -> Column:
    return F.count(_pair(obs, pred)[0])


def r_squared(obs: Column, pred: Column) -> Column:
    """1 - SSE / SST; null without spread."""
    o, p = _pair(obs, pred)
    return F.lit(1.0) - F.try_divide(F.sum((p - o) * (p - o)), F.when(F.var_pop(o) > 0, F.var_pop(o) * F.count(o)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r; null without spread, where ``corr`` raises."""
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(F.when(b.isNotNull(), a)) * F.var_pop(F.when(a.isNotNull(), b))))


def pearson(obs: Column, pred: Column) -> Column:
    o, p = _pair(obs, pred)
    return correlation(o, p)


def mape(obs: Column, pred: Column) -> Column:
    o, p = _pair(obs, pred)
    return F.avg(F.when(o != 0, F.abs((o - p) / o))) * 100


def nrmse(obs: Column, pred: Column) -> Column:
    """RMSE over the mean observation."""
    return F.try_divide(rmse(obs, pred), F.avg(_pair(obs, pred)[0]))


def nmae(obs: Column, pred: Column) -> Column:
    return F.try_divide(mae(obs, pred), F.avg(_pair(obs, pred)[0]))


def angle_gap(obs: Column, pred: Column) -> Column:
    """Residual of bearings, wrapped to [-180, 180)."""
    return F.pmod(pred - obs + 180.0, F.lit(360.0)) - 180.0


#: Name -> aggregate builder, for reports that choose their scores by name.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "n": n_pairs, "rmse": rmse, "mae": mae, "mbe": mbe, "r2": r_squared, "r": pearson, "mape": mape, "nrmse": nrmse, "nmae": nmae,
}


def score(df: DataFrame, obs: str, pred: str, by: Sequence[str] = (), metrics: Sequence[str] = ("n", "rmse", "mae", "mbe", "r2", "r"), min_pairs: int = 2) -> DataFrame:
    """One row a group; null scores where there are fewer pairs than ``min_pairs``."""
    o, p = F.col(obs), F.col(pred)
    enough = n_pairs(o, p) >= min_pairs
    return df.groupBy(*by).agg(*[(METRICS[m](o, p) if m == "n" else F.when(enough, METRICS[m](o, p))).alias(m) for m in metrics])


def paired_table(df: DataFrame, variables: Sequence[str], by: Sequence[str] = (), suffixes: tuple[str, str] = ("_obs", "_model"), circular: Sequence[str] = ("WD",)) -> DataFrame:
    """(by, variable, n, rmse, mae, mbe, r2, r, d, ioa, nrmse): all variables of a paired frame in two passes.

    ``d`` is Willmott's index, ``ioa`` its refined form. Bearings get n, rmse, mae and mbe of the wrapped gap only.
    """
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), finite(F.col(v + suffixes[0])).alias("o"), finite(F.col(v + suffixes[1])).alias("p")) for v in variables])
    long = df.select(*by, F.inline(rows)).where(F.col("o").isNotNull() & F.col("p").isNotNull())
    bearing = F.col("variable").isin(*circular) if circular else F.lit(False)
    gap = F.when(bearing, angle_gap(F.col("o"), F.col("p"))).otherwise(F.col("p") - F.col("o"))
    group = ["variable", *by]
    means = long.groupBy(*group).agg(F.avg("o").alias("_m"))
    with_mean = long.join(means, group) if by else long.join(F.broadcast(means), group)
    e, m = F.col("e"), F.col("_m")
    sse, spread = F.sum(e * e), F.sum((F.col("o") - m) * (F.col("o") - m))
    reach = F.sum(F.pow(F.abs(F.col("p") - m) + F.abs(F.col("o") - m), 2))
    flat, double_dev = F.sum(F.abs(e)), F.lit(2.0) * F.sum(F.abs(F.col("o") - m))
    ioa = F.when(flat <= double_dev, F.lit(1.0) - F.try_divide(flat, double_dev)).otherwise(F.try_divide(double_dev, flat) - 1.0)
    only = lambda c: F.when(~F.first(F.col("_c")), c)
    out = with_mean.withColumns({"e": gap, "_c": bearing}).groupBy(*group).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("mbe"),
        only(F.lit(1.0) - F.try_divide(sse, F.when(spread > 0, spread))).alias("r2"),
        only(correlation(F.col("o"), F.col("p"))).alias("r"),
        only(F.lit(1.0) - F.try_divide(sse, F.when(reach > 0, reach))).alias("d"), only(F.when(spread > 0, ioa)).alias("ioa"),
        only(F.try_divide(F.sqrt(F.avg(e * e)), F.abs(F.avg("o")))).alias("nrmse"),
    )
    return out.select(*group, "n", *[F.when(F.col("n") >= 2, F.col(c)).alias(c) for c in ("rmse", "mae", "mbe", "r2", "r", "d", "ioa", "nrmse")])


def skill(df: DataFrame, obs: str, model: str, reference: str, by: Sequence[str] = ()) -> DataFrame:
    """1 - rmse(model) / rmse(reference), both over rows where all three are finite."""
    full = df.where(finite(F.col(obs)).isNotNull() & finite(F.col(model)).isNotNull() & finite(F.col(reference)).isNotNull())
    a, b = rmse(F.col(obs), F.col(model)), rmse(F.col(obs), F.col(reference))
    return full.groupBy(*by).agg(F.count("*").alias("n"), a.alias("rmse_model"), b.alias("rmse_reference"), (F.lit(1.0) - F.try_divide(a, b)).alias("skill"))


def confusion(df: DataFrame, truth: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """(truth, pred, n) for every pair of classes, zeros included."""
    labels = df.sparkSession.createDataFrame([(int(c),) for c in classes], "c int")
    pairs = labels.select(F.col("c").alias("truth")).crossJoin(labels.select(F.col("c").alias("pred")))
    counts = df.where(F.col(truth).isin(*classes) & F.col(pred).isin(*classes)).groupBy(F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    return pairs.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def classification(df: DataFrame, truth: str, pred: str, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, accuracy, balanced_accuracy, macro_f1) over rows with a valid truth and prediction."""
    ok = df.where(F.col(truth).isin(*classes) & F.col(pred).isin(*classes))
    n = F.count("*")
    hit = {c: F.count_if((F.col(truth) == c) & (F.col(pred) == c)) for c in classes}
    real = {c: F.count_if(F.col(truth) == c) for c in classes}
    said = {c: F.count_if(F.col(pred) == c) for c in classes}
    recalls = F.array_compact(F.array(*[F.try_divide(hit[c], real[c]) for c in classes]))
    f1 = F.array_compact(F.array(*[F.when(real[c] + said[c] > 0, 2.0 * hit[c] / (real[c] + said[c])) for c in classes]))
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))
    return ok.groupBy(*by).agg(n.alias("n"), F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"), mean(recalls).alias("balanced_accuracy"), mean(f1).alias("macro_f1"))


def stratified(df: DataFrame, obs: str, pred: str, strata: Mapping[str, Column], metrics: Sequence[str] = ("n", "rmse", "mae", "mbe")) -> DataFrame:
    """(kind, stratum, metrics): overall and by each stratum, each row counted once a kind; one shuffle."""
    parts = [F.struct(F.lit("overall").alias("kind"), F.lit("all").alias("stratum"))]
    parts += [F.struct(F.lit(k).alias("kind"), c.cast("string").alias("stratum")) for k, c in strata.items()]
    long = df.select(F.col(obs).alias("_o"), F.col(pred).alias("_p"), F.inline(F.array(*parts))).where(F.col("stratum").isNotNull())
    return score(long, "_o", "_p", ["kind", "stratum"], metrics, min_pairs=1)


def residual_metrics(df: DataFrame, obs: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Residual spread, slope of best fit, U95, t statistic, Nash-Sutcliffe and Legates efficiency."""
    o, p = _pair(F.col(obs), F.col(pred))
    base = df.select(*by, o.alias("o"), p.alias("p")).where("o IS NOT NULL")
    base = base.withColumn("m", F.avg("o").over(Window.partitionBy(*by)) if by else F.lit(None).cast("double"))
    if not by:
        base = base.drop("m").crossJoin(F.broadcast(base.agg(F.avg("o").alias("m"))))
    e = F.col("p") - F.col("o")
    sd, r, b, n = F.stddev_pop(e), F.sqrt(F.avg(e * e)), F.avg(e), F.count("*")
    return base.groupBy(*by).agg(
        n.alias("n"), sd.alias("sd"), F.regr_slope("p", "o").alias("sbf"), (F.lit(1.96) * F.sqrt(sd * sd + r * r)).alias("u95"),
        F.sqrt(F.try_divide((n - 1) * b * b, r * r - b * b)).alias("ts"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.sum(F.pow(F.col("o") - F.col("m"), 2)))).alias("nse"),
        (F.lit(1.0) - F.try_divide(F.sum(F.abs(e)), F.sum(F.abs(F.col("o") - F.col("m"))))).alias("lce"),
    )


def ks_two_sample(df: DataFrame, obs: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Greatest gap between the two empirical distributions. Distinct values are counted before anything is ordered."""
    values = df.select(*by, F.inline(F.array(F.struct(F.col(obs).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col(pred).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))))).where("v IS NOT NULL")
    points = values.groupBy(*by, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = part.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("a").over(run) / F.sum("a").over(part) - F.sum("b").over(run) / F.sum("b").over(part))
    return points.withColumn("gap", gap).groupBy(*by).agg(F.max("gap").alias("ks"))
