"""Sequence operators and machine-learning preparation: lags, windows, splits, scaling, imputation."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import segments


def ordered(keys: Sequence[str], ts: str):
    """Without keys the whole series is one partition; give keys wherever there is more than one series."""
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(ts)


def next_known(value: Column, keys: Sequence[str], order: str) -> Column:
    """The value of this row or the next one that has any. Time runs backwards in the window, so that its frame only grows."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc(order))
    return F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def add_lags(df: DataFrame, columns: Sequence[str], lags: Sequence[int], keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    w = ordered(keys, ts)
    return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags})


def add_rolling(df: DataFrame, columns: Sequence[str], windows: Sequence[int], how: Sequence[str] = ("mean", "std"), keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    make = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}
    out = df.withColumns({f"{c}_roll_{n}_{h}": make[h](c).over(ordered(keys, ts).rowsBetween(-(n - 1), 0)) for c in columns for n in windows for h in how if h != "median"})
    if "median" in how:
        out = rolling_medians(out, columns, windows, keys, ts)
    return out.select(*df.columns, *[f"{c}_roll_{n}_{h}" for c in columns for n in windows for h in how])


def rolling_medians(df: DataFrame, columns: Sequence[str], windows: Sequence[int], keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """``df`` with {column}_roll_{n}_median: the median of the values, nulls left out, of the last n rows; NaN counts as the largest.

    The sorted rows go through one scan that keeps each window in order: a value enters and leaves by binary search, so a row costs the same
    however many it has before it.
    """
    numbered = df.withColumn("_i", F.row_number().over(ordered(keys, ts)))
    wanted, kept = [(c, n) for c in columns for n in windows], list(df.columns)

    def run(batches):
        states: list[tuple[deque, list]] = []
        for b in batches:
            fresh = (b.column("_i").to_numpy(zero_copy_only=False) == 1).tolist()
            values = {c: [math.inf if x is not None and x != x else x for x in b.column(c).cast(pa.float64()).to_pylist()] for c in columns}
            if not states:
                states = [(deque(), []) for _ in wanted]
            made = []
            for (c, n), (last, order) in zip(wanted, states):
                out = []
                for x, first in zip(values[c], fresh):
                    if first:
                        last.clear()
                        order.clear()
                    last.append(x)
                    if x is not None:
                        insort(order, x)
                    if len(last) > n and (gone := last.popleft()) is not None:
                        del order[bisect_left(order, gone)]
                    m = len(order)
                    out.append(None if not m else order[m // 2] if m % 2 else order[m // 2 - 1] + (order[m // 2] - order[m // 2 - 1]) * 0.5)
                made.append(pa.array(out, pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *made], [*kept, *[f"{c}_roll_{n}_median" for c, n in wanted]])

    return numbered.mapInArrow(run, StructType([*df.schema.fields, *[StructField(f"{c}_roll_{n}_median", DoubleType()) for c, n in wanted]]))


def add_diffs(df: DataFrame, columns: Sequence[str], periods: Sequence[int] = (1,), keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    w = ordered(keys, ts)
    return df.withColumns({f"{c}_diff_{p}": F.col(c) - F.lag(c, p).over(w) for c in columns for p in periods})


def centre_shift_rolling(df: DataFrame, column: str, keys: Sequence[str] = (), ts: str = "ts", hours: int = 2) -> DataFrame:
    """Mean of the hours up to each row (left bound open), moved up by one row."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(micros).rangeBetween(-hours * 3_600_000_000 + 1, 0)
    rolled = df.withColumn("_m", F.avg(column).over(span))
    return rolled.withColumn(f"{column}_smooth", F.lead("_m").over(ordered(keys, ts))).drop("_m")


def persistence_reference(df: DataFrame, obs: str, day: str = "day_id", keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    return df.withColumn(f"persistence_{obs}", F.lag(obs).over(Window.partitionBy(*keys, day).orderBy(ts)))


def _gap_seconds(keys: Sequence[str], ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.lag(ts).over(ordered(keys, ts)).cast("timestamp"))


def sequence_targets(df: DataFrame, length: int, keys: Sequence[str] = (), ts: str = "ts", max_gap_seconds: float | None = None) -> DataFrame:
    """``df`` with ``is_target``: the row ends a window of ``length`` rows without a gap.

    A gap is a step above ``max_gap_seconds``, or above the series' median step where none is given.
    """
    w = ordered(keys, ts)
    base = df.withColumn("_d", _gap_seconds(keys, ts))
    if max_gap_seconds is None:
        middle = base.groupBy(*keys).agg(F.percentile("_d", F.lit(0.5)).alias("_limit"))
        base = base.join(middle, list(keys)) if keys else base.crossJoin(F.broadcast(middle))
    else:
        base = base.withColumn("_limit", F.lit(float(max_gap_seconds)))
    base = base.withColumns({"_g": F.coalesce((F.col("_d") > F.col("_limit")).cast("int"), F.lit(0)), "_i": F.row_number().over(w)})
    gaps = F.sum("_g").over(w.rowsBetween(-(length - 2), 0)) if length > 1 else F.lit(0)
    return base.withColumn("is_target", (F.col("_i") >= length) & (gaps == 0)).drop("_d", "_limit", "_g", "_i")


def build_sequences(df: DataFrame, features: Sequence[str], target: str, length: int, keys: Sequence[str] = (), ts: str = "ts", max_gap_seconds: float | None = None) -> DataFrame:
    """(keys, ts, x array<array<float>>, y): windows that are whole and free of gaps and of missing values."""
    row = F.array(*[F.col(c).cast("float") for c in features])
    seqs = sequence_targets(df, length, keys, ts, max_gap_seconds).withColumn("x", F.collect_list(row).over(ordered(keys, ts).rowsBetween(-(length - 1), 0)))
    whole = F.forall("x", lambda r: F.forall(r, lambda v: v.isNotNull()))
    return seqs.where(F.col("is_target") & F.col(target).isNotNull() & whole).select(*keys, ts, "x", F.col(target).cast("float").alias("y"))


def pool_embeddings(df: DataFrame, members: str, out: str = "pooled") -> DataFrame:
    """Mean, place by place, of the vectors in ``members`` (array of arrays); null without any."""
    total = F.aggregate(F.slice(members, 2, 1 << 30), F.transform(F.element_at(members, 1), lambda x: x.cast("double")), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    return df.withColumn(out, F.when(F.size(members) > 0, F.transform(total, lambda x: x / F.size(members))))


def pad_sequence(members: Column, length: int, dim: int) -> tuple[Column, Column]:
    """(padded array of ``length`` vectors, mask): the newest members, zeros in front."""
    newest = F.slice(members, F.greatest(F.size(members) - length + 1, F.lit(1)), length)
    missing = F.greatest(F.lit(length) - F.size(newest), F.lit(0))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return F.concat(F.array_repeat(zero, missing), newest), F.concat(F.array_repeat(F.lit(0), missing), F.array_repeat(F.lit(1), F.size(newest)))


def _known_around(df: DataFrame, known: Column, keys: Sequence[str], order: str, sliced: int | None) -> DataFrame:
    """``df`` with ``_b`` and ``_a``: the last known value up to each row and the next one from it on."""
    if sliced:
        df = segments.cut(df, keys, order, segments.edges(df, order, sliced))
        return segments.carried(segments.carried(df, {"_b": known}, keys, order), {"_a": known}, keys, order, backwards=True).drop("_slice", "_cuts")
    return df.withColumns({"_b": F.last(known, True).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)), "_a": next_known(known, keys, order)})


def interpolate_time(df: DataFrame, column: str, keys: Sequence[str] = (), ts: str = "ts", sliced: int | None = None) -> DataFrame:
    """Linear in time, inside gaps only. ``sliced``: cut long series into ranges of about so many rows."""
    point = F.when(F.col(column).isNotNull(), F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(column).alias("v")))
    base = _known_around(df, point, keys, ts, sliced)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * F.try_divide(t - F.col("_b.t"), F.col("_a.t") - F.col("_b.t"))
    return base.withColumn(column, F.coalesce(column, line)).drop("_a", "_b")


def ffill(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), ts: str = "ts", last: dict | None = None, mean: dict | None = None, sliced: int | None = None) -> DataFrame:
    """Forward fill, then the training set's last value, then its mean. ``sliced``: cut long series into ranges of about so many rows."""
    if sliced:
        base = segments.carried(segments.cut(df, keys, ts, segments.edges(df, ts, sliced)), {c: F.col(c) for c in columns}, keys, ts).select(*df.columns)
    else:
        w = ordered(keys, ts).rowsBetween(Window.unboundedPreceding, 0)
        base = df.withColumns({c: F.last(c, True).over(w) for c in columns})
    fill = lambda c: F.coalesce(F.col(c), F.lit((last or {}).get(c)).cast("double"), F.lit((mean or {}).get(c)).cast("double"))
    return base.withColumns({c: fill(c) for c in columns})


def repair_stamps(df: DataFrame, order: str, ts: str = "ts", keys: Sequence[str] = (), max_missing: float = 0.5, sliced: int | None = None) -> DataFrame:
    """Unreadable stamps interpolated between known neighbours by row position; fails where too many are missing or time runs back.

    ``sliced``: cut long series into ranges of about so many rows of ``order``, a whole number.
    """
    share = df.groupBy(*[F.col(c).alias(f"_g_{c}") for c in keys]).agg(F.avg(F.col(ts).isNull().cast("double")).alias("_share"))
    if sliced:
        base = segments.numbered(segments.cut(df, keys, order, segments.edges(df, order, sliced)), keys, order, "_i")
    else:
        base = df.withColumn("_i", F.row_number().over(ordered(keys, order)))
    known = F.when(F.col(ts).isNotNull(), F.struct(F.col("_i").alias("i"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")))
    base = _known_around(base, known, keys, order, sliced)
    base = base.join(share, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in keys]).drop(*[f"_g_{c}" for c in keys]) if keys else base.crossJoin(F.broadcast(share))  # one row
    at = F.col("_b.t") + (F.col("_a.t") - F.col("_b.t")) * F.try_divide(F.col("_i") - F.col("_b.i"), F.col("_a.i") - F.col("_b.i"))
    fixed = F.coalesce(F.col(ts), F.timestamp_micros(at.cast("long")).cast("timestamp_ntz"))
    base = base.withColumn("_t", fixed)
    if sliced:
        base = segments.shifted(segments.cut(base, keys, order, segments.edges(df, order, sliced)), {"_p": F.col("_t")}, keys, order).drop("_slice", "_cuts")
    else:
        base = base.withColumn("_p", F.lag("_t").over(ordered(keys, order)))
    back = F.col("_t") <= F.col("_p")
    bad = F.when(F.col("_share") > max_missing, F.raise_error(F.lit("too many unreadable stamps")).cast("timestamp_ntz")).when(F.coalesce(back, F.lit(False)), F.raise_error(F.lit("stamps run backwards")).cast("timestamp_ntz"))
    return base.withColumn(ts, F.when((F.col("_share") > max_missing) | F.coalesce(back, F.lit(False)), bad).otherwise(F.col("_t"))).drop("_i", "_a", "_b", "_share", "_t", "_p")


# -- splits ---------------------------------------------------------------------------------------------------------------


def positions(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return df.withColumns({"_pos": F.row_number().over(ordered(keys, ts)) - 1, "_n": F.count("*").over(every)})


def _part(share: float) -> Column:
    """That share of ``_n``, exact for the decimal that the share is written as."""
    return F.col("_n") * F.lit(Decimal(str(share)))


def chronological_split(df: DataFrame, train: float = 0.7, val: float = 0.15, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """``split`` by position in time: train, val, test. Shares are decimals: 0.7 of 90 rows are 63, which as doubles are less."""
    p = positions(df, keys, ts)
    a, b = F.floor(_part(train)), F.floor(_part(train)) + F.floor(_part(val))
    return p.withColumn("split", F.when(F.col("_pos") < a, "train").when(F.col("_pos") < b, "val").otherwise("test")).drop("_pos", "_n")


def expanding_folds(df: DataFrame, folds: int, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """(fold, role, ...): train [0, s), validation [s, s + v) of each fold, by position."""
    p = positions(df, keys, ts).withColumn("_v", F.floor(F.col("_n") / (folds + 1)))
    fold = p.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    start = F.col("fold") * F.col("_v")
    role = F.when(F.col("_pos") < start, "train").when(F.col("_pos") < start + F.col("_v"), "val")
    return fold.withColumn("role", role).where("role IS NOT NULL").drop("_pos", "_n", "_v")


def kfold_time(df: DataFrame, folds: int, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """``fold``: contiguous blocks in time of nearly equal size, larger ones first."""
    return df.withColumn("fold", F.ntile(folds).over(ordered(keys, ts)))


def day_split(df: DataFrame, train: float = 0.7, val: float = 0.15, gap_days: int = 0, seed: int | None = None, ts: str = "ts") -> DataFrame:
    """(day_id, split) of the distinct days: blocks in time with dropped gap days, or a seeded shuffle by hash."""
    days = df.select(F.date_format(ts, "yyyyMMdd").alias("day_id")).distinct()
    order = F.col("day_id") if seed is None else F.xxhash64(F.lit(seed), F.col("day_id"))
    w = Window.partitionBy(F.lit(0))  # over days, some thousands of rows
    p = days.withColumns({"_pos": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    a = F.round(_part(train))
    b = a + F.round(_part(val))
    gap = gap_days if seed is None else 0
    split = F.when(F.col("_pos") < a, "train").when(F.col("_pos") < a + gap, None).when(F.col("_pos") < b, "val").when(F.col("_pos") < b + gap, None).otherwise("test")
    return p.select("day_id", split.alias("split"))


# -- scaling --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scaler:
    """What training rows taught; small enough for literals."""

    kind: str
    centre: dict[str, float]
    scale: dict[str, float]
    null_ratio: dict[str, float]
    dropped: tuple[str, ...] = ()


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str = "standard", max_null: float = 1.0, ddof: int = 1, floor: float = 1e-6) -> Scaler:
    """One aggregate over all columns; columns with too many nulls are dropped, scales under the floor become 1."""
    std = F.stddev_samp if ddof else F.stddev_pop
    aggs = [F.count("*").alias("n")]
    for k, c in enumerate(columns):
        aggs += [F.count(c).alias(f"c{k}"), (F.avg(c) if kind == "standard" else F.min(c)).alias(f"a{k}"), (std(c) if kind == "standard" else F.max(c) - F.min(c)).alias(f"s{k}")]
    row = df.agg(*aggs).first()
    n = row["n"] or 0
    nulls = {c: (1 - row[f"c{k}"] / n if n else 1.0) for k, c in enumerate(columns)}
    kept = [(k, c) for k, c in enumerate(columns) if nulls[c] <= max_null and row[f"a{k}"] is not None]
    scale = {c: (row[f"s{k}"] if row[f"s{k}"] is not None and row[f"s{k}"] > floor else 1.0) for k, c in kept}
    return Scaler(kind, {c: row[f"a{k}"] for k, c in kept}, scale, nulls, tuple(c for c in columns if c not in scale))


def fit_normalizer(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """Mean and population deviation; a non-finite value is an error."""
    bad = df.agg(F.coalesce(F.sum(sum((F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(True)).cast("int") for c in columns), F.lit(0))), F.lit(0))).first()[0]
    if bad:
        raise ValueError(f"{bad} values aren't finite")
    return fit_scaler(df, columns, ddof=0)


def transform(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({c: (F.col(c) - scaler.centre[c]) / scaler.scale[c] for c in scaler.scale}).drop(*scaler.dropped)


def inverse(df: DataFrame, scaler: Scaler, columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: F.col(c) * scaler.scale[c] + scaler.centre[c] for c in (columns or scaler.scale)})


def impute(df: DataFrame, features: Sequence[str], target: str, how: str = "mean", means: dict | None = None) -> DataFrame:
    """Rows without a target go; features are dropped row by row or take the training mean."""
    rows = df.where(F.col(target).isNotNull())
    return rows.na.drop(subset=list(features)) if how == "drop" else rows.withColumns({c: F.coalesce(F.col(c), F.lit((means or {}).get(c)).cast("double")) for c in features})


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """hour, day_of_year, month, weekday (Monday 0)."""
    return df.withColumns({"hour": F.hour(ts), "day_of_year": F.dayofyear(ts), "month": F.month(ts), "weekday": F.weekday(ts)})


def cyclic_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    turn = 2 * 3.141592653589793
    parts = {"hour": (F.hour(ts), 24.0), "doy": (F.dayofyear(ts), 365.25), "month": (F.month(ts), 12.0)}
    return df.withColumns({f"{n}_{f}": fn(F.lit(turn) * c / F.lit(p)) for n, (c, p) in parts.items() for f, fn in (("sin", F.sin), ("cos", F.cos))})


def feature_pipeline(df: DataFrame, columns: Sequence[str], target: str, lags: Sequence[int] = (1,), windows: Sequence[int] = (3,), diffs: Sequence[int] = (1,), keys: Sequence[str] = (), ts: str = "ts") -> tuple[DataFrame, list[str]]:
    """Calendar, cycles, lags, rolling and differences; the target itself only ever enters as a lag."""
    others = [c for c in columns if c != target]
    out = add_lags(cyclic_features(calendar_features(df, ts), ts), columns, lags, keys, ts)
    out = add_diffs(add_rolling(out, others, windows, keys=keys, ts=ts), others, diffs, keys, ts)
    return out, [c for c in out.columns if c not in (*keys, ts, target)]


def tabular_dataset(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(features array<float>, label float) of complete rows."""
    return df.na.drop(subset=[*features, target]).select(F.array(*[F.col(c).cast("float") for c in features]).alias("features"), F.col(target).cast("float").alias("label"))


def split_and_scale(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = (), ts: str = "ts") -> tuple[DataFrame, Scaler]:
    """Chronological split, a scaler taught by the training part alone, everything transformed."""
    cut = chronological_split(df, keys=keys, ts=ts)
    scaler = fit_scaler(cut.where("split = 'train'"), [*features, target])
    return transform(cut, scaler), scaler


def target_means(df: DataFrame, targets: Sequence[str], label: str | None = None, floor: float = 1e-8) -> DataFrame:
    """The climatology baseline: means of the targets, or (class, log_share) of a label."""
    if label is None:
        return df.agg(*[F.avg(t).alias(t) for t in targets])
    counts = df.where(F.col(label) >= 0).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    return counts.select("class", F.log(F.greatest(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), F.lit(floor))).alias("log_share"))


def comparable_rows(df: DataFrame, lengths: dict[str, int], policy: str = "model_native", keys: Sequence[str] = (), ts: str = "ts", max_gap_seconds: float | None = None) -> dict[str, DataFrame]:
    """The rows that each model is scored on. ``lengths``: model -> rows a window of it holds (1: no window).

    ``model_native``: each model on all rows that end a whole window of its own. ``common_sequence_horizon``: all models on the rows
    that end a window of the longest, a semi-join on keys and stamp, so that their scores compare.
    """
    native = {m: sequence_targets(df, n, keys, ts, max_gap_seconds).where("is_target").drop("is_target") for m, n in lengths.items()}
    if policy == "model_native":
        return native
    if policy != "common_sequence_horizon":
        raise ValueError(f"unknown policy {policy!r}")
    longest = native[max(lengths, key=lengths.get)].select(*keys, ts).distinct()
    return {m: rows.join(longest, [*keys, ts], "left_semi") for m, rows in native.items()}
