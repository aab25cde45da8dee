"""Series cut into ranges of time give the rows that whole series give."""

import random
import time

import pytest
from pyspark.sql import functions as F

from mesoflux.functions.solar import Site
from mesoflux.operators import joins, quality, segments, windows
from mesoflux.plans import pipelines


def excursions_brute(values, threshold, tol, max_len):
    """Sample by sample over a series without gaps."""
    out, i, n = list(values), 1, len(values)
    while i < n:
        end = None
        if abs(values[i] - values[i - 1]) > threshold:
            for d in range(1, max_len + 1):
                if i + d < n and abs(values[i + d] - values[i + d - 1]) > threshold and (values[i + d] - values[i + d - 1]) * (values[i] - values[i - 1]) < 0 and abs(values[i + d] - values[i - 1]) <= tol:
                    end = i + d
                    break
        if end:
            out[i:end] = [None] * (end - i)
            i = end
        i += 1
    return out


def series(spark, values, keys=("a",), gaps=()):
    stamp = "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, {} * 5)"
    rows = [(k, i, v) for k in keys for i, v in enumerate(values) if i not in gaps]
    return spark.createDataFrame(rows, "k string, i int, v double").withColumn("ts", F.expr(stamp.format("i")))


def values_of(df):
    return [r.v for r in df.orderBy("ts").collect()]


@pytest.mark.parametrize("seed", range(3))
def test_excursions_are_settled_in_order_on_noisy_series(spark, seed):
    rnd = random.Random(seed)
    values = [float(rnd.choice([0, 0, 0, 10, 10, 25])) for _ in range(400)]
    assert values_of(quality.step_excursions(series(spark, values), "v", 5.0, 2.0, 3)) == excursions_brute(values, 5.0, 2.0, 3)


def test_excursions_over_batches_and_keys(spark):
    values = [10.0 if i % 3 == 0 else 0.0 for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = quality.step_excursions(series(spark, values, "abc"), "v", 5.0, 2.0, 3, ["k"])
        for k in "abc":
            assert values_of(got.where(F.col("k") == k)) == excursions_brute(values, 5.0, 2.0, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_million_noisy_samples_take_seconds(spark):
    df = spark.range(1_000_000).select((F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 5).cast("int"))).alias("ts"), F.when(F.col("id") % 3 == 0, 10.0).otherwise(0.0).alias("v"))
    began = time.time()
    n = quality.step_excursions(df, "v", 5.0, 2.0, 3).agg(F.count("v")).first()[0]
    assert time.time() - began < 60 and 0 < n < 1_000_000


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_scan_over_ranges_equals_whole_series(spark, keys):
    rnd = random.Random(7)
    values = []
    for _ in range(60):  # calm stretches, noise, stuck values; many lie over an edge
        kind = rnd.randrange(3)
        values += [20 + rnd.random() for _ in range(40)] if kind == 0 else [float(rnd.choice([0, 10])) for _ in range(25)] if kind == 1 else [7.5] * rnd.randrange(1, 40)
    df = series(spark, values, "ab" if keys else "a", gaps=set(rnd.sample(range(len(values)), 30)))

    def run(rows, by):
        return quality.persistent_runs(quality.step_excursions(rows, "v", 5.0, 2.0, 3, by), "i", 3, by)

    marked = df.withColumn("i", F.floor(F.col("i") / 6).cast("int"))
    whole = {(r.k, r.ts): (r.v, r.i) for r in run(marked, list(keys)).collect()}
    cut = segments.scan(marked, run, keys, before=300.0 * 10, after=300.0 * 10, calm=[("v", 5.0, 3)], rows=100, look=300.0 * 40)
    got = {(r.k, r.ts): (r.v, r.i) for r in cut.collect()}
    assert cut.columns == marked.columns and got == whole and cut.count() == len(whole)
    assert segments.edges(marked, "ts", 100)  # it was cut


def test_a_series_without_a_calm_place_stays_whole(spark):
    values = [10.0 if i % 3 == 0 else 0.0 for i in range(900)]
    df = series(spark, values)
    got = segments.scan(df, lambda rows, by: quality.step_excursions(rows, "v", 5.0, 2.0, 3, by), before=3000, after=3000, calm=[("v", 5.0, 3)], rows=100)
    assert values_of(got) == excursions_brute(values, 5.0, 2.0, 3)


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_filled_values_are_carried_over_ranges(spark, keys):
    rnd = random.Random(8)
    values = [rnd.choice([None, None, None, float(i)]) for i in range(50)] + [None] * 200 + [3.0] + [None] * 40
    df = series(spark, values, "ab" if keys else "a")
    df = df.withColumn("v", F.when((F.col("k") == "a") | (F.col("i") > 260), F.col("v")))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(windows.ffill(df, ["v"], keys), windows.ffill(df, ["v"], keys, sliced=20))
    assert same(windows.interpolate_time(df, "v", keys), windows.interpolate_time(df, "v", keys, sliced=20))
    broken = df.withColumn("t", F.when(F.col("i") % 7 != 3, F.col("ts"))).drop("ts")
    assert same(windows.repair_stamps(broken, "i", "t", keys), windows.repair_stamps(broken, "i", "t", keys, sliced=20))


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_asof_over_ranges(spark, keys):
    rnd = random.Random(9)
    left = series(spark, [float(i) for i in range(300)], "ab" if keys else "a", gaps=set(range(40, 90)))
    right = series(spark, [float(-i) for i in range(300)], "ab" if keys else "a", gaps=set(rnd.sample(range(300), 220)))
    right = right.withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 MINUTES"))
    a, b = joins.asof_nearest(left, right, keys, tolerance="2 hours"), joins.asof_nearest(left, right, keys, tolerance="2 hours", sliced=20)
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_the_archive_is_the_same_in_ranges(spark):
    rnd = random.Random(10)
    n = 4000
    stamp = F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, i * 5)")
    rows = [(i, 25 + 3 * rnd.random() + (40 if rnd.random() < 0.02 else 0), 70.0 if i % 50 < 30 else 70 + rnd.random(), 300 * max(0.0, rnd.random() - 0.3)) for i in range(n)]
    df = spark.createDataFrame(rows, "i int, T double, RH double, Sw_dw double").withColumn("ts", stamp).drop("i")
    rules = pipelines.ArchiveRules([], [("T", -10, 80)], [], [("T", 5.0, 3.5, 3)], [("RH", 24), ("T", 5)])
    small, whole = (pipelines.build_station_archive(df, rules, Site(-13.0, -38.5, -3.0), slice_rows=k)["qc"] for k in (400, 10**9))
    assert sorted(map(str, small.collect())) == sorted(map(str, whole.select(*small.columns).collect()))
