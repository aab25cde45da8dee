"""Operators on hand-made frames: the edge cases that the queries over the given tables don't reach."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesoflux.functions import solar, special
from mesoflux.operators import calibration, dataset, distributions, grid, hourly, joins, metrics, quality, ranks, stats, windows
from mesoflux.plans import pipelines
from mesoflux.sources import catalogue_pages, publish, records
from mesoflux.streaming import sensors

T0 = dt.datetime(2024, 1, 1)
SITE = solar.Site(-13.0, -38.5, -3.0)


def series(spark, values, step=300, column="v", start=T0):
    rows = [(start + dt.timedelta(seconds=step * k), v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, f"ts timestamp_ntz, {column} double")


def column(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


# -- quality control ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("values", "want"), [
    ([1, 1, 50, 1, 1], [1, 1, None, 1, 1]), ([1, 1, 50, 50, 50, 50, 50], [1, 1, 50, 50, 50, 50, 50]), ([1, 1, 50, 50, 2, 1], [1, 1, None, None, 2, 1]),
    ([1, 1, 50, 30, 30], [1, 1, 50, 30, 30]), ([1, 50, 1, 50, 1], [1, None, 1, None, 1]), ([1, None, 50, 1], [1, None, None, 1]), ([5], [5]), ([None, None], [None, None]),
])
def test_step_excursions(spark, values, want):
    df = series(spark, [None if v is None else float(v) for v in values])
    assert column(quality.step_excursions(df, "v", 20.0, 5.0, 3), "v") == want


def test_step_excursions_stop_at_gaps(spark):
    a, b = series(spark, [1.0, 1.0]), series(spark, [50.0, 1.0], start=T0 + dt.timedelta(hours=2))
    assert column(quality.step_excursions(a.unionByName(b), "v", 20.0, 5.0, 3), "v") == [1, 1, 50, 1]


def test_persistent_runs(spark):
    df = series(spark, [1.0, 2.0, 2.0, 2.0, 2.0, 3.0, 3.0, 3.0, None, 3.0])
    assert column(quality.persistent_runs(df, "v", 3), "v") == [1, None, None, None, None, 3, 3, 3, None, 3]


def test_range_gate_is_inclusive_and_skips_absent_columns(spark):
    df = series(spark, [0.0, 10.0, 10.1, None])
    assert column(quality.range_gate(df, [("v", 0, 10), ("w", 0, 1)]), "v") == [0, 10, None, None]
    assert quality.range_violations(df, [("v", 0, 10)]).collect()[0].n == 1


def test_night_checks_and_net_radiation(spark):
    df = series(spark, [100.0] * 12, column="Sw_dw", start=T0).withColumns({"Lw_dw": F.lit(400.0), "Lw_up": F.lit(450.0), "Sw_up": F.lit(10.0)})
    days = quality.night_corrupted_days(df, SITE, ["Sw_dw"])
    assert [r.n for r in days.collect()] == [12]
    assert set(column(quality.mask_days(df, days, ["Sw_dw"]), "Sw_dw")) == {None}
    assert set(column(quality.mask_nocturnal(df, SITE, ["Sw_dw"]), "Sw_dw")) == {None}
    assert set(column(quality.close_net_radiation(df, "net"), "net")) == {40.0}
    assert set(column(quality.close_net_radiation(df, "net", night=F.lit(True)), "net")) == {-50.0}


def test_row_contract_and_dead_channels(spark):
    df = series(spark, [0.0, 0.0, 0.0])
    ok = quality.row_contract(df, 3, "2024-01-01 00:00:00", "2024-01-01 00:10:00").first()
    assert ok.problems == [] and ok.duplicates == 0
    assert len(quality.row_contract(df.unionByName(df), 3, "2024-01-01 00:00:00", "2024-01-02 00:00:00").first().problems) == 4
    assert quality.dead_channels(df, ["v", "w"]) == ["v"]


def test_offsets_atoms_and_last_days(spark):
    df = series(spark, [-1.0] * 40, step=86_400, start=T0)
    got = quality.nocturnal_offsets(df, "v", SITE).collect()
    assert sum(r.n for r in got) == 40 and not any(r.drifts for r in got)
    masked, counts = quality.strip_atoms(df, {"v": F.col("v") == -1, "w": F.lit(True)})
    assert counts.first().removed == 40 and masked.where("v IS NOT NULL").count() == 0
    assert quality.clip_last_days(df, 3).count() == 4


def test_unshaded_diffuse_days(spark):
    rows = [(T0 + dt.timedelta(days=d, minutes=5 * k), 700.0, 630.0 if d in (1, 2, 3) else 70.0) for d in range(6) for k in range(25)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, g double, d double")
    (r,) = quality.unshaded_diffuse_days(df, "d", "g").collect()
    assert (r.first, r["last"], r.days) == (dt.date(2024, 1, 2), dt.date(2024, 1, 4), 3)


# -- calibration ----------------------------------------------------------------------------------------------------------------


def test_calibration_windows_are_inclusive_by_day(spark):
    df = series(spark, [1.0] * 4, step=86_400)
    c = calibration.Calibration
    out = calibration.apply_calibrations(df, [c("v", "2024-01-01", "2024-01-02", 2.0), c("v", "2024-01-04", None, None)])
    assert column(out, "v") == [2, 2, 1, None]
    with pytest.raises(ValueError, match="overlap"):
        calibration.apply_calibrations(df, [c("v", "2024-01-01", "2024-01-02", 2.0), c("v", "2024-01-02", None, 3.0)])
    assert [r.matched for r in calibration.calibration_matches(df, [c("v", "2030-01-01", None, 1.0)]).collect()] == [0]


def test_uncalibrated_windows(spark):
    m = spark.createDataFrame([("a", 0, 100), ("b", 0, 10)], "column string, start int, end int")
    k = spark.createDataFrame([("a", 10, 20), ("a", 15, 40), ("a", 60, 200)], "column string, start int, end int")
    assert sorted((r.gap_start, r.gap_end) for r in calibration.uncalibrated(m, k).collect()) == [(0, 10), (40, 60)]


def test_shade_ring(spark):
    df = series(spark, [10.0, 20.0])
    factors = series(spark, [1.5, 2.0], column="fc")
    assert column(calibration.shade_ring(df, factors, "v"), "v") == [15, 40]
    with pytest.raises(Exception, match="no shade-ring factor"):
        calibration.shade_ring(df, factors.limit(1), "v").collect()


# -- aggregation and joins --------------------------------------------------------------------------------------------------------


def test_hourly_minimum_and_empty_windows(spark):
    df = series(spark, [1.0] * 12).unionByName(series(spark, [3.0] * 5, start=T0 + dt.timedelta(hours=3)))
    assert column(hourly.aggregate_hourly(df, ["v"]), "v") == [1, None, None, None]
    assert column(hourly.aggregate_hourly(df, ["v"], sums=["v"], min_samples=1), "v") == [12, None, None, 15]


def test_direction_means_straddle_north_and_fall_back(spark):
    rows = [(T0 + dt.timedelta(minutes=5 * k), 350.0 if k % 2 else 10.0, None) for k in range(12)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, d double, s double")
    (r,) = hourly.aggregate_hourly(df, [], directions=["d"], speeds={"d": "s"}).collect()
    assert min(r.d, 360 - r.d) < 1e-9
    calm = df.withColumn("d", F.when(F.minute("ts") % 10 == 0, 0.0).otherwise(180.0))
    assert calm.count() and abs((hourly.aggregate_hourly(calm, [], directions=["d"]).first().d or 0) % 360) >= 0


def test_regular_grid_fails_off_the_cadence(spark):
    df = series(spark, [1.0, 2.0], step=600)
    assert column(hourly.regular_grid(df, "5 minutes"), "v") == [1, None, 2]
    with pytest.raises(Exception, match="off the grid"):
        hourly.regular_grid(df.unionByName(series(spark, [9.0], start=T0 + dt.timedelta(seconds=7))), "5 minutes").collect()


def test_asof_ties_tolerance_and_no_partner(spark):
    left = series(spark, [1.0, 2.0, 3.0], step=3600, column="x")
    right = spark.createDataFrame([(T0 - dt.timedelta(minutes=10), 7.0), (T0 + dt.timedelta(minutes=10), 8.0), (T0 + dt.timedelta(minutes=91), 9.0)], "ts timestamp_ntz, x double")
    got = joins.asof_nearest(left, right, [], tolerance="30 minutes").orderBy("ts").collect()
    assert [(r.x_obs, r.x_model) for r in got] == [(1, 7), (2, None), (3, 9)]
    assert [r.x_model for r in joins.asof_nearest(left, right.limit(0), []).collect()] == [None] * 3


def test_interval_join_paths_agree(spark):
    rows = spark.createDataFrame([(k % 3, T0 + dt.timedelta(hours=k)) for k in range(200)], "k int, ts timestamp_ntz")
    rules = spark.createDataFrame([(k % 3, T0 + dt.timedelta(hours=7 * k), T0 + dt.timedelta(hours=7 * k + 30), k) for k in range(20)], "k int, start timestamp_ntz, end timestamp_ntz, rule int")
    a = joins.interval_join(rows, rules, "k").select("ts", "rule").collect()
    b = joins.interval_join(rows, rules, "k", max_rules=1, bucket_days=1).select("ts", "rule").collect()
    assert sorted(a) == sorted(b) and a


def test_outer_merge_labels_and_pending_work(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(2, 5), (3, 6)], "k int, b int")
    assert [(r.k, r.a, r.b) for r in joins.ordered_outer_merge([a, b], ["k"]).collect()] == [(1, "x", None), (2, "y", 5), (3, None, 6)]
    days = spark.createDataFrame([("d1",), ("d2",)], "day_key string")
    ledger = spark.createDataFrame([("d1", "extract", "s=1", None)], "day_key string, kind string, params string, destination string")
    wanted = spark.createDataFrame([("extract", "s=1", None), ("upload", "", "r")], "kind string, params string, destination string")
    assert sorted((r.day_key, r.kind) for r in joins.pending_work(days, ledger, wanted).collect()) == [("d1", "upload"), ("d2", "extract"), ("d2", "upload")]


# -- statistics, metrics, distributions --------------------------------------------------------------------------------------------


def test_metrics_ignore_what_is_not_finite_and_need_spread(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, float("nan")), (float("inf"), 3.0), (1.0, None)], "x_obs double, x_model double")
    (r,) = metrics.paired_table(df, ["x"]).collect()
    assert r.n == 1 and r.rmse is None
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "x_obs double, x_model double")
    (r,) = metrics.paired_table(flat, ["x"]).collect()
    assert (r.n, r.rmse, r.r2, r.r) == (2, 1.0, None, None)


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 1.0, 2.0, 2.5)], "v double")
    rows = stats.histogram(df, "v", [0, 1, 2]).orderBy("bin").collect()
    assert [(r.n, r.below, r.above) for r in rows] == [(1, 1, 1), (2, 1, 1)]


def test_special_functions():
    assert special.digamma(1.0) == pytest.approx(-0.5772156649015329)
    assert special.trigamma(1.0) == pytest.approx(math.pi**2 / 6)
    assert special.gamma_cdf(1.0, [0.5, 3.0]) == pytest.approx([1 - math.exp(-0.5), 1 - math.exp(-3.0)])
    assert special.beta_cdf(2.0, 2.0, [0.25, 0.9]) == pytest.approx([3 * 0.25**2 - 2 * 0.25**3, 3 * 0.81 - 2 * 0.729])
    assert special.bessel_ratio(1.0) == pytest.approx(0.4463899658965345)


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(11)
    rows = [(rng.weibullvariate(2.4, 1.9), rng.gauss(26, 1.9), rng.gammavariate(2.0, 3.0), rng.betavariate(5, 2), math.degrees(rng.vonmisesvariate(math.radians(90 if k % 3 else 270), 6)) % 360) for k in range(6000)]
    return spark.createDataFrame(rows, "w double, n double, g double, b double, d double").cache()


@pytest.mark.parametrize(("family", "col", "want"), [("weibull", "w", {"shape": 1.9, "scale": 2.4}), ("normal", "n", {"mean": 26, "std": 1.9}), ("gamma", "g", {"shape": 2, "scale": 3}), ("beta", "b", {"a": 5, "b": 2})])
def test_fits_recover_parameters(samples, family, col, want):
    import numpy as np

    fit = distributions.fit_distribution(samples, col, family)
    for k, v in want.items():
        assert fit.params[k] == pytest.approx(v, rel=0.08)
    q = np.array([0.05, 0.5, 0.95])
    assert distributions.cdf(fit, distributions.ppf(fit, q)) == pytest.approx(q, abs=1e-6)
    x = np.linspace(*distributions.ppf(fit, [0.0005, 0.9995]), 4001)
    assert np.trapezoid(distributions.pdf(fit, x), x) == pytest.approx(0.999, abs=2e-3)
    good = distributions.goodness_of_fit(samples, col, fit).first()
    assert good.n == 6000 and good.ks < 0.03


def test_mixtures_and_induced_laws(samples, spark):
    import numpy as np

    m = distributions.fit_von_mises_mixture(samples, "d")
    assert m["weights"] == pytest.approx([2 / 3, 1 / 3], abs=0.05) and m["mu"] == pytest.approx([90, 270], abs=3)
    assert distributions.von_mises_pdf(m, np.arange(360) + 0.5).sum() == pytest.approx(1, abs=1e-3)
    kt = samples.select((F.col("b") * 0.8).alias("kt"))
    h = distributions.fit_distribution(kt, "kt", "hollands_huget")
    c = distributions.fit_distribution(kt, "kt", "compound_hollands", lam=h.params["lambda"], kt_max=h.params["kt_max"], scales=[500.0, 900.0], weights=[0.5, 0.5])
    x = np.linspace(0, 900, 4001)
    assert np.trapezoid(distributions.pdf(c, x), x) == pytest.approx(1, abs=1e-3)
    flux = spark.createDataFrame([(5.67e-8 * random.Random(k).gauss(295 if k % 2 else 280, 2) ** 4,) for k in range(3000)], "f double")
    p = distributions.fit_distribution(flux, "f", "power_normal_mixture", components=2)
    assert p.params["mu"] == pytest.approx([280, 295], abs=0.5)
    g = distributions.fit_distribution(kt, "kt", "gaussian_compound", lam=h.params["lambda"], kt_max=h.params["kt_max"], scales=[900.0], weights=[1.0], slope=0.7, intercept=-20.0, residual_sd=15.0)
    x = np.linspace(-200, 800, 1201)
    assert np.trapezoid(distributions.pdf(g, x), x) == pytest.approx(1, abs=2e-3)
    with pytest.raises(ValueError, match="unknown family"):
        distributions.fit_distribution(kt, "kt", "cauchy")


# -- sequences ----------------------------------------------------------------------------------------------------------------------


def test_repair_stamps(spark):
    rows = [(k, None if k in (1, 2) else T0 + dt.timedelta(minutes=5 * k), "x") for k in range(5)]
    df = spark.createDataFrame(rows, "i int, ts timestamp_ntz, v string")
    assert column(windows.repair_stamps(df, "i"), "ts", "i") == [T0 + dt.timedelta(minutes=5 * k) for k in range(5)]
    with pytest.raises(Exception, match="too many"):
        windows.repair_stamps(df.withColumn("ts", F.when(F.col("i") == 0, F.col("ts"))), "i").collect()


def test_shares_of_a_split_are_decimal(spark):
    df = series(spark, [float(k) for k in range(90)])
    got = [r.split for r in windows.chronological_split(df).orderBy("ts").collect()]  # 0.7 * 90 is 62.99... in doubles
    assert [got.count(k) for k in ("train", "val", "test")] == [63, 13, 14]


def test_scalers_splits_and_padding(spark):
    df = series(spark, [float(k) for k in range(10)]).withColumn("flat", F.lit(1.0)).withColumn("gone", F.when(F.col("v") < 2, F.col("v")))
    s = windows.fit_scaler(df, ["v", "flat", "gone"], max_null=0.5)
    assert s.dropped == ("gone",) and s.scale["flat"] == 1.0
    assert column(windows.inverse(windows.transform(df, s), s), "v") == pytest.approx([float(k) for k in range(10)])
    assert [r.split for r in windows.chronological_split(df).orderBy("ts").collect()] == ["train"] * 7 + ["val"] + ["test"] * 2
    one = spark.range(1).select(F.array(F.array(F.lit(1.0).cast("float"))).alias("m"))
    padded, mask = windows.pad_sequence(F.col("m"), 3, 1)
    r = one.select(padded.alias("p"), mask.alias("k")).first()
    assert ([x[0] for x in r.p], r.k) == ([0, 0, 1], [0, 0, 1])
    with pytest.raises(ValueError, match="finite"):
        windows.fit_normalizer(df.withColumn("v", F.lit(float("nan"))), ["v"])


# -- grids ----------------------------------------------------------------------------------------------------------------------------


def test_vertical_interpolation_extrapolates(spark):
    rows = [("D", 0, 0, 0, h, 2.0 * h) for h in (100.0, 10.0, 50.0)] + [("D", 0, 0, 1, 30.0, 7.0)]
    df = spark.createDataFrame(rows, "domain string, step int, y int, x int, h double, v double")
    for target in (5.0, 10.0, 20.0, 75.0, 150.0):
        got = {r.x: r.v for r in grid.vertical_interpolate(df, "v", "h", target).collect()}
        assert got == {0: pytest.approx(2 * target), 1: 7.0}


def test_sea_level_pressure_of_a_standard_column(spark):
    rows = []
    for k in range(12):
        z = 20.0 + 250.0 * k
        t = 288.15 - 0.0065 * z
        rows.append(("D", 0, 0, 0, k, 101325 * (t / 288.15) ** 5.2559, z, t, 0.0))
    df = spark.createDataFrame(rows, "domain string, step int, y int, x int, level int, p double, z double, tk double, qv double")
    assert grid.sea_level_pressure(df).first().slp == pytest.approx(1013.25, abs=0.3)
    with pytest.raises(Exception, match="100 hPa"):
        grid.sea_level_pressure(df.where("level < 2")).collect()


def test_smoothing_keeps_a_constant_field_and_total(spark):
    rows = [("D", 0, y, x, 5.0, 1.0 if (y, x) == (4, 4) else 0.0) for y in range(9) for x in range(8)]
    df = spark.createDataFrame(rows, "domain string, step int, y int, x int, c double, p double")
    assert {round(r.c, 9) for r in grid.smooth(df, "c").collect()} == {5.0}
    out = {(r.y, r.x): r.p for r in grid.smooth(df, "p").collect()}
    assert sum(out.values()) == pytest.approx(1.0) and max(out, key=out.get) == (4, 4)


def test_cells_payloads_and_availability(spark):
    cells = spark.createDataFrame([("D", y, x, -40.0 + x, -10.0 + 2.0 * y) for y in range(3) for x in range(3)], "domain string, y int, x int, lon double, lat double")
    r = {(c.y, c.x): c for c in publish.grid_cells(cells).collect()}
    assert (r[0, 0].west, r[0, 0].east, r[2, 2].north, r[1, 1].separable) == (-40.5, -39.5, -5.0, True)
    steps = spark.createDataFrame([("a", s) for s in (1, 2, 3, 7)] + [("b", s) for s in (2, 3, 4)], "var string, step int")
    assert sorted((x.var, x.first, x["last"]) for x in publish.availability(steps, ["var"]).collect()) == [("a", 1, 3), ("a", 7, 7), ("b", 2, 4)]
    assert tuple(publish.common_range(steps, "var").first()) == (2, 3)
    field = cells.selectExpr("domain", "0 as step", "y", "x", "cast(CASE WHEN x = 0 THEN NULL ELSE y + x END AS double) AS v")
    assert publish.cell_series(field, "v").where("y = 0 AND x = 0").first().series == [-(2**31)]
    bounds = spark.createDataFrame([("D", 0.0, 5.0)], "domain string, scale_min double, scale_max double")
    assert publish.step_values(field, "v", bounds).first().scale == [0, 1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="too large"):
        publish.cell_series(field.withColumn("v", F.lit(1e9)), "v").collect()


def test_cold_start_rain_and_catalogue(spark):
    rows = [("D", s, 0, 0, 0.0 if s == 0 else 400.0, 300.0, 101000.0, 0.015, 3.0, -4.0, 100.0 * s) for s in range(3)]
    df = spark.createDataFrame(rows, "domain string, step int, y int, x int, GLW double, T2 double, PSFC double, Q2 double, U10 double, V10 double, RAINC double")
    assert [r.T2 for r in grid.blank_cold_start(df, ["T2"]).orderBy("step").collect()] == [None, 300, 300]
    assert [r.RAINC for r in grid.rain_increment(df, "RAINC").orderBy("step").collect()] == [None, 100, 100]
    r = grid.operational_columns(df, ["step"]).orderBy("step").collect()
    assert r[0].Lwdw_glw is None and r[1].WS == 5.0 and r[1].H is None
    with pytest.raises(ValueError, match="unknown"):
        grid.operational_columns(df, ["step"], ["nope"])


# -- sources, sinks, streams ------------------------------------------------------------------------------------------------------------


def toa5(path, columns, rows):
    head = ['"TOA5","s"', ",".join(f'"{c}"' for c in columns), ",".join('""' for _ in columns), ",".join('""' for _ in columns)]
    path.write_text("\n".join([*head, *[",".join(r) for r in rows]]) + "\n")
    return str(path)


def test_logger_files(spark, tmp_path):
    a = toa5(tmp_path / "a.dat", ["TIMESTAMP", "RECORD", "T", "S"], [['"2024-01-01 00:00:00"', "1", "20.5", '"OK"'], ['"2024-01-01 00:05:00"', "2", '"NAN"', '"OK"'], ['"2024-01-01 00:05:00"', "3", "99", '"Unknown Fault"'], ['"2024-01-01 00:10:00"', "4", "-999", '"OK"']])
    b = toa5(tmp_path / "b.dat", ["TIMESTAMP", "RECORD", "T", "U"], [['"2024-01-01 00:05:00"', "1", "21", "5"], ['"2024-01-01 00:15:00"', "2", "22", "6"]])
    one = records.read_toa5(spark, a, text_columns=["S"])
    assert [(r["T"], r.S) for r in one.orderBy("ts").collect()] == [(20.5, "OK"), (None, "OK"), (None, "OK")]
    merged = records.merge_sources([one, records.read_toa5(spark, b)])
    assert [(r["T"], r.U) for r in merged.orderBy("ts").collect()] == [(20.5, None), (21, 5), (None, None), (22, 6)]
    assert records.scan_directory(spark, str(tmp_path)).count() == 4
    fixed = records.apply_repair(one, records.Repair(shift_until="2024-01-01 00:00:00", drop_from="2024-01-01 00:10:00"))
    assert column(fixed, "ts") == [dt.datetime(2024, 1, 1, 0, 5)]
    bad = tmp_path / "c.dat"
    bad.write_text("1,2\n3,4\n")
    with pytest.raises(ValueError, match="no TIMESTAMP"):
        records.read_toa5(spark, str(bad))


def test_model_records_station_lists_and_rules(spark, tmp_path):
    (tmp_path / "m.csv").write_text("year,month,day,hour,T2,ALBD\n2024,1,1,0,20,1\n2024,1,1,0,21,1\n2024,1,1,21,5,1\n")
    m = records.read_model_record(spark, str(tmp_path / "m.csv"), {"T2": "T"})
    assert [(r.ts, r["T"]) for r in m.collect()] == [(T0, 21.0)]
    (tmp_path / "s.txt").write_text("# list\nname,lat,lon\nabc,-12.9,-38.4\n")
    assert records.read_station_list(spark, str(tmp_path / "s.txt")).first().name == "abc"
    (tmp_path / "t.txt").write_text("abc:95:0\n")
    with pytest.raises(Exception, match="bad station"):
        records.read_station_list(spark, str(tmp_path / "t.txt")).collect()
    (tmp_path / "r.yaml").write_text("ranges:\n  - {column: T, lower: 0, upper: 50}\n")
    rules = records.load_rules(spark, str(tmp_path / "r.yaml"))
    assert rules["ranges"].first().upper == 50 and rules["switches"].count() == 0
    assert records.load_rules(spark, str(tmp_path / "none.yaml"))["ranges"].count() == 0


def test_catalogue_days_skip_impossible_dates(spark):
    pages = spark.createDataFrame([(1, "x sky-20240131.mp4 sky-20240231.mp4"), (2, "sky-20240131.mp4 sky-20240202.mp4"), (3, None)], "page_id int, html string")
    assert sorted(str(r.day) for r in catalogue_pages.catalog_days(pages).collect()) == ["2024-01-31", "2024-02-02"]


def test_sinks(spark, tmp_path):
    df = series(spark, [1.0, None], step=3600)
    publish.export_csv(df, str(tmp_path / "csv"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "csv")).collect())[:2] == ["2024,1,1,0,1.000", "2024,1,1,1,nan"]
    with pytest.raises(Exception, match="whole hours"):
        publish.export_csv(series(spark, [1.0, 2.0]), str(tmp_path / "bad"))
    table = str(tmp_path / "table")
    assert publish.append_block(df, table) and not publish.append_block(df, table) and publish.append_block(df, table, force=True)
    with pytest.raises(ValueError, match="evolve"):
        publish.append_block(df.withColumn("w", F.lit(1)), table)
    assert publish.evolve_schema(df, df.withColumn("w", F.lit(1)), ["w"]).columns == ["ts", "v", "w"]
    assert publish.save_guarded(df, str(tmp_path / "g"), ["ts"]) and not publish.save_guarded(df, str(tmp_path / "g"), ["ts"])
    with pytest.raises(ValueError, match="another version"):
        publish.save_guarded(df.limit(1), str(tmp_path / "g"), ["ts"])
    built = []
    build = lambda: built.append(1) or (df, ["ts"])
    assert [publish.rebuild_if_changed({"x": (x, ["ts"])}, str(tmp_path / "r"), build) for x in (df, df, df.limit(1))] == [True, False, True] and len(built) == 2
    assert publish.load_verified(spark, str(tmp_path / "g")).count() == 2
    df.limit(1).write.mode("append").parquet(str(tmp_path / "g"))
    with pytest.raises(ValueError, match="holds"):
        publish.load_verified(spark, str(tmp_path / "g"))
    doc = publish.monitoring_payload(series(spark, [1.26, float("nan")], step=600), {"v": "C"}, "5 minutes").first().value
    assert '"count":3' in doc and '"v":[1.3,null,null]' in doc


def test_blocks_of_a_second_station_are_appended(spark, tmp_path):
    a = series(spark, [1.0, 2.0]).withColumn("name", F.lit("a"))
    path, sink = str(tmp_path / "t"), str(tmp_path / "s")
    assert publish.append_block(a, path, ["name", "ts"])
    both = a.unionByName(a.withColumn("name", F.lit("b")))
    assert publish.append_block(both, path, ["name", "ts"]) and not publish.append_block(both, path, ["name", "ts"])
    write = sensors.append_sink(sink, ["name", "ts"])
    for epoch, batch in enumerate((a, a.unionByName(a), both, both)):
        write(batch, epoch)
    for t in (path, sink):
        assert sorted((r.name, r.v) for r in spark.read.parquet(t).collect()) == [("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0)]


def test_vectors_have_row_major_indices(spark):
    cells = spark.range(64).selectExpr("'D' AS domain", "0 AS step", "id div 8 AS y", "id % 8 AS x", "1.0D AS u", "0.0D AS v")
    (row,) = publish.vector_overlay(cells, "u", "v").collect()
    assert [r["index"] for r in row.vectors] == [0, 4, 32, 36]


def test_ranks_in_ranges_equal_those_of_one_sort(spark):
    rows = [(k % 3 if k % 50 else None, (k * 7919 % 1000) / 10.0 if k % 11 else 5.0, k) for k in range(3000)] + [(0, None, -1), (0, 1e9, -2)]
    df = spark.createDataFrame(rows, "g int, v double, k long")
    shares = (0.0, 0.01, 0.5, 0.98, 1.0)
    for by in ([], ["g"]):
        a, b = [{tuple(r[c] for c in by): [round(x, 9) for x in r.q] for r in ranks.quantiles(df, "v", shares, by, whole=w).collect()} for w in (10**9, 10)]
        assert a == b
        a, b = [sorted((r.g is None, r.g or 0, r._rank, r.v, r._n) for r in ranks.ranked(df, "v", by, whole=w).collect()) for w in (10**9, 10)]
        assert a == b
        a, b = [{r.k: r.v_prev for r in ranks.previous(df, ["v"], "k", by, whole=w).collect()} for w in (10**9, 10)]
        assert a == b and len(a) == len(rows)
    tiles = [r.t for r in ranks.ranked(spark.range(103).withColumn("v", F.col("id")), "v").select(ranks.tile(10).alias("t"), "_rank").orderBy("_rank").collect()]
    assert tiles == [r.t for r in spark.sql("SELECT ntile(10) OVER (ORDER BY id) AS t FROM range(103) ORDER BY id").collect()]


def test_one_long_series_is_worked_on_in_linear_time(spark):
    import time

    n = 200_000
    base = spark.range(n).selectExpr("1 AS k", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 5 * id) AS ts", "CASE WHEN id % 10 = 0 THEN CAST(id AS DOUBLE) END AS v")
    began = time.time()
    filled = windows.interpolate_time(base, "v", ["k"])
    assert filled.where("v IS NOT NULL").count() == n - 9
    right = base.where("v IS NOT NULL").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))
    assert joins.asof_nearest(base, right, ["k"], tolerance="2 minutes").where("gap_seconds IS NOT NULL").count() == n // 10
    assert time.time() - began < 60  # the frame that shrinks from its far end took minutes


def test_step_excursions_match_a_plain_walk(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(12):
        t, v = 0, []
        for i in range(60):
            t += rng.choice([300, 300, 300, 600, 900])
            v.append((t, rng.choice([0, 1, 2, 40, 41, 90]) if rng.random() < 0.4 else 1))
        bad, i = [False] * 60, 1
        for i in range(1, 60):
            near = lambda j: 0 < v[j][0] - v[j - 1][0] <= 600
            if near(i) and abs(v[i][1] - v[i - 1][1]) > 20 and not bad[i - 1]:
                for j in range(i + 1, min(60, i + 4)):
                    if not near(j):
                        break
                    back = v[j][1] - v[j - 1][1]
                    if abs(back) > 20 and back * (v[i][1] - v[i - 1][1]) < 0 and abs(v[j][1] - v[i - 1][1]) <= 5:
                        bad[i:j] = [True] * (j - i)
                        break
        rows += [(k, 2**53 + 1 + i, T0 + dt.timedelta(seconds=t), float(x)) for i, (t, x) in enumerate(v)]
        want |= {(k, 2**53 + 1 + i): None if b else float(x) for i, ((_, x), b) in enumerate(zip(v, bad))}
    df = spark.createDataFrame(rows, "k int, n long, ts timestamp_ntz, v double")
    got = quality.step_excursions(df, "v", 20.0, 5.0, 3, ["k"]).collect()
    assert {(r.k, r.n): r.v for r in got} == want and None in want.values()


def test_streams(spark, tmp_path):
    df = series(spark, [5.0] * 8 + [6.0] * 40).withColumn("station", F.lit("s"))
    source = str(tmp_path / "in")
    df.coalesce(1).write.parquet(source)
    feed = spark.readStream.schema(df.schema).parquet(source)

    def run(out, name, mode="append"):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    gated = sensors.stream_gate(feed, [("v", 0, 5.5)])
    assert len([r for r in run(gated, "gated") if r.v is None]) == 40
    hours = run(sensors.stream_hourly(feed, ["v"], ["station"], lateness="1 minute"), "hours")
    assert {round(r.v, 4) for r in hours} >= {round((5 * 8 + 6 * 4) / 12, 4)}
    stuck = run(sensors.stream_stuck(feed, "v", 6, "station"), "stuck")
    assert len(stuck) == 2 + 34
    q = feed.writeStream.foreachBatch(sensors.append_sink(str(tmp_path / "sink"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    sensors.append_sink(str(tmp_path / "sink"))(df, 1)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 48
    assert run(sensors.rolling_monitor(feed, ["v"], ["station"], span="1 hour", every="30 minutes", lateness="1 minute"), "monitor")


# -- manifest and pipelines -----------------------------------------------------------------------------------------------------------------


def test_manifest_and_validation(spark):
    noon = T0 + dt.timedelta(hours=11)
    sensor = spark.createDataFrame([(noon + dt.timedelta(minutes=5 * k), 28.0, 20.0, 70.0, 1010.0, 3.0, 90.0, 800.0, 200.0 if k % 2 else None) for k in range(6)], "ts timestamp_ntz, AirT1_C_Avg double, DP1_C_Avg double, RH1 double, BP1_mbar_Avg double, WS_ms double, WindDir double, CM3Up_Wm2_Avg double, PSP_Wm2_Avg double")
    frames = spark.createDataFrame([(f"a/{k}.png", noon + dt.timedelta(minutes=5 * k, seconds=20), "v", k) for k in range(4)] + [("b/0.png", noon + dt.timedelta(seconds=20), "v", 0), ("c/0.png", T0, "v", 9)], "frame_path string, ts timestamp_ntz, video string, index long")
    m = dataset.build_manifest(frames, sensor, SITE)
    rows = m.orderBy("ts").collect()
    assert [r.sample_id for r in rows] == [f"sky-20240101-11{5 * k:02d}" for k in range(4)]
    assert [r.target_source for r in rows] == ["erbs", "measured"] * 2 and all(r.qc_flags == 0 for r in rows)
    features = [c for c in dataset.feature_columns(sensor, SITE)]
    assert dataset.validate_manifest(m, features).count() == 0
    broken = m.unionByName(m.limit(1)).withColumn("sky_class", F.lit(9))
    assert {r.check for r in dataset.validate_manifest(broken, features).collect()} >= {"duplicate sample_id", "sky_class out of domain"}
    pred = m.select("ts", "day_id", F.col("target_dhi").alias("obs_dhi"), (F.col("target_dhi") + 1).alias("pred_dhi"))
    out = dataset.evaluate_predictions(pred, "dhi", SITE)
    assert out["strata"].where("kind = 'overall'").first().mbe == pytest.approx(1.0)


def test_station_archive_end_to_end(spark):
    rows = [(T0 + dt.timedelta(minutes=5 * k), 25.0 + 0.01 * (k % 7), 300.0 if 84 <= k < 192 else 0.0, 1.0, 100.0) for k in range(288)]
    raw = spark.createDataFrame(rows, "ts timestamp_ntz, T double, Sw_dw double, RECORD double, WD double")
    raw = raw.withColumn("T", F.when(F.minute("ts") == 15, 99.0).otherwise(F.col("T")))
    rules = pipelines.ArchiveRules(ranges=[("T", -10, 60)], calibrations=[calibration.Calibration("Sw_dw", None, None, 1.5)], directions={"WD": "WS"})
    out = pipelines.build_station_archive(raw, rules, SITE)
    h = out["hourly"].orderBy("ts").collect()
    assert len(h) == 24 and h[0].Sw_dw is None and h[12].Sw_dw == 450.0 and "RECORD" not in out["hourly"].columns
    assert all(x["T"] < 26 and x.WD == pytest.approx(100) for x in h)


def test_compare_runs(spark):
    a = series(spark, [1.0, 2.0, 3.0], step=3600, column="T")
    (r,) = pipelines.compare_runs(a, a.withColumn("T", F.col("T") + 0.5)).collect()
    assert (r.n, r.mbe) == (3, 0.5)
    with pytest.raises(ValueError, match="in common"):
        pipelines.compare_runs(a, a.withColumnRenamed("T", "U"))


def test_ktkd_and_plausibility(spark):
    rows = [(T0 + dt.timedelta(hours=k), 600.0 if 8 <= k % 24 <= 15 else 0.0, 150.0, 0.0) for k in range(72)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, Sw_dw double, Sw_dif double, precip double")
    t = pipelines.ktkd_table(df, SITE)
    assert t.count() == 24 and t.where("kd <> 0.25 OR psi IS NULL OR daily_kt IS NULL").count() == 0
    p = pipelines.radiation_plausibility(df, SITE).first()
    assert p["all"] == 72 and p.rain == 72 and p.diffuse_change <= p.elevation < 72


def test_nearest_cell_takes_any_number_of_points_and_repeated_ones(spark):
    cells = spark.range(400).selectExpr("id % 20 AS y", "id div 20 AS x", "(id * 7 % 101) / 10.0D AS lat", "(id * 11 % 103) / 10.0D AS lon")
    sites = [(r.lat, r.lon, r.y, r.x) for r in cells.collect()]
    places = [((k * 37 % 100) / 10.0, (k * 53 % 97) / 10.0) for k in range(40)] + [(-30.0, 5.0), (300.0, -70.0), (1.0, 1.0), (1.0, 1.0)]
    got = joins.nearest_cell(spark.createDataFrame(places, "lat double, lon double"), cells, outside="nearest").collect()
    assert len(got) == len(places)
    for r in got:
        assert (r.y, r.x) == min((((a - r.lat) ** 2 + (o - r.lon) ** 2) ** 0.5, y, x) for a, o, y, x in sites)[1:]
    with pytest.raises(Exception, match="outside the grid"):
        joins.nearest_cell(spark.createDataFrame(places, "lat double, lon double"), cells).collect()
    many = spark.range(100_500).selectExpr("id", "id % 100 / 10.0D AS lat", "id % 70 / 10.0D AS lon")
    assert joins.nearest_cell(many, cells).where("y IS NOT NULL").count() == 100_500


def test_scaler_learns_from_the_decimal_share(spark):
    """63 of 90 rows teach it: 0.7 * 90 is 62.99... in doubles."""
    _, scaler = windows.split_and_scale(series(spark, [float(k) for k in range(90)]), [], "v")
    assert scaler.centre["v"] == 31.0


def test_stations_of_one_folder_may_share_a_stamp(spark, tmp_path):
    toa5(tmp_path / "a.dat", ["TIMESTAMP", "RECORD", "T"], [['"2024-01-01 00:00:00"', "7", "1"], ['"2024-01-01 00:00:00"', "8", '"NAN"'], ['"2024-01-01 00:00:00"', "7", "9"]])
    toa5(tmp_path / "b.dat", ["TIMESTAMP", "RECORD", "T"], [['"2024-01-01 00:00:00"', "8", "3"]])
    got = records.scan_directory(spark, str(tmp_path), keys=["RECORD"])
    assert sorted((r.RECORD, r["T"]) for r in got.collect()) == [("7", 1.0), ("8", 3.0)]
    toa5(tmp_path / "c.dat", ["TIMESTAMP", "T"], [['"2024-01-01 00:00:00"', "3"]])
    with pytest.raises(ValueError, match="keys"):
        records.scan_directory(spark, str(tmp_path), keys=["RECORD"])


def test_a_stamp_is_a_duplicate_within_a_station(spark):
    rows = [(f"e{k}", T0, "20240101", 0, "v2", 1.0, k // 2) for k in range(4)]
    m = spark.createDataFrame(rows, "sample_id string, timestamp_utc timestamp_ntz, day_id string, qc_flags int, dataset_version string, f double, station int").withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp"))
    found = lambda df, keys: [(r.check, r.n, r["sample"]) for r in dataset.validate_manifest(df, ["f"], keys=keys).collect()]
    assert found(m, []) == [("duplicate timestamp_utc", 1, "e0")]
    assert found(m, ["station"]) == [("duplicate timestamp_utc", 2, "e0")]
    assert found(m.dropDuplicates(["station"]), ["station"]) == []


def test_daylight_compiles_and_equals_the_expression(spark):
    """The single expression is interpreted; in steps each generator has a compiled stage of its own."""
    df = spark.range(72).select((F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"))
    both = quality.with_daylight(df, SITE).withColumn("same", quality.daylight_selection(F.col("ts"), SITE)).collect()
    assert {r.part for r in both} == {"day", "night", None} and all(r.part == r.same for r in both)
    sines = quality.with_daylight(df, SITE)._jdf.queryExecution().executedPlan().toString().count("ASIN(")
    assert sines == 3


def test_one_logger_file_in_parts(spark, tmp_path):
    folder = tmp_path / "one"
    folder.mkdir()
    toa5(folder / "part-0", ["TIMESTAMP", "RECORD", "T"], [['"2024-01-01 00:00:00"', "1", "1"]])
    (folder / "part-1").write_text('"2024-01-01 00:00:00",2,8\n"2024-01-01 00:05:00",3,2\n')
    (folder / "part-2").write_text('"2024-01-01 00:05:00",4,9\n' * 3000)  # the longest part is read first
    assert [r["T"] for r in records.read_toa5(spark, str(folder)).orderBy("ts").collect()] == [1.0, 2.0]


def test_repeated_values_are_counted_before_they_are_ordered(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(7)) / 2.0).alias("v"))
    want, got = ({r.g: r.q for r in ranks.quantiles(df, "v", (0.0, 0.1, 0.5, 0.9, 1.0), ["g"], whole=w).collect()} for w in (10**9, 100))
    assert got == want
    for whole in (10**9, 3):
        c = ranks.counted(df, "v", ["g"], whole)
        assert c.count() == 14 and all(r._before + r._m <= r._n == 1000 for r in c.collect())
    plan = ranks.quantiles(df, "v", (0.5,), ["g"], whole=100)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan  # no window over the rows themselves


def test_an_evaluation_computes_its_references_once(spark):
    rows = [(T0 + dt.timedelta(hours=k), "20240101", float(k), k + 1.0, k % 4, (k + 1) % 4) for k in range(24)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, day_id string, obs_dhi double, pred_dhi double, obs_sky int, pred_sky int")
    out = dataset.evaluate_predictions(df, "dhi", SITE)
    plans = {k: v._jdf.queryExecution().executedPlan().toString() for k, v in out.items()}
    assert len(plans) == 5 and not any("ASIN(" in p or "lag(" in p or "Generate explode(array(struct(_g" in p for p in plans.values())
    assert out["persistence"].first().n == 23 and out["strata"].where("kind = 'hour'").count() == 24


def test_quantiles_of_a_law_take_few_values_of_its_distribution_function(spark, monkeypatch):
    seen, q = [], (np.arange(5000) + 0.5) / 5000
    real = distributions.cdf
    monkeypatch.setattr(distributions, "cdf", lambda fit, x: seen.append(np.size(x)) or real(fit, x))
    for family, params in (("normal", {"mean": 55000.0, "std": 20000.0}), ("gamma", {"shape": 2.5, "scale": 3.0})):
        seen.clear()
        fit = distributions.Fit(family, params, 10)
        got = distributions.ppf(fit, q)
        assert sum(seen) < 20 * len(q)  # over a hundred by bisection alone
        assert got[::50] == pytest.approx(distributions._bisected(fit, q[::50], -1e6 if family == "normal" else 0.0, 1e6, 120), rel=1e-12)


def test_fit_of_repeated_values_judges_every_rank(spark):
    v = np.repeat([1.0, 2.0, 3.5, 5.0], [3, 40, 50, 7])
    fit = distributions.Fit("normal", {"mean": 3.0, "std": 1.0}, 100)
    got = distributions.goodness_of_fit(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", fit).first()
    gap = np.abs(v - distributions.ppf(fit, (np.arange(100) + 0.5) / 100)).mean()
    model = distributions.cdf(fit, v)
    assert (got.n, got.quantile_gap) == (100, pytest.approx(gap)) and got.ks == pytest.approx(max(np.abs((np.arange(100) + 1) / 100 - model).max(), np.abs(model - np.arange(100) / 100).max()))
