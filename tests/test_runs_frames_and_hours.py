"""Steps of gridded runs, rule files, frames on disk, hours from tables and from folders."""

import datetime as dt
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesoflux.operators import calibration, distributions, quality
from mesoflux.plans import library6, pipelines
from mesoflux.sources import records

T0 = dt.datetime(2024, 1, 1)


def steps(spark, rows):
    return spark.createDataFrame(rows, "domain string, step int, valid_time timestamp_ntz")


def test_steps_keep_their_places_and_the_first_are_marked(spark):
    rows = [("D01", k, T0 + dt.timedelta(hours=k)) for k in (0, 1, 1, 2)] + [("D02", k, T0 + dt.timedelta(hours=3 * k)) for k in (4, 5)] + [("D02", 6, None)]
    got = {(r.domain, r.step): r for r in records.run_steps(steps(spark, rows), skip_first=1).collect()}
    assert len(got) == 6
    assert [k for k, r in sorted(got.items()) if r.skip] == [("D01", 0), ("D02", 4)]
    one = got["D01", 2]
    assert one.name_suffix == "D01_002" and one.local_time == T0 - dt.timedelta(hours=1)
    assert one.caption == "Início Análise: 01/01/2024 00 (UTC)\nPrevisão: 31/12/2023 23HL (Domingo)"
    assert got["D02", 6].valid_time is None and got["D02", 6].caption is None
    assert records.run_steps(steps(spark, [])).count() == 0


def test_a_step_with_two_times_fails(spark):
    with pytest.raises(Exception, match="a step with several times: D01 3"):
        records.run_steps(steps(spark, [("D01", 3, T0), ("D01", 3, T0 + dt.timedelta(hours=1))])).collect()


def test_blocks_and_days_of_runs(spark, tmp_path):
    path = str(tmp_path / "g")
    steps(spark, [("D01", k, T0) for k in range(4)]).selectExpr("*", "0 AS y", "0 AS x").write.partitionBy("domain", "step").parquet(path)
    assert records.scan_grid(spark, path, "D01", (2, 99)).count() == 2
    for block in ((-1, 2), (2, 2), (3, 1)):
        with pytest.raises(ValueError, match="no block"):
            records.scan_grid(spark, path, steps=block)
    assert records.run_day("2026-07-27") == records.run_day("2026/07/27") == records.run_day("2026072718") == "20260727"
    for bad in ("2026-7-27", "tomorrow", "", "2026072x"):
        with pytest.raises(ValueError, match="yyyyMMdd"):
            records.run_day(bad)
    runs = spark.createDataFrame([("D01", "a"), ("D01", "b")], "domain string, run string")
    with pytest.raises(ValueError, match="2 runs"):
        records.one_run_per_domain(runs)


def test_a_missing_rule_file_warns(spark, tmp_path):
    with pytest.warns(UserWarning, match="no rules at"):
        assert all(t.count() == 0 for t in records.load_rules(spark, str(tmp_path / "none.yaml")).values())
    (tmp_path / "bad.yaml").write_text("rangs: []\n")
    with pytest.raises(ValueError, match="unknown rule tables"):
        records.load_rules(spark, str(tmp_path / "bad.yaml"))


def bmp(path, pixels):
    """``pixels``: rows of (blue, green, red)."""
    h, w = len(pixels), len(pixels[0])
    pad = b"\0" * (-3 * w % 4)
    body = b"".join(b"".join(bytes(p) for p in row) + pad for row in reversed(pixels))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body)


def test_frames_on_disk(spark, tmp_path):
    root = tmp_path / "run-20991231"  # digits of the root are no day
    bmp(root / "20240105" / "frame_0.bmp", [[(1, 2, 3)] * 3] * 2)
    bmp(root / "20240105" / "frame_12.bmp", [[(90, 120, 60)] * 3] * 2)
    bmp(root / "20240106" / "frame_3.bmp", [[(255, 255, 255)] * 3, [(100, 50, 200)] * 3])
    bmp(root / "20241399" / "frame_4.bmp", [[(255, 255, 255)]])
    bmp(root / "other" / "frame_5.bmp", [[(0, 0, 0)]])
    rows = {(r.video, r["index"]): r.timestamp for r in records.scan_frames(spark, str(root), 2.5, start_hour=6, pattern="*.bmp").collect()}
    day = dt.datetime(2024, 1, 5, 6)
    assert rows == {("20240105", 0): day, ("20240105", 12): day + dt.timedelta(minutes=30), ("20240106", 3): day + dt.timedelta(days=1, minutes=7, seconds=30), ("20241399", 4): None}
    images = spark.read.format("image").option("pathGlobFilter", "*.bmp").option("recursiveFileLookup", True).load(str(root))
    none = images.limit(1).select(F.struct(F.lit("lost").alias("origin"), *[F.lit(-1).alias(c) for c in ("height", "width", "nChannels", "mode")], F.unhex(F.lit("")).alias("data")).alias("image"))
    got = {r.origin.rsplit("/", 2)[-1]: r for r in quality.frame_visual_qc(images.unionByName(none)).collect()}
    assert {k: r.flag for k, r in got.items()} == {"frame_0.bmp": "dark", "frame_12.bmp": "ok", "frame_3.bmp": "saturated", "frame_4.bmp": "saturated", "frame_5.bmp": "dark", "lost": "unreadable"}
    assert got["frame_12.bmp"].luminance == pytest.approx(0.114 * 90 + 0.587 * 120 + 0.299 * 60)
    assert got["frame_3.bmp"].saturated == 0.5 and got["lost"].luminance is None


def logger_file(path, rows):
    heads = ['"TOA5","x"', '"TIMESTAMP","RECORD","T","U"', '"TS","RN","C","W"', '"","","Avg","Avg"']
    path.write_text("\n".join([*heads, *[f'"{t:%Y-%m-%d %H:%M:%S}",{k},{a},{b}' for k, (t, a, b) in enumerate(rows)]]) + "\n")


def test_hours_from_a_folder_and_from_tables(spark, tmp_path):
    at = [T0 + dt.timedelta(minutes=20 * k) for k in range(7)]
    logger_file(tmp_path / "a.dat", [(t, k, 2 * k) for k, t in enumerate(at[:4])])
    logger_file(tmp_path / "b.dat", [(t, k + 4, '"NAN"') for k, t in enumerate(at[4:])])
    cal = [calibration.Calibration("T", None, None, 2.0)]
    hours = pipelines.load_station_hourly(spark, str(tmp_path), calibrations=cal, min_samples=3)
    assert [(r.ts.hour, r.T, r.U) for r in hours.orderBy("ts").collect()] == [(0, 2.0, 2.0), (1, 8.0, None), (2, None, None)]
    assert pipelines.load_station_hourly(spark, str(tmp_path), freq=None).count() == 7
    with pytest.raises(ValueError, match="no \\*.txt"):
        pipelines.load_station_hourly(spark, str(tmp_path), pattern="*.txt")

    (tmp_path / "h.csv").write_text("when,T,U\n2024-01-01 02:00:00,3,x\n2024-01-01 01:00:00,2.5,7\nnever,9,9\n")
    one = pipelines.load_station_hourly(spark, str(tmp_path / "h.csv"), types={"U": "long"})
    assert sorted(tuple(r) for r in one.collect())[0] == (T0 + dt.timedelta(hours=1), 2.5, 7) and one.where("U IS NULL").count() == 1 and one.count() == 2
    path = str(tmp_path / "h.parquet")
    one.withColumnRenamed("ts", "when").write.parquet(path)
    table = pipelines.load_station_hourly(spark, path, columns=["T"], limit=1, calibrations=cal)
    assert [tuple(r) for r in table.collect()] == [(T0 + dt.timedelta(hours=1), 2.5)]


def test_windows_off_the_hour_are_not_exported(spark, tmp_path):
    logger_file(tmp_path / "a.dat", [(T0 + dt.timedelta(minutes=5 * k), k, k) for k in range(12)])
    with pytest.raises(Exception, match="whole hours"):
        pipelines.process_sensor_folder(spark, str(tmp_path), str(tmp_path / "out"), freq="30 minutes", min_samples=1)


def test_stations_that_share_a_stamp_all_count_and_a_mean_is_rounded_once(spark, tmp_path):
    at = T0 + dt.timedelta(minutes=5)
    rows = [(0, at, 1, "click", 2.0000004998), (1, at, 2, "click", 2.0000005), (2, at + dt.timedelta(hours=1), 1, "view", 10.0), (3, at + dt.timedelta(hours=1), 1, "view", 30.0), (4, at + dt.timedelta(hours=1), 7, "view", 50.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = library6.sensor_folder_processed(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.ts.hour, r.click, r.view, r.gated) for r in got] == [(0, 2.0, None, 2.0), (1, None, 33.0, 30.0)]
    loaded = library6.station_hours_loaded(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.ts.hour, r.click, r.view, r.gated) for r in loaded] == [(0, None, None, None), (1, None, 33.0, 30.0)]


def test_law_of_clearness_found_again(spark):
    lam, top = 3.0, 0.9
    x = np.linspace(0, top, 20001)
    density = (1 - x / top) * np.exp(lam * x)
    cdf = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    sample = np.interp((np.arange(20000) + 0.5) / 20000, cdf / cdf[-1], x)
    df = spark.createDataFrame([(float(v),) for v in sample] + [(None,), (-0.1,)], "kt double")
    assert distributions.fit_hollands_huget(df, "kt", top)["lambda"] == pytest.approx(lam, abs=0.01)
    drawn = distributions.fit_hollands_huget(df, "kt")
    assert drawn["kt_max"] == pytest.approx(np.quantile(sample, 0.995)) and drawn["lambda"] > lam
    assert math.isnan(distributions.fit_hollands_huget(df.where("kt IS NULL"), "kt")["lambda"])
