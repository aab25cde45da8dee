"""Old point records with rows of two widths, sky documents, and streams in panes."""

import datetime as dt
import hashlib
import json
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesoflux.functions import solar
from mesoflux.plans import sky
from mesoflux.sources import old_record
from mesoflux.streaming import sensors

T0 = dt.datetime(2024, 1, 1)
SIGMA = 5.670374419e-08


def line(width=35, **cells):
    row = ["2022", "1", "1", "0"] + [""] * 31
    for name, value in cells.items():
        if name in old_record.OLD:
            row[old_record.OLD.index(name)] = str(value)
    if width == 47:
        row += [""] * 10 + [str(cells.get("swup", "")), str(cells.get("lwup", ""))]
    return ",".join(row + [""] * (width - len(row)))


def record(folder, *lines, header=",".join(old_record.OLD)):
    folder.mkdir(exist_ok=True)
    path = folder / "record.csv"
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def old_longwave(t, eps):
    return f"{(eps - 273.15) * SIGMA * t**4:.4f}"


def test_old_rows_of_both_widths_are_repaired_and_counted(spark, tmp_path):
    source = record(
        tmp_path / "a",
        line(T="25.0", Swdw="100", Swup_calc="-27295.0", Lwup_calc=old_longwave(25, 0.9), EMISS="-272.25", ALBD="-272.95", q="15", pressure="1000", es="3000", Lwdw_glw="400", TSM=" 7"),
        "",
        line(47, T="20.0", Swdw="10", swup="-2729.5", lwup=old_longwave(20, 0.88), Lwdw_glw="380"),
        line(T="nan", Swdw="5", Lwdw_glw="0", H="", LE="3.5", EMISS="-272.25", q="", pressure="1000"),
    )
    target = str(tmp_path / "new")
    report = old_record.migrate_old_record(spark, source, target)
    assert (report.rows, report.recovered) == (3, 2)
    assert report.repaired == {"albedo": 1, "emissivity": 2, "swup_w_m2": 2, "lwup_air_w_m2": 2, "e_hpa": 1, "rh_pct": 1}
    assert report.blanked == {"swdown_w_m2": 1, "glw_w_m2": 1, "lh_w_m2": 1, "emissivity": 1}
    a, b, c = sorted(spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(target).collect(), key=lambda r: -float(r.glw_w_m2))
    e = 0.015 * 1000 / (0.622 + 0.015)
    assert (a.albedo, a.emissivity, a.swup_w_m2, a.lwup_air_w_m2) == ("0.2000", "0.9000", "20.0000", f"{0.9 * SIGMA * 298.15**4:.4f}")
    assert float(a.e_hpa) == pytest.approx(e, abs=1e-3) and float(a.rh_pct) == pytest.approx(100 * e * 100 / 3000, abs=0.1)
    assert a.sst_c == " 7" and a.t2_c == "25.0" and a.precip_mm == "nan"  # text that no rule touches stays
    assert (b.swup_w_m2, b.lwup_air_w_m2, b.emissivity) == ("2.0000", f"{0.88 * SIGMA * 293.15**4:.4f}", None)
    assert (c.swdown_w_m2, c.glw_w_m2, c.lh_w_m2, c.emissivity, c.hfx_w_m2, c.t2_c) == ("nan", "nan", "nan", "nan", None, "nan")


def test_old_records_that_are_none_fail(spark, tmp_path):
    with pytest.raises(Exception, match="36 fields"):
        old_record.read_old_record(spark, record(tmp_path / "a", line(36))).collect()
    with pytest.raises(Exception, match="does not explain"):
        old_record.repaired_record(old_record.read_old_record(spark, record(tmp_path / "b", line(T="25", Lwup_calc="300")))).collect()
    with pytest.raises(ValueError, match="already"):
        old_record.read_old_record(spark, record(tmp_path / "c", header=",".join([*old_record.OLD_TO_NEW.values(), "precip_mm"])))
    with pytest.raises(ValueError, match="once"):
        old_record.read_old_record(spark, record(tmp_path / "d", line(), header="a,b"))
    empty = old_record.migrate_old_record(spark, record(tmp_path / "e"), str(tmp_path / "none"))
    assert (empty.rows, empty.recovered, empty.repaired) == (0, 0, {})


def test_cumulative_document(spark):
    values = [-0.1, 0.0, 0.019, 0.35, 0.36, 0.65, 0.66, 1.0, 1.3, None, float("nan")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, kt double")
    (row,) = sky.cumulative_documents(df, {"all": ("All", F.lit(True)), "odd": ("Odd", F.col("k") % 2 == 1), "none": ("None", F.col("k") < 0)}).collect()
    doc = json.loads(row.value)
    all_, odd, none = (doc["subsets"][k] for k in ("all", "odd", "none"))
    known = np.array([v for v in values if v is not None and v == v])
    counts = np.histogram(known, sky.EDGES)[0]
    assert all_["counts"] == counts.tolist() and (all_["n"], all_["below"], all_["above"]) == (9, 1, 1)
    assert all_["cumulative"] == pytest.approx([round(c / 9, 6) for c in counts.cumsum()])
    assert [c["count"] for c in all_["sky_conditions"]["conditions"]] == [4, 1, 1, 3]
    assert all_["sky_conditions"]["conditions"][3]["kt_range"] == [0.65, None]
    assert odd["n"] == 4 and list(doc["subsets"]) == ["all", "odd", "none"]
    assert none["n"] == 0 and none["cumulative"] == [] and none["sky_conditions"]["conditions"][0]["fraction"] is None


def test_ktkd_document_is_bounded_and_its_points_do_not_hang_on_partitions(spark):
    rng = np.random.default_rng(3)
    kt, kd = rng.uniform(0, 1.1, 3000), rng.uniform(0, 1.1, 3000)
    kt[:1000], kd[:1000] = 0.5, 0.5  # a third of all rows in one cell
    rows = [(T0 + dt.timedelta(hours=int(k)), float(x), float(y), float(x) / 2 if k % 7 else None) for k, (x, y) in enumerate(zip(kt, kd))]
    rows.append((T0, None, 0.3, 0.1))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, kt double, kd double, half double").withColumn("mf", solar.marques_filho(F.col("kt")))
    edges = [0.0, 0.25, 0.5, 0.75, 1.0]
    made = lambda d: json.loads(sky.ktkd_document(d, {"curve": ("mf", solar.marques_filho)}, {"half": "half"}, edges, 30, 5, {"station": "x"}).first().value)
    doc = made(df)
    again = made(df.repartition(7))
    assert all(doc[k] == again[k] for k in ("points", "density", "models", "period")) and doc["station"] == "x" and doc["period"]["n"] == 3000
    counts = np.histogram2d(kd, kt, (edges, edges))[0]
    assert doc["density"]["counts"] == counts.astype(int).tolist()
    score = {s["id"]: s for s in doc["scores"]}
    own = np.array([k % 7 != 0 for k in range(3000)])
    gap = (kt / 2 - kd)[own]
    assert score["half"]["n"] == own.sum() and score["half"]["rmse"] == pytest.approx(np.sqrt((gap**2).mean())) and score["half"]["mbe"] == pytest.approx(gap.mean())
    bands = {m["id"]: m for m in doc["models"]}
    inside = own & (kt >= 0.25) & (kt < 0.5)
    assert bands["half"]["bins"][1]["p90"] == pytest.approx(np.percentile(kt[inside] / 2, 90)) and bands["half"]["bins"][1]["n"] == inside.sum()
    assert bands["curve"]["bins"][2]["median"] == pytest.approx(0.13 + 0.86 / (1 + np.exp(-6.29 + 12.26 * 0.625)))
    cell = [(hashlib.md5(str(int((T0 - dt.datetime(1970, 1, 1)).total_seconds() + 3600 * k) * 10**6).encode()).hexdigest(), k) for k in range(3000) if 0.5 <= kt[k] < 0.75 and 0.5 <= kd[k] < 0.75]
    want = {(T0 + dt.timedelta(hours=k)).isoformat() for _, k in sorted(cell)[:5]}
    assert len(doc["points"]) == 5 * 16 and want <= {p[2] for p in doc["points"]}
    with pytest.raises(ValueError, match="no hour"):
        sky.ktkd_document(df.where("kt > 9"), {}, {}, edges)


def test_both_sky_documents_of_an_hourly_table(spark):
    df = spark.createDataFrame([(T0 + dt.timedelta(hours=h), max(0.0, float(800 * np.sin((h % 24 - 5.5) / 12 * np.pi))), 150.0 if h % 5 else None) for h in range(24 * 20)], "ts timestamp_ntz, Sw_dw double, Sw_dif double")
    docs = sky.sky_documents(df, solar.Site(-13.0, -38.5, -3.0))
    wide, pairs = (json.loads(docs[k].first().value) for k in ("kt_cumulative", "ktkd"))
    assert wide["subsets"]["observed_all"]["n"] > pairs["period"]["n"] > 100 and wide["subsets"]["observed_jja"]["n"] == 0
    assert {s["id"] for s in pairs["scores"]} == {"marques_filho_2016", "lemos_2017", "ridley_brl_2010"}


def test_runs_of_a_batch_equal_those_of_single_rows():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2, 400).astype(float)
    values[rng.random(400) < 0.1] = np.nan
    micros = np.cumsum(np.where(rng.random(400) < 0.9, 300, 299)) * 10**6
    want, last, at, run = [], float("nan"), None, 0
    for v, t in zip(values, micros):
        run = 0 if np.isnan(v) else run + 1 if v == last and at is not None and t - at == 300 * 10**6 else 1
        want.append(run)
        last, at = v, t
    assert sensors._runs(values, micros, float("nan"), None, 0, 300 * 10**6).tolist() == want
    for cut in (1, 7, 123, 399):
        second = sensors._runs(values[cut:], micros[cut:], values[cut - 1], int(micros[cut - 1]), want[cut - 1], 300 * 10**6)
        assert second.tolist() == want[cut:]


def drain(out, path, mode="append"):
    q = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-ck").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stuck_runs_cross_batches_and_idle_stations_lose_their_state(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "station string, ts timestamp_ntz, v double"
    for b in range(4):  # station a goes on for all batches, b stops after the first
        rows = [("a", T0 + dt.timedelta(minutes=5 * (12 * b + k)), 1.0) for k in range(12)] + ([("b", T0 + dt.timedelta(minutes=5 * k), 2.0) for k in range(12)] if b == 0 else [])
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = drain(sensors.stream_stuck(feed, "v", 6, "station", idle="30 minutes", lateness="1 minute"), str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {r.station: (r.n, r.top) for r in found.groupBy("station").agg(F.count("*").alias("n"), F.max("run").alias("top")).collect()} == {"a": (42, 48), "b": (6, 12)}
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1
    with pytest.raises(ValueError, match="idle"):
        sensors.stream_stuck(feed, "v", 6, "station", idle="1 minute")


def test_panes_bound_the_states_of_a_sliding_monitor(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(k % 2, T0 + dt.timedelta(seconds=20 * k), float(k % 97) if k % 11 else None) for k in range(4320 * 2)]
    df = spark.createDataFrame(rows, "station int, ts timestamp_ntz, v double")
    df.coalesce(1).write.parquet(folder)
    feed = spark.readStream.schema(df.schema).parquet(folder)
    q = drain(sensors.rolling_monitor(feed, ["v"], ["station"], span="1 day", every="1 hour", lateness="0 seconds"), str(tmp_path / "out"))
    got = {(r.station, r.ts): (r.v_mean, r.v_min, r.v_max) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for (station, end), (mean, low, high) in got.items():
        values = [v for s, t, v in rows if s == station and end - dt.timedelta(days=1) <= t < end and v is not None]
        assert (mean, low, high) == (pytest.approx(np.mean(values)), min(values), max(values))
    assert len(got) == 2 * 47
    updated = [op["numRowsUpdated"] for p in q.recentProgress for op in p["stateOperators"]]
    assert sum(updated) <= 2 * 48 * (1 + 24) * 2  # by panes, where samples alone would make 2 * 4320 * 24


def test_clear_sky_in_steps_is_the_expression(spark):
    from mesoflux.operators import dataset

    site = solar.Site(-13.0, -38.5, -3.0)
    df = spark.createDataFrame([(k, T0 + dt.timedelta(minutes=37 * k)) for k in range(60)], "k int, ts timestamp_ntz")
    for target in ("kt", "kstar"):
        got = {r.k: r.clear_sky for r in dataset.with_clear_sky(df, site, target).collect()}
        want = {r.k: r.c for r in df.select("k", solar.clear_sky_reference(F.col("ts"), site, target).alias("c")).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) if want[k] is not None else got[k] is None for k in got)
    with pytest.raises(ValueError, match="reference"):
        dataset.with_clear_sky(df, site, "rain")


def test_a_report_of_two_targets(spark, tmp_path):
    from mesoflux.plans import evaluation

    rows = [(T0 + dt.timedelta(hours=h), str(1 + h // 24), float(h), float(h) + 1, 1.0, None, "test" if h < 48 else "train") for h in range(72)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, day_id string, obs_dhi double, pred_dhi double, obs_kt double, pred_kt double, split string")
    paths = evaluation.write_evaluation_report(df, ["dhi", "kt"], str(tmp_path / "r"), solar.Site(-13.0, -38.5, -3.0), split="test", facts={"model": "m"})
    assert set(paths) == {"metrics", "stratified", "predictions"}  # no classes, no confusion
    doc = json.loads(spark.read.text(paths["metrics"]).first().value)
    assert (doc["split"], doc["n_samples"], doc["model"]) == ("test", 48, "m") and doc["global"]["dhi"]["scores"]["mbe"] == 1.0
    assert doc["global"]["kt"]["scores"]["n"] == 0 and doc["global"]["kt"]["scores"]["rmse"] is None
    assert doc["global"]["dhi"]["persistence"]["n"] == 46 and doc["global"]["dhi"]["persistence"]["skill"] == pytest.approx(0.0)
    strata = spark.read.option("header", True).csv(paths["stratified"]).collect()
    assert strata[0].kind == "overall" and spark.read.parquet(paths["predictions"]).count() == 48
    with pytest.raises(Exception, match="exists"):
        evaluation.write_evaluation_report(df, ["dhi"], str(tmp_path / "r"), solar.Site(-13.0, -38.5, -3.0))


def test_old_lines_are_a_file_a_part_with_a_header_each(spark, sf, tmp_path):
    """No exchange and no sort of all rows in one task: as many files as the table has parts."""
    from mesoflux.plans import library5

    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    folder = library5.old_lines(spark, str(tmp_path))
    files = [[r.value for r in spark.read.text(str(p)).collect()] for p in pathlib.Path(folder).glob("part-*")]
    assert len(files) == 3 and all(f[0].startswith("year,month") and sum(x.startswith("year") for x in f) == 1 for f in files)
    assert sum(len(f) - 1 for f in files) == 1000
    assert library5.old_record_changes(spark, str(tmp_path)).where("what = 'rows'").first().n == 1000
