"""Manifests of logger files and nearest cells of several grids."""

import math

import pytest
from pyspark.sql import functions as F

from mesoflux.operators import joins
from mesoflux.sources.records import Repair, scan_manifest

HEAD = '"TOA5","x"\n"TIMESTAMP","RECORD","{}"\n"TS","RN","C"\n"","","Avg"\n'


def logger(folder, name, column, hours):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEAD.format(column) + "".join(f'"2024-01-01 {h:02}:00:00",{k},{v}\n' for k, (h, v) in enumerate(hours)))


def test_a_manifest_is_one_scan_with_repairs(spark, tmp_path):
    folder = tmp_path / "d 1"  # a blank in the path
    for k in range(40):
        logger(folder, f"f{k}.dat", "T" if k % 2 else "U", [(k % 24, k), (k % 24, 99), ((k + 1) % 24, -950)])
    entries = [{"path": f"f{k}.dat", "repair": Repair(shift_until="2024-01-01 01:00:00") if k == 0 else Repair(keep=("2024-01-01 05:00:00", None)) if k == 1 else None} for k in range(40)]
    got = scan_manifest(spark, entries, str(folder))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") <= 4  # by header lines, not by files
    rows = {r.ts.hour: (r.T, r.U) for r in got.collect()}
    assert rows[1] == (25.0, 0.0)  # file 0, an hour late, before file 24; file 1 has no row that early
    assert rows[5] == (5.0, None) and rows[0] == (None, 24.0) and rows[10] == (None, 10.0) and set(got.columns) == {"ts", "T", "U"}


def test_a_manifest_with_a_wrong_file_fails(spark, tmp_path):
    logger(tmp_path / "d", "a.dat", "T", [(1, 1)])
    (tmp_path / "d" / "bare.dat").write_text('"2024-01-01 00:00:00",1,2\n')
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        scan_manifest(spark, [{"path": "a.dat"}, {"path": "gone.dat"}], str(tmp_path / "d")).collect()
    with pytest.raises(ValueError, match="TIMESTAMP"):
        scan_manifest(spark, [{"path": "a.dat"}, {"path": "bare.dat"}], str(tmp_path / "d"))
    with pytest.raises(ValueError, match="twice"):
        scan_manifest(spark, [{"path": "a.dat"}, {"path": "a.dat"}], str(tmp_path / "d"))


def test_nearest_cells_of_grids_of_different_sizes(spark):
    grids = {"a": (12, 9.0), "b": (60, 0.1), "c": (1, 1.0)}  # cells a side, degrees
    cells = [(g, y, x, y * d, x * d) for g, (n, d) in grids.items() for y in range(n) for x in range(n)]
    points = [(g, ((k * 37) % 101) / 101 * (n - 1) * d, ((k * 53) % 103) / 103 * (n - 1) * d) for g, (n, d) in grids.items() for k in range(30)]
    df = spark.createDataFrame([*points, points[0], ("none", 1.0, 1.0), (None, 1.0, 1.0), ("a", None, 2.0)], "domain string, lat double, lon double")
    at = spark.createDataFrame(cells, "domain string, y long, x long, lat double, lon double")
    got = joins.nearest_cell(df, at, by=["domain"]).collect()
    assert len(got) == len(points) + 4
    for r in got:
        near = [(math.sqrt((c - r.lat) ** 2 + (e - r.lon) ** 2), y, x) for g, y, x, c, e in cells if g == r.domain] if r.lat is not None else []
        assert (r.y, r.x) == (min(near)[1:] if near else (None, None))
    with pytest.raises(Exception, match="outside the grid"):
        joins.nearest_cell(df.withColumn("lat", F.col("lat") + 500), at, by=["domain"]).collect()
    assert joins.nearest_cell(df, at.limit(0), by=["domain"]).where("y IS NOT NULL").count() == 0
