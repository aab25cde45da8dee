"""Every registered query with SQL gives DuckDB's rows on the smallest tables; each of them runs."""

import glob
import math
import os

import duckdb
import pytest

from mesoflux.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if hasattr(v, "isoformat"):
        return str(v).replace(" 00:00:00", "")
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalogue.ORACLE:
        assert rows
        return
    cur = duck.execute(catalogue.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cur.fetchall())
    assert rows == want


def test_entry_survives_without_the_training_data_package(spark, monkeypatch):
    import sys

    import __spark_entry__

    for gone in ("mesoflux.llm", "mesoflux.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, gone, None)
    monkeypatch.delattr(sys.modules["mesoflux"], "llm", raising=False)
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(catalogue.ORACLE)
