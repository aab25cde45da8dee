"""Appends under lost jobs, replayed batches and concurrent writers."""

import threading

import pytest
from pyspark.sql import functions as F

from mesoflux.sources import commits, publish
from mesoflux.streaming import sensors


def block(spark, names, stamps, value=1.0):
    rows = [(n, s, value) for n in names for s in stamps]
    return spark.createDataFrame(rows, "name string, i int, v double").select("name", F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, i)").alias("ts"), "v")


def keys_of(df):
    return sorted((r.name, r.ts.hour) for r in df.collect())


def test_a_lost_job_leaves_nothing_or_everything(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert publish.append_block(block(spark, "a", range(3)), path, ["name", "ts"])
    more = block(spark, "ab", range(2, 5))

    class Lost(Exception):
        pass

    def lost(*_):
        raise Lost

    monkeypatch.setattr(commits._Folder, "take", lost)  # lost before the commit
    with pytest.raises(Lost):
        publish.append_block(more, path, ["name", "ts"])
    monkeypatch.undo()
    assert keys_of(spark.read.parquet(path)) == keys_of(commits.read(spark, path)) == [("a", 0), ("a", 1), ("a", 2)]

    real, calls = commits.settle, []

    def once(*args):  # lost after the commit, before a file has moved
        calls.append(1)
        if len(calls) > 2:
            raise Lost
        return real(*args)

    monkeypatch.setattr(commits, "settle", once)
    with pytest.raises(Lost):
        publish.append_block(more, path, ["name", "ts"])
    monkeypatch.undo()
    assert len(keys_of(spark.read.parquet(path))) == 3
    whole = [("a", k) for k in range(5)] + [("b", k) for k in range(2, 5)]
    assert keys_of(commits.read(spark, path)) == whole == keys_of(spark.read.parquet(path))
    assert not publish.append_block(more, path, ["name", "ts"])  # sent again after the loss
    assert keys_of(spark.read.parquet(path)) == whole
    assert commits.vacuum(spark, path) == 1 and keys_of(commits.read(spark, path)) == whole


def test_concurrent_writers_leave_each_key_once(spark, tmp_path):
    path, errors = str(tmp_path / "t"), []

    def write(k):
        try:
            publish.append_block(block(spark, "abc"[k % 3 :], range(k, k + 6), float(k)), path, ["name", "ts"])
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    got = keys_of(spark.read.parquet(path))
    assert len(got) == len(set(got)) and set(got) == {(n, s) for k in range(6) for n in "abc"[k % 3 :] for s in range(k, k + 6)}


def test_a_replayed_batch_is_left_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    assert publish.append_block(block(spark, "a", [1]), path, ["name", "ts"], batch=("s", 0))
    assert not publish.append_block(block(spark, "a", [2]), path, ["name", "ts"], batch=("s", 0))  # known by its number, whatever it holds
    assert publish.append_block(block(spark, "a", [2]), path, ["name", "ts"], batch=("other", 0))
    assert not publish.append_block(block(spark, "a", [2]), path, ["name", "ts"], batch=("s", 1))  # nothing new, but remembered
    assert not publish.append_block(block(spark, "a", [3]), path, ["name", "ts"], batch=("s", 1))
    assert keys_of(spark.read.parquet(path)) == [("a", 1), ("a", 2)]


def test_a_stream_that_fails_between_write_and_checkpoint_repeats_no_rows(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    sink, failed = sensors.append_sink(path, ["name", "ts"]), []

    def write(batch, epoch):
        sink(batch, epoch)
        if not failed:
            failed.append(epoch)
            raise RuntimeError("lost")

    def run():
        q = spark.readStream.schema("name string, ts timestamp_ntz, v double").parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception as error:
            assert "lost" in str(error)

    block(spark, "ab", range(4)).write.parquet(source)
    run()
    run()
    block(spark, "abc", range(2, 6)).write.mode("append").parquet(source)
    run()
    assert keys_of(spark.read.parquet(path)) == sorted([(n, s) for n in "ab" for s in range(6)] + [("c", s) for s in range(2, 6)])


def test_rows_of_several_stations_need_the_station_as_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="station"):
        publish.append_block(block(spark, "ab", range(2)), path)
    assert publish.append_block(block(spark, "a", range(2)), path) and not publish.append_block(block(spark, "a", range(2)), path)
    with pytest.raises(ValueError, match="station"):
        publish.append_block(block(spark, "b", range(2)), path)
    assert publish.append_block(block(spark, "b", range(2)), path, ["name", "ts"])
    assert publish.append_block(block(spark, "c", []), str(tmp_path / "new"), ["name", "ts"]) and spark.read.parquet(str(tmp_path / "new")).count() == 0
