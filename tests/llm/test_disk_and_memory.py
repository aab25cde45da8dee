"""What written tables leave on disk and what a tokenizing task holds."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mesoflux.llm import _common, packing, queries


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    made = _common.materialize(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count(), "sweep")
    until = time.time() + 5
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and made.count() == 5000
    assert spark.conf.get(_common._SWEEP) == "false"


def test_batches_of_a_written_table_are_bounded(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    wide = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert _common.materialize(wide.mapInArrow(sizes, "n long"), "batches", batch_bytes=200_000).agg(F.max("n")).first()[0] < 400_000


def test_tokenizing_holds_a_bounded_slice_and_bounded_words(monkeypatch):
    texts = [f"word{k} don't stop-{k % 7}, " * 60 for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(packing._by_size(batch))
    assert sum(p.num_rows for p in parts) == len(texts) and max(p.nbytes for p in parts) < 1_200_000
    monkeypatch.setattr(packing, "_KNOWN_CHARS", 3000)
    encoder, most = packing.ChunkEncoder(queries.tokenizer_path()), 0
    for low in range(0, 300, 50):
        ids, bounds = encoder.encode(pa.array([*texts[low : low + 50], None, "", " \n"]))
        most = max(most, encoder.chars)
        for k, t in enumerate([*texts[low : low + 50], "", "", ""]):
            assert np.array_equal(ids[bounds[k] : bounds[k + 1]], [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID])
    assert most < 6000
