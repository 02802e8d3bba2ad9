from __future__ import annotations

import gc
import os
import time
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.storage import cut

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-stage-{k}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 1:
            assert docs.select("doc_id").distinct().count() == docs.count()
        if k == 2:
            items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not [r["doc_id"] for r in docs.collect() if any(x in r["text"] for x in items)]
    assert counts[0] > counts[1] > counts[2] > counts[3] and counts[4] == counts[5]
    end = docs.agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()
    assert end[0] == end[1]


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_written_tables_return_the_drivers_freed_memory(spark):
    jvm = spark.sparkContext._jvm

    def resident():
        return int(Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/statm").read_text().split()[1]) * os.sysconf("SC_PAGESIZE") >> 20

    def freed():  # 120 MB in small pieces, of which a few stay, so that the C library keeps the others
        pieces = [jvm.java.nio.ByteBuffer.allocateDirect(60_000) for _ in range(2_000)]
        few = pieces[::100]
        pieces.clear()
        gc.collect()
        for _ in range(3):
            jvm.System.gc()
            time.sleep(0.5)
        return few

    cut(spark.range(1), "before")
    few = freed()
    before = resident()
    cut(spark.range(1), "after")
    assert resident() < before - 60, "the driver keeps what it has freed"
    assert len(few) == 20


def test_stages_on_odd_tables(spark):
    """Nulls, empty texts, repeated rows and columns with clashing names, and a table without rows, through every stage."""
    rows = [(1, "a few words that stand here for a text", "en", "s1", 3), (1, "a few words that stand here for a text", "en", "s1", 3), (2, None, None, None, None), (3, "", "en", None, 1), (None, "a text without a name, of some words", "en", "s2", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.withColumns({c: F.lit(1) for c in ("score", "size", "target", "rate", "copies", "component_id", "kept", "item_id", "begin", "_lx0", "tie", "ids")})
    for table in (odd, odd.where("false")):
        n = table.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = cut(stage(spark, table, SF), "odd")
            if k < 4:
                assert out.columns == table.columns
                assert out.count() <= 2 * n
            else:
                assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == n
