from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import clean, dedup
from lexmill.streaming import online


def _run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams_agree_with_batches(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 20).alias("pos"), F.concat(F.lit("什么是犯罪行为"), (F.col("id") % 20).cast("string")).alias("instruction"), F.lit("这是一个足够长的回答，用于通过长度检查的内容部分。").alias("output"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("id"))).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert _run(online.cleaned(stream), "cleaned").where("reason IS NULL").count() == clean.kept(clean.classify(rows)).count()
    assert _run(online.exact_dedup(stream, "instruction", "ts"), "unique_rows").count() == 20


def test_event_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    done = _run(online.event_counts(stream, "ts", "event_type"), "event_windows")
    batch = events.groupBy(F.window("ts", "5 minutes"), "event_type").count()
    assert 0 < done.count() <= batch.count()


def test_retrieve_each(spark, tmp_path):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, v array<double>")
    q.write.parquet(str(tmp_path / "q"))
    corpus = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 1.0])], "id long, v array<double>")
    seen = []
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "q"))
    online.retrieve_each(stream, corpus, 1, lambda df, epoch: seen.extend(r["id"] for r in df.collect())).trigger(availableNow=True).start().awaitTermination()
    assert seen == [1]


def _changes(spark, rows, batches, name, delay):
    """The changes that ``first_by_pos`` makes of rows (pos, text, second) that come in the given batches."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        at, out = name / "in", []
        schema = "pos long, text string, ts timestamp"
        for k, own in enumerate(batches):
            part = spark.createDataFrame([(*rows[i][:2], rows[i][2]) for i in own], "pos long, text string, s long").select("pos", "text", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
            part.coalesce(1).write.mode("append").parquet(str(at / f"b={k}"))
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(at))
            q = online.first_by_pos(stream, "text", "pos", "ts", delay).writeStream.outputMode("append").option("checkpointLocation", str(name / "ck"))
            q.foreachBatch(lambda df, epoch: out.extend(tuple(r) for r in df.select("pos", "change").collect())).trigger(availableNow=True).start().awaitTermination()
        return out
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("turn", ["shuffled", "backwards"])
def test_first_by_pos_in_any_order(spark, tmp_path, turn):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a b", "ab", "c", "d ", " d", "e" * rng.randint(1, 4)]), i) for i in range(40)]
    kept = {r["pos"] for r in dedup.exact(spark.createDataFrame(rows, "pos long, text string, s long"), "text").collect()}
    order = list(range(39, -1, -1))
    if turn == "shuffled":
        rng.shuffle(order)
    changes = _changes(spark, rows, [order[:15], order[15:30], order[30:]], tmp_path, "1 hour")
    state: dict[int, int] = {}
    for pos, change in changes:
        state[pos] = state.get(pos, 0) + change
    assert set(state.values()) <= {0, 1} and {p for p, n in state.items() if n} == kept
    assert turn == "shuffled" or sum(c < 0 for _, c in changes) > 3


def test_first_by_pos_forgets_behind_the_watermark(spark, tmp_path):
    rows = [(5, "a", 0), (9, "b", 10_000), (8, "b", 10_001), (7, "a", 10_002), (6, "b", 10_003)]
    # the third batch comes when the watermark has passed the first row
    changes = _changes(spark, rows, [[0], [1], [2], [3, 4]], tmp_path, "10 seconds")
    assert sorted(changes) == sorted([(5, 1), (9, 1), (9, -1), (8, 1), (8, -1), (6, 1), (7, 1)])
