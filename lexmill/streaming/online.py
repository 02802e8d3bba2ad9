"""The same operators on streams; extensions, as there is no stream in what these plans come from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..operators import clean, retrieve


def cleaned(stream: DataFrame, **rules) -> DataFrame:
    """Rule cleaning is narrow, so it runs on a stream as it is."""
    return clean.classify(stream, **rules)


def exact_dedup(stream: DataFrame, text: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """The first of equal texts (white space aside) within the watermark; state is dropped behind it."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withColumn("hash", X.content_hash(text))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["hash"])


def event_counts(stream: DataFrame, time: str, key: str, size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def retrieve_each(stream: DataFrame, corpus: DataFrame, k: int, write: Callable[[DataFrame, int], None], **names):
    """A writer that searches the corpus for every micro-batch of query vectors and hands the results to ``write``."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: write(retrieve.top_k(batch, corpus, k, **names), epoch))


class _Smallest(StatefulProcessor):
    """Of one text the smallest pos so far; a change is a retraction of the old one and an addition of the new one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "pos long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        low, seen = None, 0
        for part in rows:
            part = part[part["pos"].notna()]
            if len(part):
                low = int(part["pos"].min()) if low is None else min(low, int(part["pos"].min()))
                seen = max(seen, int(part["until"].max()))
        if low is None:
            return
        old, until = self.kept.get() if self.kept.exists() else (None, 0)
        if seen > until:  # the text is remembered until the watermark passes its last row
            if until:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(seen)
        self.kept.update((low if old is None else min(low, old), max(seen, until)))
        if old is None or low < old:
            changes = [(low, 1)] if old is None else [(old, -1), (low, 1)]
            yield pd.DataFrame({"hash": [key[0]] * len(changes), "pos": [p for p, _ in changes], "change": [c for _, c in changes]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_by_pos(stream: DataFrame, text: str, pos: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """hash, pos, change: which row stays of each text (white space aside), as additions (1) and retractions (-1).

    After any batch the sum of changes of a pos says whether ``dedup.exact`` over all rows so far would keep it, in whatever order
    rows have come. A text's state is one number and one timer; it goes when the watermark passes the text's last row by
    ``delay`` more, so a copy that comes later than that counts as a new text. Rows without a time or pos take no part. Needs the
    RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull()).withWatermark(time, delay)
    until = F.unix_millis(F.col(time)) + F.lit(1)
    keyed = rows.select(X.content_hash(text).alias("hash"), F.col(pos).cast("long").alias("pos"), until.alias("until"), time)
    return keyed.groupBy("hash").transformWithStateInPandas(_Smallest(), "hash string, pos long, change int", "Append", "EventTime")
