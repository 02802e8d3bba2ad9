"""The bounded sample of labelled documents that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int, max_bytes: int) -> list[tuple[str, int]]:
    """At most ``max_rows`` whole texts of at most ``max_bytes`` bytes each, with their 0/1 labels, in a fixed order.

    Rows are drawn by a hash of the id among those where ``learn`` (of labels.doc_id) holds; of texts that share a doc_id the
    smallest counts. So what reaches the driver is bounded by max_rows * max_bytes at any size of the input. Labels other than
    0 and 1 and null texts are left out; of rows that repeat a doc_id in ``labels`` the smallest label counts.
    """
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & learn)
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .withColumn("h", F.xxhash64("doc_id"))
        .orderBy("h", "doc_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes).join(F.broadcast(picked), "doc_id")
    found = texts.groupBy("h", "doc_id", "y").agg(F.min("text").alias("text")).toPandas().sort_values(["h", "doc_id"])
    return list(zip(found["text"].tolist(), found["y"].astype(int).tolist()))
