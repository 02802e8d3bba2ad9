"""Vectors: encoders, normalisation and exact inner-product search in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import cut

#: Query rows, and bytes of their vectors, that one pass over the corpus takes at most: what is broadcast is bounded by both.
BLOCK, BLOCK_BYTES = 16_384, 16 << 20
#: Products of a query block and rows of the corpus that a task holds at once, in bytes.
PRODUCT_BYTES = 32 << 20


def usable(vector: Column | str) -> Column:
    """Whether there is a vector with components, and all of them are there and finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def normalised(vector: Column | str) -> Column:
    """The vector in doubles at unit length; a zero vector stays as it is."""
    v = F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0)))


def dot(a: Column, b: Column) -> Column:
    """The inner product as an expression: the plain form that the block kernel is checked against."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def encode(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], name: str = "embedding", batch: int = 64) -> DataFrame:
    """``df`` with the encoder's unit vectors of a text column. ``encoder`` is loaded once a task and sees ``batch`` texts at a time.

    An encoder with an attribute ``load`` is called as ``encoder.load()`` in the task first, which returns the function to use.
    """
    from pyspark.sql.types import ArrayType, FloatType, StructField

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder.load() if hasattr(encoder, "load") else encoder
        for rows in batches:
            texts = [t or "" for t in rows.column(text).to_pylist()]
            parts = [np.asarray(use(texts[i : i + batch]), np.float32) for i in range(0, len(texts), batch)]
            x = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(norm == 0, 1, norm)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=[*rows.schema.names, name])

    kept = df.drop(name)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(name, ArrayType(FloatType()))]))


class HashedTrigrams:
    """An encoder without a model: counts of character trigrams in 2^bits hashed places, damped by a logarithm."""

    def __init__(self, bits: int = 14):
        self.bits = bits

    def __call__(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), 1 << self.bits), np.float32)
        for row, t in zip(out, texts):
            places = [zlib.crc32(t[i : i + 3].encode()) & ((1 << self.bits) - 1) for i in range(max(len(t) - 2, min(len(t), 1)))]
            if places:
                at, n = np.unique(places, return_counts=True)
                row[at] = 1 + np.log(n)
        return out


def _search(sent, k: int, skip_self: bool):
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            if not len(ids):
                continue
            x = np.asarray(batch.column("v").flatten(), np.float64).reshape(len(ids), -1)
            step = max(1, PRODUCT_BYTES // (8 * len(ids)))
            for i in range(0, len(names), step):
                s = q[i : i + step] @ x.T
                if skip_self:
                    s[names[i : i + step, None] == ids[None]] = -np.inf
                n = min(k, len(ids))
                limit = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
                r, c = np.nonzero((s >= limit - 1e-12) & np.isfinite(s))
                yield pa.RecordBatch.from_arrays([pa.array(names[i + r]), pa.array(ids[c]), pa.array(s[r, c])], schema=schema)

    return run


def search(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id", query_vector: str = "v", id_col: str = "id", vector: str = "v", skip_self: bool = False, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, id, score, rank: the ``k`` rows of the corpus with the largest inner product of unit vectors.

    Exact. Queries go in blocks bounded in rows and bytes. A block is broadcast for one pass over the corpus that sends its own best
    ``k`` (with ties) per batch; its finds are written and the broadcast is destroyed before the next, so the driver and the
    workers hold one block at a time, however many queries there are. Equal scores go to the smaller id.

    The corpus' dimension is that of most of its usable vectors (ties: the smaller). Vectors that are null, empty, of another
    dimension, or hold a null or non-finite component take no part, nor do null ids; a zero vector scores 0. Without queries or
    rows there are no results. ``cells`` has an index for few queries over a large corpus, and the join at a threshold.
    """
    spark = corpus.sparkSession
    own = lambda df, name, vec, to: df.where(usable(vec) & F.col(name).isNotNull()).select(F.col(name).cast("long").alias(to), normalised(vec).alias("v"))
    rows = own(corpus, id_col, vector, "id")
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = most["d"] if most else 0
    rows, q = rows.where(F.size("v") == d), own(queries, query_id, query_vector, "query_id").where(F.size("v") == d)
    ddl = "query_id long, id long, score double"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ranked = lambda found: found.withColumn("score", F.round("score", 12)).withColumn("rank", rank).where(F.col("rank") <= k)
    blocks, out = -(-q.count() // max(1, min(block, block_bytes // (8 * max(d, 1))))), None
    if blocks > 1:
        q = cut(q, "query-vectors")
    for b in range(blocks):
        held = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if not held.num_rows:
            continue
        matrix = np.asarray(held.column("v").combine_chunks().flatten(), np.float64).reshape(held.num_rows, d)
        sent = spark.sparkContext.broadcast((np.asarray(held.column("query_id")), matrix))
        part = cut(ranked(rows.mapInArrow(_search(sent, k, skip_self), ddl)), "found")
        sent.destroy()
        out = part if out is None else out.unionAll(part)
    return ranked(spark.createDataFrame([], ddl)) if out is None else out


def self_neighbours(df: DataFrame, id_col: str, vector: str, k: int = 19) -> DataFrame:
    """query_id, id, score, rank: each row's nearest others (``cells.nearest``)."""
    from .cells import nearest  # which uses this module

    return nearest(df, id_col, vector, k)
