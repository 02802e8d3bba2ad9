"""Permutation index for nearest neighbours by cosine.

Every vector is represented by its ``reach`` nearest pivots in order. The index is cut by rows into segments; a segment holds,
for each pivot, an inverted file of (vector, place of the pivot in the vector's order). A query walks the files of its own
``probes`` nearest pivots alone, which is about probes * reach / n_pivots postings a vector (one, by default), and gives the
vectors there their footrule distance (a pivot out of reach counts as the first place beyond). The ``share`` of a segment
with the smallest footrule, with all ties, is reranked by exact cosine in double precision; vectors that share no pivot with
the query are left out, but for segments of up to ``least`` rows, which are reranked whole.

Pivots are a bounded sample of the rows (``n_pivots`` of them, by a hash of the id); every row is in the index. Queries go in
blocks of about ``block`` rows; a block is broadcast, its finds are written, and the broadcast goes before the next, so the
driver holds block * (dimension * 8 + probes * 8) bytes at a time, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ragged

SEGMENT = 4_096
_SEGMENT_SCHEMA = "n long, ids binary, vectors binary, starts binary, members binary, places binary"
_RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not zero and whose components are all there and finite, as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def orders(x: np.ndarray, pivots: np.ndarray, reach: int) -> np.ndarray:
    """The ``reach`` nearest pivots of each row of ``x``, nearest first; ties to the smaller pivot."""
    sim = (x / np.linalg.norm(x, axis=1)[:, None]) @ pivots.T
    return np.argsort(-sim, axis=1, kind="stable")[:, :reach]


def _segments(pivots: np.ndarray, reach: int):
    def pack(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        near = orders(x, pivots, reach)
        flat = near.ravel()
        by = np.argsort(flat, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(pivots)))]).astype(np.int64)
        row = {"n": len(ids), "ids": ids.tobytes(), "vectors": x.tobytes(), "starts": starts.tobytes(), "members": (by // near.shape[1]).astype(np.uint16).tobytes(), "places": (by % near.shape[1]).astype(np.uint16).tobytes()}
        return pa.RecordBatch.from_pylist([row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, n = [], [], 0
        for batch in batches:
            ids.append(np.asarray(batch.column("vec_id")))
            xs.append(np.asarray(batch.column("v").flatten(), dtype=np.float64).reshape(-1, pivots.shape[1]))
            n += len(ids[-1])
            while n >= SEGMENT:
                i, x = np.concatenate(ids), np.concatenate(xs)
                yield pack(i[:SEGMENT], x[:SEGMENT])
                ids, xs, n = [i[SEGMENT:]], [x[SEGMENT:]], n - SEGMENT
        if n:
            yield pack(np.concatenate(ids), np.concatenate(xs))

    return run


def footrule_gain(near: np.ndarray, starts: np.ndarray, members: np.ndarray, places: np.ndarray, n: int, reach: int) -> np.ndarray:
    """What each vector's footrule distance is below that of a vector that shares no pivot with the query's ``near``.

    With places p and r of a shared pivot it falls by (reach - p) + (reach - r) - |p - r| = 2 * (reach - max(p, r)).
    """
    size = starts[near + 1] - starts[near]
    at = ragged(starts[near], size)
    gain = 2 * (reach - np.maximum(np.repeat(np.arange(len(near)), size), places[at].astype(np.int64)))
    return np.bincount(members[at], gain, n)


def _search(sent, k: int, share: float, least: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, near = sent.value
        norms = np.sqrt((queries * queries).sum(axis=1))
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
                starts, members, places = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["members"], np.uint16), np.frombuffer(row["places"], np.uint16)
                own = np.sqrt((x * x).sum(axis=1))
                repeats = len(np.unique(ids)) < n
                take = min(n, max(least, int(np.ceil(share * n))))
                out_q, out_v, out_s = [], [], []
                for q in range(len(query_ids)):
                    if take < n:
                        gain = footrule_gain(near[q], starts, members, places, n, reach)
                        found = np.flatnonzero(gain >= max(1.0, np.partition(gain, n - take)[n - take]))
                    else:
                        found = np.arange(n)
                    found = found[ids[found] != query_ids[q]]
                    s = (x[found] * queries[q]).sum(axis=1) / (own[found] * norms[q])
                    best = np.lexsort((ids[found], -s))
                    if repeats:  # the nearest row of each id
                        best = best[np.sort(np.unique(ids[found][best], return_index=True)[1])]
                    best = best[:k]
                    out_q.append(np.full(len(best), query_ids[q]))
                    out_v.append(ids[found][best])
                    out_s.append(s[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in (out_q, out_v, out_s)], schema=_RESULT)

    return run


def nearest(vectors: DataFrame, is_query, k: int = 5, *, n_pivots: int = 2_048, reach: int = 64, probes: int = 32, share: float = 0.1, least: int = 128, block: int = 8_192) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every row where ``is_query`` holds.

    ``vectors`` has vec_id and embedding; other columns are ignored. Null, zero and non-finite vectors take no part; of
    vectors of several dimensions only those of the most frequent one do (ties: the smaller). A query never finds rows of its
    own vec_id. Rows may share a vec_id: it is found once, by its nearest row, and asks once, with its smallest vector. Ties go
    to the smaller vec_id. With no usable vectors the result is empty.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return empty
    rows = rows.where(F.size("v") == dims[0]["d"])
    drawn = rows.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id", "v").limit(n_pivots).collect()
    pivots = np.unique(np.array([r["v"] for r in drawn]), axis=0)
    pivots = pivots / np.linalg.norm(pivots, axis=1)[:, None]
    reach, probes = min(reach, len(pivots)), min(probes, len(pivots))
    index = cut(rows.mapInArrow(_segments(pivots, reach), _SEGMENT_SCHEMA), "permutation-index")
    asked = cut(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "permutation-queries")
    blocks = max(1, -(-asked.count() // block))
    every = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if own:
            x = np.array([r["v"] for r in own])
            sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in own], np.int64), x, orders(x, pivots, probes)))
            found = cut(index.mapInArrow(_search(sent, k, share, least, reach), "query_id long, vec_id long, score double"), "permutation-found")
            sent.unpersist()
            every = found if every is None else every.unionAll(found)
    if every is None:
        return empty
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = every.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
