"""Vectors dealt to the cells of pivots: an exact join by similarity, and a saved index whose search reads only cells that can matter.

A row belongs to the cell of the pivot nearest to it (ties: the smaller number). Pivots are a bounded sample of the rows, by a hash of
the id; nothing else of the vectors reaches the driver. Rows travel in packs: one row of a table with the ids and the matrix of up
to ``PACK`` rows, so an exchange moves few, bounded rows and a pair of packs is one matrix product.

In the join at a threshold t a row x of cell p meets cell q unless a bound shows that no member is within it. For unit vectors
with x * y >= t, |x - y| <= sqrt(2 - 2t), and the angle between them is at most arccos t. So both of these must hold for some
member y of q:

* (x - y) * (p - q) <= sqrt(2 - 2t) |p - q|, where the least y * q - y * p of q's members stands for y's part,
* angle(x, q) - angle(y, q) <= arccos t, where the largest angle of q's members stands for y's.

Cells' packs form a fixed number of groups, and each pair of groups is a task, where each pair of packs meets once, without the rows
that the bounds rule out. A cell of many rows is many packs, so no task gets a whole cell; of each row and task only the
best ``k`` stay, so a group of near copies doesn't send all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut
from . import vectors

#: Rows and bytes of a pack at most.
PACK, PACK_BYTES = 2_048, 1 << 20
#: Pivots, and bytes of all pivots and of a cell's bounds, at most.
MOST_PIVOTS, PIVOT_BYTES = 1_024, 32 << 20
#: Groups that packs form (more only where a group would have more bytes, or more links of its rows' best).
GROUPS, GROUP_BYTES, GROUP_LINKS = 12, 48 << 20, 4_000_000
#: Rows of a pack that are multiplied at once, pairs multiplied again in double precision at once, links in a batch.
SLICE, PAIRS, LINKS = 256, 1 << 16, 1 << 17
#: Links beyond its rows' best that a pack keeps at least before it drops those that are not; a pack keeps as many as its best are, if
#: those are more. A task holds all packs of a group, so it is what bounds the task's memory where most rows are similar.
MORE_LINKS = 1 << 16
_PACKS = "cell int, pack int, n int, ids binary, rows binary"


def _pack_size(d: int) -> int:
    return max(1, min(PACK, PACK_BYTES // (8 * d)))


def _small_batches(spark: SparkSession) -> None:
    """Few packs at once in a Python worker: a session with smaller batches keeps them."""
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20
    now = spark.conf.get(name).rstrip("bB")
    if not (now.isdigit() and 0 < int(now) <= most):
        spark.conf.set(name, str(most))


def unit_rows(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v: usable rows (``vectors.usable``) of the most frequent dimension (ties: the smaller) as unit vectors; zero vectors and
    null ids are left out."""
    rows = df.where(vectors.usable(vector) & F.col(id_col).isNotNull() & F.exists(vector, lambda x: x != 0))
    most = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size(vector) == (most["d"] if most else 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), vectors.normalised(vector).alias("v"))


def pivots(rows: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` different vectors of ``unit_rows``, those with the smallest hashes of their ids, as a matrix."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(n).select("v").collect()
    return np.unique(np.array([r["v"] for r in got], np.float64).reshape(len(got), -1), axis=0)


def how_many(n: int, dimension: int, per_cell: int = PACK) -> int:
    """Pivots for ``n`` rows: a pack a cell, within the bounds on pivots and their bytes."""
    return max(1, min(-(-n // per_cell), MOST_PIVOTS, PIVOT_BYTES // (8 * max(dimension, 1))))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, d)


def _floats(blob: bytes, d: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(-1, d)


def _pack_row(cell: int, pack: int, ids: np.ndarray, x: np.ndarray) -> dict:
    return {"cell": int(cell), "pack": int(pack), "n": len(ids), "ids": ids.astype(np.int64).tobytes(), "rows": np.ascontiguousarray(x).tobytes()}


def assigned(rows: DataFrame, p: np.ndarray) -> DataFrame:
    """id, v, cell, near (the inner product with the cell's pivot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _matrix(b.column(1), p.shape[1]) @ p.T
            cell = s.argmax(1) if len(s) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(s[np.arange(len(s)), cell])], names=["id", "v", "cell", "near"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, cell int, near double")


def parts_of(dealt: DataFrame, d: int) -> DataFrame:
    """_cell, parts: the packs that each cell's rows need, a row a cell."""
    size = _pack_size(d)
    return dealt.groupBy(F.col("cell").alias("_cell")).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("parts"))


def clustered(dealt: DataFrame, parts: DataFrame) -> DataFrame:
    """cell, part, id, v, a part's rows together. A cell's rows are dealt by a hash of their ids to its parts, so that no task gets a
    whole large cell."""
    parted = dealt.join(F.broadcast(parts), F.col("cell") == F.col("_cell")).select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v")
    return parted.repartition("cell", "part").sortWithinPartitions("cell", "part")


def packed(rows: DataFrame, d: int) -> DataFrame:
    """The rows of ``clustered`` in packs, as a narrow step: rows of a part that stand together, up to a pack's size."""
    size = _pack_size(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, xs = None, [], []

        def full(least: int):
            while ids and (n := sum(map(len, ids))) and n >= least:
                i, x = np.concatenate(ids), np.concatenate(xs)
                ids[:], xs[:] = ([i[size:]], [x[size:]]) if n > size else ([], [])
                yield _pack_row(key[0], key[1], i[:size], x[:size])

        for b in batches:
            cell, part, own, x = np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2)), _matrix(b.column(3), d)
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(cell)]):
                if s == e:
                    continue
                if key != (cell[s], part[s]):
                    yield from _batch(full(1))
                    key = (cell[s], part[s])
                ids.append(own[s:e])
                xs.append(x[s:e])
                yield from _batch(full(size))
        yield from _batch(full(1))

    return rows.mapInArrow(run, _PACKS)


def _batch(rows) -> Iterator[pa.RecordBatch]:
    for r in rows:
        yield pa.RecordBatch.from_pylist([r], schema=pa.schema([("cell", pa.int32()), ("pack", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())]))


def _bounds(packs: DataFrame, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell: its number of rows, the largest angle of a member to the pivot, and the least y * q - y * p for every pivot p."""
    m, d = p.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for b in batches:
            for cell, blob in zip(b.column(0).to_pylist(), b.column(1)):
                s = _floats(blob.as_buffer(), d) @ p.T
                own = s[:, cell]
                held = best.setdefault(cell, [0, np.inf, np.full(m, np.inf)])
                held[0] += len(s)
                held[1] = min(held[1], float(own.min()))
                held[2] = np.minimum(held[2], (own[:, None] - s).min(0))
        if best:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(list(best), pa.int32()), "n": pa.array([v[0] for v in best.values()], pa.int64()), "near": pa.array([v[1] for v in best.values()]), "least": pa.array([v[2].tolist() for v in best.values()], pa.list_(pa.float64()))})

    found = packs.select("cell", "rows").mapInArrow(run, "cell int, n long, near double, least array<double>")
    each = found.select("cell", "n", "near", F.posexplode("least").alias("at", "x")).groupBy("cell", "at").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.min("x").alias("x"))
    got = each.groupBy("cell").agg(F.max("n").alias("n"), F.min("near").alias("near"), F.sort_array(F.collect_list(F.struct("at", "x"))).alias("x")).collect()  # a row a cell
    n, near, least = np.zeros(m, np.int64), np.ones(m), np.full((m, m), np.inf)
    for r in got:
        n[r["cell"]], near[r["cell"]], least[r["cell"]] = r["n"], r["near"], [x["x"] for x in r["x"]]
    return n, np.arccos(np.clip(near, -1, 1)), least


@dataclass
class Join:
    """Directed links (query_id, id, score) and how many pairs of rows were multiplied for them (one row: tested)."""

    links: DataFrame
    tested: DataFrame


_LINKS = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
_FOUND = "query_id long, id long, score double, tested long"


def _links(own: np.ndarray, other: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(own), pa.array(other), pa.array(score), pa.nulls(len(own), pa.int64())], names=["query_id", "id", "score", "tested"])


def _top(s: np.ndarray, own: np.ndarray, other: np.ndarray, k: int | None, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's ``k`` best scores from its limit on, but not of its own id; columns go by id, and of ties the first stay."""
    s = np.where(own[:, None] == other[None], -np.inf, s)
    mask = (s >= limit[:, None]) & (s > -np.inf)
    if k is not None and k < s.shape[1]:
        kth = np.partition(s, -k, axis=1)[:, -k][:, None]
        over, tie = s > kth, s == kth
        mask &= over | (tie & (np.cumsum(tie, axis=1) <= k - over.sum(1, keepdims=True)))
    return np.nonzero(mask)


class _Rows:
    """Unit rows of one side with the finds of each so far; without ``k`` finds are given out as they come.

    ``limit`` is what a find of each row must reach: the threshold, or the k-th score found so far.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, limit: np.ndarray, k: int | None):
        self.ids, self.x, self.small, self.limit, self.k = ids, x, x.astype(np.float32), limit, k
        self.found: list[tuple] = []
        self.n = 0

    def add(self, row: np.ndarray, other: np.ndarray, score: np.ndarray) -> None:
        good = (score >= self.limit[row]) & (self.ids[row] != other)
        if good.any():
            self.found.append((row[good], other[good], score[good]))
            self.n += len(self.found[-1][0])
            if self.k is not None and self.n > (best := self.k * len(self.ids)) + max(best, MORE_LINKS):
                self.settle()

    def settle(self) -> None:
        """Keeps the best ``k`` of each row (ties: the smaller ids), and raises the limits to them."""
        if self.k is None or not self.found:
            return
        row, other, score = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((other, -score, row))
        row, other, score = row[order], other[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        last = rank == self.k - 1
        self.limit[row[last]] = np.maximum(self.limit[row[last]], score[last])
        kept = rank < self.k
        self.found, self.n = [(row[kept], other[kept], score[kept])], int(kept.sum())

    def out(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for row, other, score in self.found:
            for i in range(0, len(row), LINKS):
                yield _links(self.ids[row[i : i + LINKS]], other[i : i + LINKS], score[i : i + LINKS])
        self.found, self.n = [], 0


def _meet(a: _Rows, b: _Rows, at: np.ndarray | None, to: np.ndarray | None, same: bool) -> None:
    """The finds of rows ``at`` of ``a`` and rows ``to`` of ``b`` (None: all), for both sides; ``same``: both are one, for one side.

    Products in single precision say which pairs can reach a limit, as their error has a bound; those pairs are then multiplied in
    double precision. Where many can, the whole product is.
    """
    d = a.x.shape[1]
    slack = (d + 8) * 2.0**-23 + 1e-6
    at = np.arange(len(a.ids)) if at is None else at
    to = np.arange(len(b.ids)) if to is None else to
    y, y_small = (b.x, b.small) if len(to) == len(b.ids) else (b.x[to], b.small[to])
    for s0 in range(0, len(at), SLICE):
        own = at[s0 : s0 + SLICE]
        x, x_small = (a.x[own[0] : own[-1] + 1], a.small[own[0] : own[-1] + 1]) if own[-1] - own[0] + 1 == len(own) else (a.x[own], a.small[own])
        s = x_small @ y_small.T
        low, low_b = a.limit[own], b.limit[to]
        if same or (low.min() == low.max() and low_b.min() >= low.max()):
            mask = s >= (low - slack).astype(np.float32)[:, None]
        elif low_b.min() == low_b.max() and low.min() >= low_b.max():
            mask = s >= np.float32(low_b[0] - slack)
        else:
            mask = (s >= (low - slack).astype(np.float32)[:, None]) | (s >= (low_b - slack).astype(np.float32)[None])
        hits = np.flatnonzero(mask)
        if not len(hits):
            continue
        if 8 * len(hits) > s.size:
            s = np.round(np.einsum("id,jd->ij", x, y), 12) + 0.0  # sums up as below, so equal rows tie either way
            r, c = _top(s, a.ids[own], b.ids[to], a.k, low)
            a.add(own[r], b.ids[to[c]], s[r, c])
            if not same:
                c, r = _top(s.T, b.ids[to], a.ids[own], b.k, low_b)
                b.add(to[c], a.ids[own[r]], s[r, c])
            continue
        for i in range(0, len(hits), PAIRS):
            r, c = np.divmod(hits[i : i + PAIRS], len(to))
            score = np.round(np.einsum("ij,ij->i", x[r], y[c]), 12) + 0.0
            a.add(own[r], b.ids[to[c]], score)
            if not same:
                b.add(to[c], a.ids[own[r]], score)


def _joined(d: int, threshold: float | None, k: int | None, both: bool, sent):
    """Links of the packs of a task, which come in order of (task, side): side 0 is held, then each pack of side 1 meets it; the packs
    of side 2 meet each other. Behind each pack, a row without a link says how many products it took."""

    def near(a: _Rows, p: int, q: int) -> np.ndarray | None:
        pivots, least, far, angle, most = sent.value
        s = a.x @ pivots[[p, q]].T
        ok = (s[:, 0] - s[:, 1] + least[q, p] <= far[p, q]) & (np.arccos(np.clip(s[:, 1], -1, 1)) - angle[q] <= most)
        return None if ok.all() else np.flatnonzero(ok)

    def pair(a: _Rows, p: int, b: _Rows, q: int) -> int:
        at, to = (None, None) if p == q or sent is None else (near(a, p, q), near(b, q, p))
        n, m = len(a.ids) if at is None else len(at), len(b.ids) if to is None else len(to)
        if n and m:
            _meet(a, b, at, to, a is b)
        return n * m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for batch in batches:
            for now, side, cell, *blobs in zip(*[batch.column(i).to_pylist() for i in range(3)], *[batch.column(i) for i in range(3, 6)]):
                if now != task:
                    for rows, _ in held:
                        yield from rows.out()
                    task, held = now, []
                ids, x = np.frombuffer(blobs[0].as_buffer(), np.int64), _floats(blobs[1].as_buffer(), d)
                limit = np.full(len(ids), threshold) if threshold is not None else np.frombuffer(blobs[2].as_buffer(), np.float64)
                order = np.argsort(ids, kind="stable")
                rows = _Rows(ids[order], x[order], limit[order], k)
                tested = pair(rows, cell, rows, cell) if side == 2 else 0
                if side:
                    for other, of in held:
                        tested += pair(other, of, rows, cell)
                        if k is None:  # given out at once, one way or both
                            for links in other.out():
                                yield from _one_way(links, both)
                            for links in rows.out():
                                yield from _one_way(links, both)
                    if k is None:
                        for links in rows.out():
                            yield from _one_way(links, both)
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([tested], pa.int64())], names=["query_id", "id", "score", "tested"])
                if side == 1:
                    yield from rows.out()
                else:
                    held.append((rows, cell))
        for rows, _ in held:
            yield from rows.out()

    return run


def _one_way(links: pa.RecordBatch, both: bool) -> Iterator[pa.RecordBatch]:
    yield links if both else links.filter(pc.less(links.column(0), links.column(1)))


def _routes(units: list[tuple[int, int]], rows: np.ndarray, d: int, k: int | None, may: np.ndarray | None) -> tuple[int, list[tuple]]:
    """(number of groups, the (task, side) that each pack is sent to)."""
    n = int(rows.sum())
    groups = max(GROUPS, -(-n * d * 8 // GROUP_BYTES), -(-n * k // GROUP_LINKS) if k else 1)
    groups = min(groups, len(units))
    group = np.minimum((np.cumsum(rows) - rows) * groups // max(n, 1), groups - 1).astype(int)
    reach = np.ones((1 + max(c for c, _ in units), groups), bool)
    if may is not None:
        inside = np.zeros((len(may), groups), np.int64)
        inside[[c for c, _ in units], group] = 1
        reach = may.astype(np.int64) @ inside > 0
    routes = []
    for (cell, pack), g in zip(units, group.tolist()):
        others = [h for h in range(groups) if h == g or reach[cell, h]]
        routes.append((cell, pack, [(min(g, h) * groups + max(g, h), 2 if h == g else int(g > h)) for h in others]))
    return groups, routes


def _in_groups(packs: DataFrame, units: list[tuple[int, int]], rows: np.ndarray, d: int, threshold: float | None, k: int | None, both: bool, may: np.ndarray | None, sent) -> DataFrame:
    """query_id, id, score, tested of all pairs of packs. ``units``: the (cell, pack) there are, with about ``rows`` rows each.

    Packs form groups of about equal size, and each pair of groups is a task, so a pack is sent once a group and not once a cell.
    Their number is fixed, however many rows there are, up to what a task may hold. Packs are sent to those groups
    alone that hold a cell which their own may have links with (``may``).
    """
    spark = packs.sparkSession
    groups, routes = _routes(units, rows, d, k, may)
    routed = spark.createDataFrame(routes, "_cell int, _pack int, sent array<struct<task:int,side:int>>")  # a row a pack
    copies = packs.join(F.broadcast(routed), (F.col("cell") == F.col("_cell")) & (F.col("pack") == F.col("_pack")))
    copies = copies.select(F.explode("sent").alias("s"), "cell", "ids", "rows", "floor").select("s.task", "s.side", "cell", "ids", "rows", "floor")
    met = copies.repartition(max(4, 2 * groups * (groups + 1)), "task").sortWithinPartitions("task", "side", "cell")
    return cut(met.mapInArrow(_joined(d, threshold, k, both, sent), _FOUND), "cell-links")


def _of_each(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def similar(df: DataFrame, id_col: str, vector: str, threshold: float, k: int | None = None, n_pivots: int | None = None, both: bool = True) -> Join:
    """All pairs of rows with a cosine of ``threshold`` or more, in both directions; with ``k``, each row's best ``k`` of them.

    Exact; scores are rounded to 12 places and equal ones go to the smaller id. ``threshold`` must be above 0. Rows without a
    usable vector, zero vectors and null ids take no part; an empty table has no links. Rows that repeat an id are linked like
    others, but never to their own id. What is multiplied is each pair once in the worst case; ``tested`` says how many were.
    Without ``both`` (and ``k``) a pair is a link of the smaller id to the larger alone.
    """
    if not threshold > 0:
        raise ValueError("the threshold must be above 0")
    if k is not None and not both:
        raise ValueError("each row's best links have both directions")
    spark = df.sparkSession
    _small_batches(spark)
    rows = cut(unit_rows(df, id_col, vector), "cell-rows")
    n, d = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return Join(spark.createDataFrame([], "query_id long, id long, score double"), spark.sql("SELECT 0L AS tested"))
    p = pivots(rows, how_many(n, d) if n_pivots is None else n_pivots)
    sent, may = None, None
    if len(p) == 1:  # one cell has no bounds to know
        packs, units, size = _one_cell(rows, n, d)
    else:
        dealt = cut(assigned(rows, p).drop("near"), "cell-rows")
        parts = cut(parts_of(dealt, d), "cell-parts")
        packs = cut(packed(clustered(dealt, parts), d), "cell-packs")
        count, angle, least = _bounds(packs, p)
        units, size = [], []
        for r in sorted(parts.collect()):  # a row a cell
            units += [(r["_cell"], i) for i in range(r["parts"])]
            size += [count[r["_cell"]] / r["parts"]] * r["parts"]
        far = np.sqrt(max(2 - 2 * threshold, 0.0)) * np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0.0)) + 1e-9
        most = np.arccos(min(threshold, 1.0)) + 1e-9
        apart = np.arccos(np.clip(p @ p.T, -1, 1)) - 1e-7
        may = (least + least.T <= far) & (apart - angle[:, None] - angle[None] <= most)
        np.fill_diagonal(may, True)
        sent = spark.sparkContext.broadcast((p, least, far, angle, most))
    found = _in_groups(packs.withColumn("floor", F.lit(None).cast("binary")), units, np.array(size), d, threshold, k, both, may, sent)
    if sent is not None:
        sent.destroy()
    tested = found.agg(F.coalesce(F.sum("tested"), F.lit(0)).alias("tested"))
    found = found.where(F.col("score").isNotNull()).drop("tested")
    return Join(found if k is None else _of_each(found, k).drop("rank"), tested)


def _one_cell(rows: DataFrame, n: int, d: int) -> tuple[DataFrame, list[tuple[int, int]], list[float]]:
    """(packs, their numbers, about how many rows each has) with all rows in one cell, dealt by a hash of their ids."""
    parts = -(-n // _pack_size(d))
    dealt = clustered(rows.withColumn("cell", F.lit(0)), rows.sparkSession.createDataFrame([(0, parts)], "_cell int, parts int"))
    return packed(dealt, d), [(0, i) for i in range(parts)], [n / parts] * parts


def _floors(d: int, k: int):
    """Packs with each row's k-th score within its pack, which its k-th of all reaches (-inf without as many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            floors = []
            for ids, rows in zip(b.column(3), b.column(4)):
                ids, x = np.frombuffer(ids.as_buffer(), np.int64), _floats(rows.as_buffer(), d)
                low = np.full(len(ids), -np.inf)
                for i in range(0, len(ids) if k <= len(ids) else 0, SLICE):
                    s = np.round(x[i : i + SLICE] @ x.T, 12)
                    s[ids[i : i + SLICE, None] == ids[None]] = -np.inf
                    low[i : i + SLICE] = np.partition(s, -k, axis=1)[:, -k]
                floors.append(low.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floors, pa.binary())], names=[*b.schema.names, "floor"])

    return run


def nearest(df: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """query_id, id, score, rank: each row's ``k`` rows of another id with the largest cosine, as ``vectors.search`` finds them, but each
    pair of rows is multiplied once, and no vector goes through the driver. A zero vector scores 0."""
    spark = df.sparkSession
    _small_batches(spark)
    rows = df.where(vectors.usable(vector) & F.col(id_col).isNotNull())
    most = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None or k < 1:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    n, d = most["count"], most["d"]
    rows = rows.where(F.size(vector) == d).select(F.col(id_col).cast("long").alias("id"), vectors.normalised(vector).alias("v"))
    packs, units, size = _one_cell(rows, n, d)
    packs = cut(packs.mapInArrow(_floors(d, k), _PACKS + ", floor binary"), "cell-packs")
    found = _in_groups(packs, units, np.array(size), d, None, k, True, None, None)
    return _of_each(found.where(F.col("score").isNotNull()).drop("tested"), k)


def save(df: DataFrame, path: str, id_col: str, vector: str, n_cells: int | None = None) -> None:
    """An index of ``df`` at ``path``: ``rows``, Parquet partitioned by cell with all columns of ``df`` beside ``_id`` and ``_v``, and
    ``directory``: a row a cell with its centroid, the largest angle of a member to it, and its number of rows.

    Rows without a usable vector are in no cell; ``df`` must not have columns ``_id``, ``_v`` and ``_cell``.
    """
    spark = df.sparkSession
    _small_batches(spark)
    rows = cut(unit_rows(df, id_col, vector), "index-rows")
    n, first = rows.count(), rows.first()
    d = len(first["v"]) if first else 0
    if first is None:
        dealt = rows.select("id", "v", F.lit(0).alias("cell"))
        centres = np.zeros((0, 1))
    else:
        centres = pivots(rows, how_many(n, d) if n_cells is None else n_cells)
        dealt = cut(assigned(rows, centres), "index-rows").select("id", "v", "cell")
    kept = df.where(F.col(id_col).isNotNull())
    whole = dealt.select(F.col("id").alias("_id"), F.col("v").alias("_v"), F.col("cell").alias("_cell")).join(kept, F.col("_id") == kept[id_col].cast("long"))
    size = max(1, min(PACK, PACK_BYTES // (8 * max(d, 1))) * 16)
    counts = dealt.groupBy(F.col("cell").alias("_cell")).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("_files"))
    spread = whole.join(F.broadcast(counts), "_cell").withColumn("_file", F.pmod(F.xxhash64("_id"), F.col("_files")))
    spread.repartition("_cell", "_file").drop("_files", "_file").write.partitionBy("_cell").parquet(f"{path}/rows")
    at = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "_cell int, centroid array<double>")
    near = F.aggregate(F.zip_with("_v", "centroid", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    kept_rows = dealt.select(F.col("v").alias("_v"), F.col("cell").alias("_cell")).join(F.broadcast(at), "_cell")
    by = kept_rows.groupBy("_cell").agg(F.first("centroid").alias("centroid"), F.acos(F.least(F.greatest(F.min(near), F.lit(-1.0)), F.lit(1.0))).alias("angle"), F.count(F.lit(1)).alias("n"))
    by.coalesce(1).write.parquet(f"{path}/directory")


@dataclass
class Found:
    """query_id, id, score, rank, and what the search has read: cells of each round, and all there are."""

    results: DataFrame
    read: tuple[int, int]
    cells: int


def _topped(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "v") -> Found:
    """Each query's ``k`` rows of the index with the largest cosine: exact, as bounds say which cells can hold a better row.

    A query first reads the nearest cells that have ``k`` rows together; then those cells alone whose bound (the cosine of the
    angle to the centroid less the cell's largest) reaches its k-th score so far. Cells that no query needs are never read: the
    list of needed ones is a filter on the partition column. The directory is what reaches the driver. Queries without a usable
    vector, of another dimension, zero ones and null ids have no results.
    """
    _small_batches(spark)
    ddl = "query_id long, id long, score double"
    directory = spark.read.parquet(f"{path}/directory").orderBy("_cell").collect()  # a row a cell, MOST_PIVOTS at most by default
    if not directory:
        return Found(spark.createDataFrame([], ddl + ", rank int"), (0, 0), 0)
    number = np.array([r["_cell"] for r in directory], np.int32)
    centre, angle, count = np.array([r["centroid"] for r in directory]), np.array([r["angle"] for r in directory]), np.array([r["n"] for r in directory])
    d = centre.shape[1]
    usable = queries.where(vectors.usable(query_vector) & (F.size(query_vector) == d) & F.col(query_id).isNotNull() & F.exists(query_vector, lambda x: x != 0))
    asked = cut(usable.select(F.col(query_id).cast("long").alias("query_id"), vectors.normalised(query_vector).alias("v")), "index-queries")
    index = spark.read.parquet(f"{path}/rows")

    def bounded(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(upper bound of each query and cell, whether the cell is among the nearest that have k rows together)."""
        away = np.arccos(np.clip(q @ centre.T, -1, 1))
        order = np.argsort(away, axis=1, kind="stable")
        before = np.cumsum(count[order], axis=1) - count[order]
        first = np.zeros(away.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        return np.cos(np.maximum(away - angle[None], 0.0)) + 1e-9, first

    def route(later: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, q = np.asarray(b.column(0)), _matrix(b.column(1), d)
                if not len(ids):
                    continue
                bound, first = bounded(q)
                need = (~first & (bound >= np.asarray(b.column(2))[:, None])) if later else first
                for c in np.flatnonzero(need.any(0)):
                    own = np.flatnonzero(need[:, c])
                    for s in range(0, len(own), PACK):
                        at = own[s : s + PACK]
                        yield pa.RecordBatch.from_pydict({"to": pa.array([number[c]], pa.int32()), "x_ids": pa.array([ids[at].tobytes()], pa.binary()), "x_rows": pa.array([np.ascontiguousarray(q[at]).tobytes()], pa.binary())})

        return run

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = _pack_size(d)
        for b in batches:
            cell, ids, x = np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b.column(2), d)
            for c in np.unique(cell):
                own = np.flatnonzero(cell == c)
                yield from _batch(_pack_row(c, 0, ids[own[s : s + size]], x[own[s : s + size]]) for s in range(0, len(own), size))

    def round_(routed: DataFrame) -> tuple[DataFrame, int]:
        routed = cut(routed, "index-routes")
        needed = [r["to"] for r in routed.select("to").distinct().collect()]  # numbers of cells
        part = index.where(F.col("_cell").isin(needed)).select(F.col("_cell").cast("int"), "_id", "_v").mapInArrow(packs, _PACKS)
        met = routed.join(part.withColumnRenamed("cell", "to"), "to").select(F.lit(False).alias("same"), "x_ids", "x_rows", "ids", "rows")
        return met.mapInArrow(_multiplied_as_asked(d, k), ddl), len(needed)

    near, first = round_(asked.mapInArrow(route(False), "to int, x_ids binary, x_rows binary"))
    near = cut(_topped(near, k).drop("rank"), "index-found")
    kth = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("kth"))
    later = asked.join(kth, "query_id").select("query_id", "v", (F.col("kth") - 1e-9).alias("kth"))
    rest, second = round_(later.mapInArrow(route(True), "to int, x_ids binary, x_rows binary"))
    return Found(_topped(near.unionAll(rest), k), (first, second), len(directory))


def _multiplied_as_asked(d: int, k: int):
    """As ``_multiplied`` one way, for queries that may be rows of the index themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, rows, other_ids, other_rows in zip(*[b.column(i) for i in range(1, 5)]):
                a, c = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, other_ids))
                s = np.round(_floats(rows.as_buffer(), d) @ _floats(other_rows.as_buffer(), d).T, 12)
                limit = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if k < s.shape[1] else np.full((len(s), 1), -np.inf)
                r, at = np.nonzero(s >= limit)
                yield pa.RecordBatch.from_arrays([pa.array(a[r]), pa.array(c[at]), pa.array(s[r, at])], schema=_LINKS)

    return run
