"""Representative sampling: k-center within ability classes, with quotas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..storage import cut
from . import vectors

#: Bytes of candidates that reach the driver in one pass, and candidates of a group at least and at most.
CANDIDATE_BYTES, CANDIDATES = 16 << 20, (16, 4_096)


def k_center(vectors: np.ndarray, n: int, seed: int = 42) -> list[int]:
    """Ascending places of ``n`` rows (all, if fewer): a seeded first, then always the row farthest from those chosen, by cosine.

    Distances have 12 decimals, so that equal rows are equally far; equal distances go to the smaller place; with all distances 0 a
    place may be chosen again.
    """
    if not len(vectors):
        raise ValueError("no rows to choose from")
    x = np.asarray(vectors)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm == 0, 1, norm)
    chosen = [int(np.random.RandomState(seed).randint(len(x)))]
    far = np.round(1 - x @ x[chosen[0]], 12)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, np.round(1 - x @ x[chosen[-1]], 12))
    return sorted(chosen)


def ability(text: Column | str, packs: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The first class with a keyword in the text, in the packs' order, else 'unclassified'. Case counts."""
    out = F.lit(V.UNCLASSIFIED)
    for name, words in reversed(list((packs or V.ABILITIES).items())):
        out = F.when(X.any_of(text, words), name).otherwise(out)
    return out


def default_quotas(n: int, shares: Mapping[str, float] | None = None) -> dict[str, int]:
    return {k: int(n * v) for k, v in (shares or V.ABILITY_SHARES).items()}


def _at_place(rows: DataFrame, places: Mapping[str, int]) -> dict[str, object]:
    """The ``pos`` at a place (from 0) of each group's order. Rows (g, pos) go by ranges; each range numbers its own, and the
    ranges' sizes are summed up before them, so no task gets a whole group."""
    ranged = cut(rows.repartitionByRange("g", "pos").withColumn("_range", F.spark_partition_id()), "center-order")
    sizes = ranged.groupBy("g", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    wanted = F.create_map(*[F.lit(x) for g, k in places.items() for x in (g, k)])[F.col("g")]
    hit = sizes.where((wanted >= F.col("_before")) & (wanted < F.col("_before") + F.col("_n")))
    own = F.row_number().over(Window.partitionBy("g", "_range").orderBy("pos")) - 1
    found = ranged.join(F.broadcast(hit), ["g", "_range"]).withColumn("_at", F.col("_before") + own)
    return {r["g"]: r["pos"] for r in found.where(F.col("_at") == wanted).select("g", "pos").collect()}  # a row a group


def _nearer(sent):
    """``far`` (g, pos, v, far) with the distance to the nearest of its group's new centers, if that is smaller."""

    def run(batches):
        new = sent.value
        for b in batches:
            g, far = np.asarray(b.column(0).to_pylist(), object), np.array(b.column(3))
            x = np.asarray(b.column(2).flatten(), np.float64).reshape(len(far), -1)
            for name, centers in new.items():
                own = np.flatnonzero(g == name)
                for s in range(0, len(own), 4_096):
                    at = own[s : s + 4_096]
                    far[at] = np.minimum(far[at], np.round(1 - x[at] @ centers.T, 12).min(1))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(far)], names=b.schema.names)

    return run


def _greedy(pos: list, x: np.ndarray, far: np.ndarray, bound: float | None, n: int) -> list[int]:
    """Places of up to ``n`` candidates (in order of pos) that are the next farthest rows for certain.

    The first is, as the distances are up to date. A later one is if it is still farther than ``bound``, which no other row exceeds.
    """
    chosen: list[int] = []
    while len(chosen) < n:
        at = int(np.argmax(far))
        if chosen and bound is not None and far[at] <= bound:
            break
        if far[at] <= 0 and chosen and bound is not None:
            break
        chosen.append(at)
        far = np.minimum(far, np.round(1 - x @ x[at], 12))
    return chosen


def k_center_by_group(df: DataFrame, group: str, vector: str, pos: str, quotas: Mapping[str, int], seed: int = 42) -> DataFrame:
    """The rows that ``k_center`` chooses in each group with a quota; rows within a group go by ``pos``.

    Each row's distance to the centers so far is a column. A pass lowers it by the new centers, which are broadcast, and sends
    each group's farthest rows (a bounded number of candidates) to the driver. There the next centers are chosen among
    them as long as the farthest candidate is farther than any row that isn't one could be, so a pass chooses many
    centers; all groups go on in the same pass, and no group is gathered anywhere. Each pass is a written table.

    Rows without a usable vector (``vectors.usable``) or of another dimension than most rows take no part, nor do null positions;
    rows that repeat a position within a group are chosen together. Groups without rows are left out; where all rows equal
    a center a row may be chosen, and returned, several times, as in ``k_center``.
    """
    spark = df.sparkSession
    quotas = {g: q for g, q in quotas.items() if q > 0}
    wanted = df.where(F.col(group).isin(list(quotas)) & F.col(pos).isNotNull() & vectors.usable(vector))
    most = wanted.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None:
        return df.limit(0)
    d = most["d"]
    wanted = wanted.where(F.size(vector) == d)
    kind = df.schema[pos].dataType.simpleString()
    state = cut(wanted.select(F.col(group).alias("g"), F.col(pos).alias("pos"), vectors.normalised(vector).alias("v"), F.lit(9.0).alias("far")), "center-rows")
    counts = {r["g"]: r["count"] for r in state.groupBy("g").count().collect()}  # a row a group
    left = {g: min(q, counts[g]) for g, q in quotas.items() if g in counts}
    first = _at_place(state.select("g", "pos"), {g: int(np.random.RandomState(seed).randint(counts[g])) for g in left})
    chosen = {g: [p] for g, p in first.items()}
    at = F.create_map(*[F.lit(x) for g, p in first.items() for x in (g, p)])[F.col("g")]
    new: dict[str, list] = {}
    for r in state.where(F.col("pos") == at).dropDuplicates(["g", "pos"]).select("g", "v").collect():
        new[r["g"]] = [r["v"]]
    keep = int(min(max(CANDIDATE_BYTES // (8 * d * len(left)), CANDIDATES[0]), CANDIDATES[1]))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("far"), "pos"))
    while open_ := [g for g in left if len(chosen[g]) < left[g]]:
        sent = spark.sparkContext.broadcast({g: np.array(c) for g, c in new.items() if g in open_})
        state = cut(state.where(F.col("g").isin(open_)).mapInArrow(_nearer(sent), f"g string, pos {kind}, v array<double>, far double"), "center-rows")
        sent.destroy()
        # ranks are cut off within each task before the exchange
        top: dict[str, list] = {}
        for r in state.withColumn("_rank", rank).where(F.col("_rank") <= keep + 1).collect():
            top.setdefault(r["g"], []).append(r)
        new = {}
        for g in open_:
            rows = sorted(top[g], key=lambda r: r["_rank"])
            bound, rows = (rows[-1]["far"], rows[:-1]) if len(rows) > keep else (None, rows)
            n = left[g] - len(chosen[g])
            if rows[0]["far"] <= 0:  # all rows equal a center
                chosen[g] += [rows[0]["pos"]] * n
                continue
            rows = sorted(rows, key=lambda r: r["pos"])
            x = np.array([r["v"] for r in rows])
            places = _greedy([r["pos"] for r in rows], x, np.array([r["far"] for r in rows]), bound, n)
            chosen[g] += [rows[i]["pos"] for i in places]
            new[g] = [x[i] for i in places]
    times: dict[tuple, int] = {}
    for g, places in chosen.items():
        for p in places:
            times[g, p] = times.get((g, p), 0) + 1
    picked = spark.createDataFrame([(g, p, n) for (g, p), n in times.items()], f"_g string, _pos {kind}, _times int")  # as many rows as the quotas ask for
    found = wanted.join(F.broadcast(picked), (F.col(group) == F.col("_g")) & (F.col(pos) == F.col("_pos")))
    return found.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_g", "_pos", "_times", "_turn")


def sample(df: DataFrame, text: Column | str, vector: str, pos: str, quotas: Mapping[str, int], packs: Mapping[str, Sequence[str]] | None = None, seed: int = 42) -> DataFrame:
    """The sampled rows with their ``ability``, in order of ``pos``: each class's quota, what is left over from the unclassified."""
    return by_class(df.withColumn("ability", ability(text, packs)), vector, pos, quotas, seed)


def by_class(classed: DataFrame, vector: str, pos: str, quotas: Mapping[str, int], seed: int = 42) -> DataFrame:
    """``sample`` of rows that have their ``ability`` already, and so may come without their texts."""
    counts = {r["ability"]: r["n"] for r in classed.groupBy("ability").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    taken = {k: min(q, counts.get(k, 0)) for k, q in quotas.items()}
    left = sum(quotas.values()) - sum(taken.values())
    every = {k: n for k, n in {**taken, V.UNCLASSIFIED: min(left, counts.get(V.UNCLASSIFIED, 0))}.items() if n > 0}
    return k_center_by_group(classed, "ability", vector, pos, every, seed).orderBy(pos)
