"""Whitening of vectors by a tall-skinny QR: no covariance matrix is ever formed.

Components are scaled to whole numbers, x = floor(scale * c), so sums over any number of rows are exact and don't depend on
their order. Each partition of the fit list (every different x once) centres its rows with the exact sums and reduces them to
a triangular factor batch by batch; factors of ``FAN`` parts at a time are stacked and factored again until one is left. The
right singular vectors of that last factor are the components, its squared singular values over n are the variances.

What a task holds is FAN + 1 triangular factors (dimension^2 doubles each) and a batch of rows; the driver gets the exact sums,
two numbers a component of a vector, and the last factor. Every stage writes its rows to shared storage, so a lost executor repeats
tasks of one stage alone.

Rounding: with S the sums and S = n * q + r, the whole number n * x - S is computed as n * (x - q) - r in 64 bits, exact wherever it
fits them (a double estimate tells; beyond it the estimate is used). Its square sum is taken modulo 2^64, which is exact wherever
the sum itself fits a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import cut, fresh_names, lean

SCALE = 256
#: Triangular factors that one task of the tree stacks.
FAN = 8
#: A direction has variance if its singular value is above this part of the largest one, times the dimension.
RANK_EPS = 4 * np.finfo(np.float64).eps


@dataclass(frozen=True)
class Whitening:
    """n rows of the fit list; q, r: per dimension the sums as n * q + r; components in rows; variances; trace of the covariance."""

    n: int
    q: np.ndarray
    r: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float


def usable(vector: str) -> Column:
    """Whether there is a vector and all its components are there and finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def scaled(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * c) of each component as a long, from its value as a double; values beyond a long become the nearest long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, d)


def _sums(d: int):
    """Per partition and dimension: (dimension, sum of the high 32 bits, sum of the low 32 bits); no batch sum leaves 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = [0] * d, [0] * d
        n = 0
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            high = [a + int(b) for a, b in zip(high, (x >> 32).sum(0))]
            low = [a + int(b) for a, b in zip(low, (x & 0xFFFFFFFF).sum(0))]
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(d), pa.int32()), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64()), "n": pa.array([n] * d, pa.int64())})

    return run


def deviations(x: np.ndarray, n: int, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S modulo 2^64, the same as doubles). The first is exact where the second is below 2^62."""
    with np.errstate(over="ignore"):
        whole = (x - q) * np.int64(n) - r
    about = (x.astype(np.float64) - q.astype(np.float64)) * float(n) - r.astype(np.float64)
    return whole, np.where(np.abs(about) < 2.0**62, whole.astype(np.float64), about)


def square_sums(x: np.ndarray, n: int, q: np.ndarray, r: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n * x - S)^2 of each row as a long; null where it doesn't fit one."""
    whole, near = deviations(x, n, q, r)
    with np.errstate(over="ignore"):
        total = (whole * whole).sum(1)
    about = (near * near).sum(1)
    out, fits = total.tolist(), about < 2.0**63 * (1 - 1e-9)
    for i in np.flatnonzero(~fits):
        exact = sum((n * int(v) - (n * int(a) + int(b))) ** 2 for v, a, b in zip(x[i], q, r))
        out[i] = exact if exact < 1 << 63 else None
    return pa.array(out, pa.int64())


def triangle(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of ``rows`` with a diagonal that isn't negative."""
    r = np.linalg.qr(rows, mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _factors(n: int, q: np.ndarray, r: np.ndarray):
    """A partition's rows as one triangular factor: (part, factor)."""
    d = len(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = np.zeros((0, d))
        for batch in batches:
            x = deviations(_matrix(batch.column(0), d), n, q, r)[1] / n
            if len(x):
                now = triangle(np.concatenate([now, x]))
        if len(now):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "factor": pa.array([now.tobytes()], pa.binary())})

    return run


def _stacked(d: int, fan: int):
    def merge(parts: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(parts.column("part")), kind="stable")
        rows = [np.frombuffer(parts.column("factor")[int(i)].as_buffer(), np.float64).reshape(-1, d) for i in order]
        part = int(np.asarray(parts.column("part"))[order[0]]) // fan
        return pa.table({"part": pa.array([part], pa.int64()), "factor": pa.array([triangle(np.concatenate(rows)).tobytes()], pa.binary())})

    return merge


def fit_list(vectors: DataFrame, x: str = "x") -> DataFrame:
    """The different vectors in column ``x``, each once, as a written table; null ones are left out.

    Copies are merged before the exchange, so a vector that many rows share is no hot key.
    """
    return cut(vectors.select(x).where(F.col(x).isNotNull()).distinct(), "whitening-fit")


def fit(rows: DataFrame, x: str = "x", n_components: int = 4, fan: int = FAN) -> Whitening | None:
    """The whitening of a fit list of whole-number vectors (``scaled``) in column ``x``; it is read twice.

    All vectors must have one length. None if there are no rows or vectors are empty. Components come by falling variance, as
    many as asked for and dimensions are there; each has its largest entry positive (the first of equal ones). Variances of
    directions in which all rows agree, up to rounding, are 0.
    """
    lean(rows.sparkSession)
    rows = rows.select(x)
    first = rows.first()
    d = 0 if first is None else len(first[0])
    if not d:
        return None
    sums = rows.mapInArrow(_sums(d), "dim int, high long, low long, n long").groupBy("dim")
    sums = sums.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]).orderBy("dim").collect()  # a row a dimension
    n = int(sums[0]["n"])
    total = [(int(s["high"]) << 32) + int(s["low"]) for s in sums]
    q, r = np.array([t // n for t in total], np.int64), np.array([t % n for t in total], np.int64)
    parts = cut(rows.mapInArrow(_factors(n, q, r), "part long, factor binary"), "whitening-factors")
    while parts.count() > 1:
        parts = cut(parts.groupBy(F.floor(F.col("part") / F.lit(fan))).applyInArrow(_stacked(d, fan), "part long, factor binary"), "whitening-factors")
    last = np.frombuffer(parts.first()["factor"], np.float64).reshape(-1, d)
    _, s, right = np.linalg.svd(last, full_matrices=True)
    s = np.concatenate([s, np.zeros(d - len(s))])
    s[s <= s[0] * d * RANK_EPS] = 0.0
    right = right * np.where(right[np.arange(d), np.argmax(np.abs(right), axis=1)] < 0, -1.0, 1.0)[:, None]
    k = min(n_components, d)
    return Whitening(n, q, r, right[:k], s[:k] ** 2 / n, float((s**2).sum() / n))


def _project(model: Whitening) -> np.ndarray:
    """Columns that turn centred rows into whitened ones; those of components without variance are undefined."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.variances > 0, model.components.T / np.sqrt(model.variances), np.nan)


def whiten(df: DataFrame, model: Whitening, x: str = "x", name: str = "whitened", deviation: str | None = None) -> DataFrame:
    """``df`` with ``name``: each row's whitened components as doubles, null where a component has no variance, and with
    ``deviation``, if named: the sum over dimensions of (n * x - S)^2 as a long, null where it doesn't fit one.

    ``x`` must not be null. Columns of these names are replaced, all others stay. One narrow pass, no exchange.
    """
    lean(df.sparkSession)
    d, k, turn = len(model.q), len(model.components), _project(model)
    made = [name] + ([deviation] if deviation else [])
    kept = df.drop(*made)
    at = kept.columns.index(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(at), d)
            w = (deviations(rows, model.n, model.q, model.r)[1] / model.n) @ turn
            values = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w).ravel())
            columns = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * k + 1, k), pa.int32()), values)]
            if deviation:
                columns.append(square_sums(rows, model.n, model.q, model.r))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *made])

    added = [StructField(name, ArrayType(DoubleType()))] + ([StructField(deviation, LongType())] if deviation else [])
    return kept.mapInArrow(run, StructType([*kept.schema.fields, *added]))


def identity_error(rows: DataFrame, model: Whitening, x: str = "x") -> float | None:
    """The largest absolute entry of (covariance of the whitened fit list - identity), over the components with variance; None
    if none has any. Spark's covariances are centred and merged in its own partial aggregates."""
    live = np.flatnonzero(model.variances > 0).tolist()
    if not live:
        return None
    w = whiten(rows.select(x), model, x)
    entries = [(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]), float(i == j)) for i in live for j in live if i <= j]
    got = w.agg(*[F.abs(c - F.lit(one)).alias(f"c{k}") for k, (c, one) in enumerate(entries)]).first()
    return float(max(got))


def whitened(vectors: DataFrame, n_components: int = 4, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every usable row and component.

    Rows whose vector is null or holds a null or non-finite component are left out; so are those of another length than most rows
    have (of equally frequent lengths the shorter counts), and empty vectors. Repeated rows and null ids are kept as they are. A
    component in which the fit list has no variance has null ``whitened`` and 0 ``explained``; where no component has any,
    ``identity_error`` is null. An empty table, or one without a usable row, gives no rows.
    """
    spark = vectors.sparkSession
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    length = F.size(vector)
    most = vectors.where(usable(vector) & (length > 0)).groupBy(length.alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None:
        return spark.createDataFrame([], ddl)
    rows = vectors.where(usable(vector) & (length == most["d"])).select(F.col(id_col).cast("long").alias("vec_id"), scaled(vector).alias("x"))
    different = fit_list(rows)
    model = fit(different, "x", n_components)
    error = identity_error(different, model)
    shares = model.variances / model.trace if model.trace > 0 else np.zeros(len(model.variances))
    made = whiten(rows, model, "x", "w", "deviation")
    (at,) = fresh_names(made, 1)
    each = made.select("vec_id", "deviation", F.posexplode("w").alias(at, "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col(at) + 1)
    return each.select("vec_id", (F.col(at) + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
