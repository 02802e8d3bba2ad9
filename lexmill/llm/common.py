"""Pieces that the training-data operators share: shared storage, word columns, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, drop_path, shared_dir, staging_path  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are worked on in groups of about this many bytes, so that a worker's memory does not follow the batch size.
GROUP_BYTES = 3 << 20
#: Rows and bytes that go to a Python worker at once at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def lean(spark: SparkSession) -> None:
    """Small Arrow batches in this session: an executor's memory then doesn't follow the rows' sizes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """``run`` over a partition's batches, with freed memory given back to the system behind it: workers are used again."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have, in whatever case."""
    taken, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if (name := f"_lx{k}") not in taken:
            out.append(name)
        k += 1
    return out


def id_bucket(column: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % modulus


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_groups(lengths: np.ndarray, limit: int = GROUP_BYTES):
    """(begin, end) runs of rows with about ``limit`` bytes each, one row at least."""
    if not len(lengths):
        return
    group = (np.cumsum(lengths) - lengths) // limit
    edges = np.flatnonzero(np.diff(group)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(lengths)])


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)


def fresh(texts: pa.Array) -> pa.Array:
    """A copy of a string array with buffers of its own, nulls as ''.

    Some string kernels read the wrong bytes of an array whose first offset isn't zero, as casts of slices have.
    """
    texts = pc.take(texts, pa.array(np.arange(len(texts))))
    return pc.fill_null(texts.cast(pa.large_string()), "")


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Words of each text: (offsets of the texts into the words, all words). A null text has none."""
    texts = fresh(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.values
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    full = np.asarray(pc.not_equal(words, ""))
    if not full.all():
        count = np.concatenate([[0], np.cumsum(full)])
        offsets = count[offsets]
        words = words.filter(pa.array(full))
    return offsets, words


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word of an Arrow array, from its bytes alone, without a Python loop over the words.

    Each word is read as 8-byte little-endian pieces, mixed in order; the length is mixed in last.
    """
    words = words.cast(pa.large_binary())
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64, n + 1, words.offset * 8)
    data = words.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = np.concatenate([raw[: offsets[-1]], np.zeros(8, np.uint8)])
    begin, length = offsets[:-1], np.diff(offsets)
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    live = np.arange(n)
    view = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))
    step = 0
    while len(live):
        rest = length[live] - step
        live = live[rest > 0]
        rest = rest[rest > 0]
        if not len(live):
            break
        piece = np.ascontiguousarray(view[begin[live] + step]).view(np.uint64).ravel()
        keep = np.minimum(rest, 8).astype(np.uint64)
        piece &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - keep * np.uint64(8))
        h[live] = mix((h[live] ^ piece) * np.uint64(0xD6E8FEB86659FD93))
        step += 8
    return mix(h ^ length.astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shift and multiply, twice."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the texts, 64-bit hash of every word in order); each different word is hashed once."""
    offsets, words = split_words(texts, lower)
    if not len(words):
        return offsets, np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    return offsets, hash_words(coded.dictionary)[np.asarray(coded.indices)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, joined."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)
