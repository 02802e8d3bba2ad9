"""Repeated passages by content-defined chunking.

A gear hash rolls over the UTF-8 bytes: H(i) = sum over j < 8 of gear[byte(i - j)] << 4 * j, modulo 2^32, so it depends on the
last 8 bytes alone, and a passage's chunks are its own from its first WINDOW + MIN bytes on. A chunk ends where the upper bits of H are zero and no other such place lies within the last ``MIN``
bytes; a stretch without an end is cut where fewer bits are zero, then where H is smallest, and every ``MAX`` bytes as a last
resort. As ends
depend on the bytes near them, an insertion moves the chunks after it without changing them. Chunks are compared by a
128-bit digest; neighbouring repeated chunks of a document are joined to spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_lengths, cut, fresh_names, lean, text_groups, tidy

WINDOW, SHIFT, MIN, MAX = 8, 4, 10, 256
STRONG, WEAK = 27, 28  # a place is an end if H >> STRONG == 0, in a long stretch already if H >> WEAK == 0
GEAR = np.random.default_rng(20_240_501).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_CHUNKS = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """H at every byte, by doubling the window; places with less than a window before them use what there is."""
    h = GEAR[raw]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(SHIFT * width))
        width *= 2
    return h


def chunk_ends(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text, the text's end last; none for an empty text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    h = gear_hash(raw)
    weak = np.flatnonzero(h >> np.uint32(STRONG) == 0) + 1  # every candidate of the stronger rule is one of the weaker
    if len(weak):
        weak = weak[np.diff(weak, prepend=-MIN) >= MIN]
        weak = weak[weak < n]
    ends = np.concatenate([weak, [n]])
    gaps = np.diff(ends, prepend=0)
    long = np.flatnonzero(gaps > MAX)
    if len(long):
        more = []
        for k in long.tolist():
            b, a = int(ends[k]), int(ends[k] - gaps[k])
            spare = np.flatnonzero(h[a:b] >> np.uint32(WEAK) == 0) + 1 + a
            spare = spare[(np.diff(spare, prepend=a - MIN) >= MIN) & (spare < b)] if len(spare) else spare
            stops = np.concatenate([[a], spare, [b]])
            for s, t in zip(stops[:-1].tolist(), stops[1:].tolist()):
                if t - s > MAX:  # the smallest hash marks every turn of a text that repeats itself
                    own = h[s + WINDOW : t]
                    turn = np.flatnonzero(own == own.min()) + 1 + s + WINDOW
                    turn = turn[(np.diff(turn, prepend=s - MIN) >= MIN) & (turn < t)]
                    more.append(turn)
                    for u, v in zip([s, *turn.tolist()], [*turn.tolist(), t]):
                        more.append(np.arange(u + MAX, v, MAX))
            more.append(spare)
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_intdigest
    for batch in batches:
        texts, ids = batch.column("text"), batch.column("doc_id")
        for a, b in text_groups(byte_lengths(texts), 2 << 20):
            rows = [[], [], []]
            marks: list[int] = []
            for k in range(a, b):
                text = texts[k].as_py()
                raw = text.encode() if text else b""
                if not raw:
                    continue
                ends = chunk_ends(np.frombuffer(raw, np.uint8))
                starts = np.concatenate([[0], ends[:-1]])
                rows[0].append(np.full(len(ends), k))
                rows[1].append(starts)
                rows[2].append(ends)
                marks += [digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
            if marks:
                both = np.frombuffer(b"".join(m.to_bytes(16, "little") for m in marks), np.int64).reshape(-1, 2)
                own, begin, end = (np.concatenate(r) for r in rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), pa.array(begin), pa.array(end), pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], schema=_CHUNKS)


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, begin, end (byte offsets) and the digest (d1, d2) of every chunk. A null or empty text has none."""
    lean(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0).mapInArrow(tidy(_chunk), "doc_id long, begin long, end long, d1 long, d2 long")


def repeated_spans(docs: DataFrame, min_bytes: int = 64, within: bool = True) -> DataFrame:
    """doc_id, begin, end, n_chunks, first_doc, repeats: spans whose chunks also occur elsewhere, of ``min_bytes`` or more.

    ``first_doc`` is the smallest doc_id that holds one of the span's chunks; ``repeats`` (begin, end pairs that are not the
    first occurrence of their chunk) lists what ``drop_repeats`` takes out. Without ``within``, only chunks of two or more documents
    count; with it, also those that one document repeats. Chunks are
    grouped by digest with partial counts, so a passage in a third of all documents is one row a task before the exchange; the
    join back can be split by Spark where a digest is hot. Rows that repeat a doc_id are one document whose chunks lie over
    each other. Documents with a null id take no part. Offsets are byte offsets in UTF-8. Of a passage the chunks at its two ends
    may be cut off with what is beside them, so repeats little longer than ``min_bytes`` can be missed.
    """
    every = cut(chunks(docs.where(F.col("doc_id").isNotNull())), "chunks")
    first = F.min(F.struct("doc_id", "begin")).alias("first")
    twice = every.groupBy("d1", "d2").agg(first, F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") > 1 if within else F.col("last") != F.col("first.doc_id"))
    twice = twice.select("d1", "d2", F.col("first.doc_id").alias("first_doc"), F.col("first.begin").alias("first_begin"))
    found = every.join(twice, ["d1", "d2"]).select("doc_id", "begin", "end", "first_doc", ((F.col("doc_id") != F.col("first_doc")) | (F.col("begin") != F.col("first_begin"))).alias("again"))
    w = Window.partitionBy("doc_id").orderBy("begin", "end")
    opens = F.when(F.col("begin") <= F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    spans = (
        found.withColumn("opens", opens)
        .withColumn("span", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "span")
        .agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_chunks"), F.min("first_doc").alias("first_doc"), F.sort_array(F.collect_list(F.when(F.col("again"), F.struct("begin", "end")))).alias("repeats"))
    )
    return spans.where(F.col("end") - F.col("begin") >= min_bytes).drop("span")


def drop_repeats(docs: DataFrame, min_bytes: int = 64) -> DataFrame:
    """``docs`` with every chunk of a repeated span taken out of ``text`` but for its first occurrence.

    All rows and columns stay, whatever the other columns' names. Null and empty texts and rows with a null doc_id stay as they are;
    rows that repeat a doc_id lose the same places; an empty table stays empty.
    """
    own, name = fresh_names(docs, 2)
    cuts = repeated_spans(docs, min_bytes).groupBy(F.col("doc_id").alias(own)).agg(F.sort_array(F.flatten(F.collect_list("repeats"))).alias(name))
    joined = docs.join(cuts, F.col("doc_id").cast("long") == F.col(own), "left")
    fields = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist()):
                if text and spans:
                    raw, keep, at = text.encode(), [], 0
                    for s in spans:
                        keep.append(raw[at : max(at, s["begin"])])
                        at = max(at, s["end"])
                    text = b"".join([*keep, raw[at:]]).decode(errors="ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if f == "text" else batch.column(f) for f in fields], names=fields)

    return joined.select(*fields, name).mapInArrow(run, docs.schema)
