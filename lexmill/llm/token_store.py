"""Token ids as bit- or byte-plane shuffled blocks with a chunk index.

Format. A store is a folder with two Parquet tables, written by Spark's own writers, so that the commit protocol covers
lost executors and any file system will do:

* ``blocks``: one row a block of ``block_ids`` ids (the last of a part may be shorter): part, chunk, n_ids, ``planes``
  (the zstandard frames of the planes, lowest first; planes that are all zero at the top are left out), ``before`` and
  ``docs_before`` (ids of the part, and documents that end in it, before the block), ``opens`` (a document begins with the
  block), and for the documents that end in the block their ids and end offsets within the part.
* ``index``: one row a block without the payload: part, chunk, first_id (place in the whole store), n_ids, plane sizes, mode.
  Readers find the parts' places and any range of ids by it.

Planes: ids are little-endian 32-bit integers; ``byte`` mode puts the k-th byte of every id into plane k, ``bit`` mode the
k-th bit of every id (packed, eight ids a byte).

Parts are ranges of (doc_id, hash of the text): ascending doc_id order, a null doc_id first; rows that repeat a doc_id stay
side by side, ordered by the hash of their text; one doc_id with very many rows is spread over parts.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_lengths, cut, lean, ragged, split_words, text_groups, tidy

BLOCK_SCHEMA = "part int, chunk long, n_ids long, planes array<binary>, before long, docs_before long, opens boolean, doc_ids array<long>, doc_ends array<long>"
INDEX_SCHEMA = "part int, chunk long, first_id long, n_ids long, plane_bytes array<int>, mode string"
PIECE_SCHEMA = "part int, ordinal long, doc_id long, chunk long, n long, begin long, crc long, bytes binary"


def to_planes(ids: np.ndarray, mode: str, level: int) -> list[bytes]:
    """The compressed planes of one block, without the zero planes at the top."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    most = int(ids.max()) if len(ids) else 0
    pack = zstandard.ZstdCompressor(level=level).compress
    if mode == "byte":
        planes = ids.view(np.uint8).reshape(-1, 4).T
        return [pack(planes[k].tobytes()) for k in range((most.bit_length() + 7) // 8)]
    return [pack(np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes()) for k in range(most.bit_length())]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    if mode == "byte":
        out = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            out[:, k] = np.frombuffer(unpack(plane), np.uint8)
        return out.view("<u4").ravel()
    ids = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(unpack(plane), np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return ids


#: Words of letters with marks behind, the letters all ASCII or Latin-1: their pieces are the letters and the marks.
_PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*[!-&(-/:-@\\[-`{-~]*$"
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_LONGEST = 64
#: Different pieces whose ids an encoder keeps.
KNOWN = 1 << 17


def byte_letters() -> dict[int, str]:
    """What a Latin-1 letter is in the alphabet of byte-level tokenizers: bytes without a visible sign follow U+00FF in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    sign = lambda b: chr(b) if b in visible else chr(256 + hidden.index(b))
    return {c: "".join(map(sign, chr(c).encode())) for c in range(128, 256)}


class Encoder:
    """Ids of whole texts from a tokenizer file, by its different words where its pieces never span ASCII white space.

    Everything is encoded by the tokenizers library. Words of plain letters and marks of a byte-level merge table, which its
    normalizer lowers and its pre-tokenizer parts into letters and marks, are lowered and parted on Arrow arrays and go to the
    library's model piece by piece; all other words, and whole texts of tokenizers of another kind, go through all its steps.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        marks = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        splits = [x for x in steps if x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert")]
        self.by_word = bool(marks and splits and "\\s" in splits[0]["pattern"].get("Regex", "") and not spec.get("post_processor") and not spec.get("truncation"))
        model = spec["model"]
        norms = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers") or []]
        known = "[\\p{L}]+" in splits[0]["pattern"].get("Regex", "") and "[^\\s\\p{L}\\p{N}]+" in splits[0]["pattern"].get("Regex", "") if splits else False
        level = steps and steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space") and not steps[-1].get("use_regex")
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")) and norms == ["NFC", "Replace", "Lowercase"]
        self.plain = bool(self.by_word and known and level and plain)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.places: dict[str, int] = {}
        self.known = (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, count) of different lowered pieces, by the library's model; none for an empty piece.

        The first ``KNOWN`` different pieces that this encoder meets are kept, so they are looked up from then on.
        """
        texts = pieces.to_pylist()
        at = np.fromiter(map(self.places.get, texts, itertools.repeat(-1)), np.int64, len(texts))
        tokenize, out, counts = self.model.tokenize, [], []
        new = np.flatnonzero(at < 0)
        for i in new.tolist():
            p = texts[i]
            found = [t.id for t in tokenize(p if p.isascii() else p.translate(self.letters))]
            out += found
            counts.append(len(found))
        ids, starts, n = self.known
        own = np.array(counts, np.int64)
        begin = len(ids) + np.cumsum(own) - own
        ids = np.concatenate([ids, np.array(out, np.uint32)])
        start, count = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        start[new], count[new] = begin, own
        old = np.flatnonzero(at >= 0)
        start[old], count[old] = starts[at[old]], n[at[old]]
        if len(new) and (room := KNOWN - len(self.places)) > 0:
            kept = new[:room].tolist()
            self.places.update(zip([texts[i] for i in kept], itertools.count(len(self.places))))
            last = int(begin[len(kept) - 1] + own[len(kept) - 1])
            self.known = (ids[:last].copy(), np.concatenate([starts, begin[: len(kept)]]), np.concatenate([n, own[: len(kept)]]))
        return ids, start, count

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, count) of different words."""
        n = len(words)
        fast = np.zeros(n, bool)
        parts, starts, counts, used = [], np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        if self.plain:
            fast = np.asarray(pc.and_(pc.match_substring_regex(words, _PLAIN), pc.less_equal(pc.binary_length(words), _LONGEST)))
            own = words.filter(pa.array(fast))
            stems = pc.utf8_rtrim(own, characters=_MARKS)
            size, whole = (np.asarray(pc.binary_length(x), dtype=np.int64) for x in (stems, own))
            raw = own.cast(pa.large_binary())
            behind = np.flatnonzero(whole > size)
            tails = _slices(raw, behind, size)
            stems = pc.utf8_lower(stems).dictionary_encode()
            tails = tails.dictionary_encode()
            ids_a, at_a, n_a = self.pieces(stems.dictionary)
            ids_b, at_b, n_b = self.pieces(tails.dictionary.cast(pa.large_string()))
            a, b = np.asarray(stems.indices).astype(np.int64), np.asarray(tails.indices).astype(np.int64)
            first, second = n_a[a], np.zeros(len(a), np.int64)
            second[behind] = n_b[b]
            place = np.cumsum(first + second) - first - second
            out = np.zeros(int((first + second).sum()), np.uint32)
            out[ragged(place, first)] = ids_a[ragged(at_a[a], first)]
            out[ragged((place + first)[behind], n_b[b])] = ids_b[ragged(at_b[b], n_b[b])]
            starts[fast], counts[fast] = place, first + second
            parts.append(out)
            used = len(out)
        rest = np.flatnonzero(~fast)
        if len(rest):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words.take(pa.array(rest)).to_pylist(), add_special_tokens=False)]
            counts[rest] = [len(i) for i in ids]
            starts[rest] = used + np.cumsum(counts[rest]) - counts[rest]
            parts.append(np.array([i for own in ids for i in own], np.uint32))
        return np.concatenate([np.zeros(0, np.uint32), *parts]), starts, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each)."""
        if not self.by_word:
            each = [e.ids for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)
        offsets, words = split_words(texts, lower=False)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = words.dictionary_encode()
        ids, starts, counts = self.words(coded.dictionary)
        codes = np.asarray(coded.indices)
        lengths = counts[codes]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids[ragged(starts[codes], lengths)], np.diff(total[offsets])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, as this process has it: workers serve many tasks, and reading the file takes as long as many texts."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(raw: pa.Array, rows: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The bytes from ``begin`` on of the given rows."""
    edges = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    a, n = edges[rows] + begin[rows], edges[rows + 1] - edges[rows] - begin[rows]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[ragged(a, n)] if len(rows) else np.zeros(0, np.uint8)
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def _encoded(path: str, end_id: int, kind: str):
    """doc_id, tie and the ids of each text with the end id, as little-endian integers of ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(path)
        for batch in batches:
            texts = batch.column("text")
            for a, b in text_groups(byte_lengths(texts), 4 << 20):
                ids, n = use.encode(texts.slice(a, b - a))
                out = np.full(len(ids) + len(n), end_id, kind)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                ends = np.concatenate([[0], np.cumsum(n + 1) * out.itemsize]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("tie").slice(a, b - a), packed], names=["doc_id", "tie", "ids"])

    return run


def _blocks(kind: str, block_ids: int, mode: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, held_n, docs, ends, chunk = [], 0, [], [], 0
        done, docs_done, last_end = 0, 0, 0  # ids and documents of the part in blocks so far, and where the last of these ended

        def block(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal docs, ends, chunk, done, docs_done, last_end
            k = int(np.searchsorted(np.array(ends, np.int64), done + len(ids), side="right"))
            row = {"part": part, "chunk": chunk, "n_ids": len(ids), "planes": to_planes(ids, mode, level), "before": done, "docs_before": docs_done, "opens": last_end == done, "doc_ids": docs[:k], "doc_ends": ends[:k]}
            last_end = ends[k - 1] if k else last_end
            docs, ends, chunk, done, docs_done = docs[k:], ends[k:], chunk + 1, done + len(ids), docs_done + k
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        end_of_part = 0
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            lengths = byte_lengths(batch.column("ids"))
            for a, b in text_groups(lengths, 4 << 20):
                out = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in batch.column("ids")[a:b]])
                held.append(out)
                held_n += len(out)
                docs += names[a:b]
                ends += (end_of_part + np.cumsum(lengths[a:b] // out.itemsize)).tolist()
                end_of_part += len(out)
                if held_n >= block_ids:
                    joined = np.concatenate(held)
                    full = held_n // block_ids * block_ids
                    for i in range(0, full, block_ids):
                        yield block(joined[i : i + block_ids])
                    held, held_n = [joined[full:]], held_n - full
        if held_n:
            yield block(np.concatenate(held))

    return run


_SCHEMA = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n_ids", pa.int64()), ("planes", pa.list_(pa.binary())), ("before", pa.int64()), ("docs_before", pa.int64()), ("opens", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64()))])
_PIECES = pa.schema([("part", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("begin", pa.int64()), ("crc", pa.int64()), ("bytes", pa.binary())])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, block_ids: int = 65_536, mode: str = "byte", level: int = 3) -> None:
    """Encodes ``docs`` (doc_id, text; other columns are ignored) into a store at ``path``.

    Texts are encoded where they are read and written as ids of two bytes (four, if the tokenizer has more). One range exchange puts
    those in doc_id order, so no text is ever exchanged or sorted; transposing and compressing happen behind it, a block at a
    time. A null text is the empty text and gives the end id alone. An empty table gives a store without blocks. ``tokenizer``
    names a file that executors can read under that path.
    """
    if mode not in ("byte", "bit"):
        raise ValueError("mode is byte or bit")
    spark = docs.sparkSession
    lean(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id)
    kind = "<u2" if most < 1 << 16 else "<u4"
    encoded = cut(rows.mapInArrow(tidy(_encoded(tokenizer, end_id, kind)), "doc_id long, tie long, ids binary"), "encoded-ids")
    ordered = encoded.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    blocks = ordered.mapInArrow(tidy(_blocks(kind, block_ids, mode, level)), BLOCK_SCHEMA)
    blocks.write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(f"{path}/blocks")
    written = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    parts = written.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a part: as many as the write had tasks
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    index = written.select("part", "chunk", "before", "n_ids", F.transform("planes", lambda p: F.length(p)).alias("plane_bytes")).join(parts, "part")
    index.select("part", "chunk", (F.col("first") + F.col("before")).alias("first_id"), "n_ids", "plane_bytes", F.lit(mode).alias("mode")).write.parquet(f"{path}/index")


def _index(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(index, the store's mode)."""
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")
    found = index.select("mode").limit(1).collect()
    return index, found[0]["mode"] if found else "byte"


def _pieces(mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["n_ids"], mode)
                raw = memoryview(ids.tobytes())
                first, ends = row["before"], row["doc_ends"]
                out, at = [], 0
                for k, (doc, end) in enumerate(zip(row["doc_ids"], ends)):
                    to = end - first
                    whole = k > 0 or row["opens"]
                    piece = raw[4 * at : 4 * to]
                    out.append({"part": row["part"], "ordinal": row["docs_before"] + k, "doc_id": doc, "chunk": row["chunk"], "n": to - at, "begin": first + at, "crc": zlib.crc32(piece) if whole else None, "bytes": None if whole else bytes(piece)})
                    at = to
                if at < len(ids):
                    out.append({"part": row["part"], "ordinal": row["docs_before"] + len(ends), "doc_id": None, "chunk": row["chunk"], "n": len(ids) - at, "begin": first + at, "crc": None, "bytes": bytes(raw[4 * at :])})
                yield pa.RecordBatch.from_pylist(out, schema=_PIECES)

    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a store, each block decoded on its own.

    Payloads stay where they are read: only digests go on, and of a document that spans blocks its pieces, to be brought together
    by (part, place in the part). A part's place in the store comes from the index.
    """
    index, mode = _index(spark, path)
    pieces = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").mapInArrow(tidy(_pieces(mode)), PIECE_SCHEMA)
    docs = pieces.groupBy("part", "ordinal").agg(
        F.max("doc_id").alias("doc_id"),
        F.min("begin").alias("begin"),
        F.sum("n").alias("n_tokens"),
        F.max("crc").alias("crc"),
        F.sort_array(F.collect_list(F.when(F.col("bytes").isNotNull(), F.struct("chunk", "bytes")))).alias("split"),
    )
    joined = F.aggregate("split", F.lit(b""), lambda a, x: F.concat(a, x["bytes"]))
    first = index.groupBy("part").agg(F.min("first_id").alias("first"))  # a row a part
    return docs.join(F.broadcast(first), "part").select("doc_id", (F.col("first") + F.col("begin")).alias("start"), "n_tokens", F.coalesce("crc", F.crc32(joined)).alias("ids_crc32"))


def _decoded(mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["part", "chunk", "n_ids", "planes"]).to_pylist():
                ids = from_planes(row["planes"], row["n_ids"], mode)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["part", "chunk", "ids"])

    return run


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """part, chunk and the ids of every block, for readers that want the stream itself."""
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").mapInArrow(_decoded(_index(spark, path)[1]), "part int, chunk long, ids array<long>")


def read_range(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """first_id and the ids of the store's places ``begin`` to ``end`` (exclusive), a row a block: the index says which blocks
    to decode, and the scan reads those of their parts alone."""
    index, mode = _index(spark, path)
    wanted = index.where((F.col("first_id") < end) & (F.col("first_id") + F.col("n_ids") > begin)).select("part", "chunk", "first_id")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").join(wanted.drop("first_id"), ["part", "chunk"], "left_semi")
    ids = blocks.mapInArrow(_decoded(mode), "part int, chunk long, ids array<long>").join(wanted, ["part", "chunk"])
    skip = F.greatest(F.lit(begin) - F.col("first_id"), F.lit(0))
    take = F.least(F.lit(end) - F.col("first_id"), F.size("ids").cast("long")) - skip
    return ids.select((F.col("first_id") + skip).alias("first_id"), F.slice("ids", (skip + 1).cast("int"), take.cast("int")).alias("ids"))
