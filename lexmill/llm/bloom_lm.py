"""n-gram language model in a log-frequency Bloom filter (after Talbot and Osborne, 2007).

A count c is kept as its level 1 + floor(log2 c); an n-gram is put into the filter once for each level up to its own. Asking for
level 1, 2, ... until the first miss gives the level back, too high with small probability, never too low. The probability
of a word after its history interpolates over the orders:

    p_n(w | h) = b * min(1, c(hw) / c(h)) + (1 - b) * p_(n-1)(w | h'),   b = c(h) / (c(h) + PRIOR)
    p_1(w) = (c(w) + 1) / (N + V + 1)

with counts at the middle of their level, as the filter gives them, for all orders; N and V are exact.

Counting: each task counts its n-grams by 64-bit hash and sends them, packed, to the bucket of the hash; a bucket adds up its
packets, keeps the exact word counts, and fills its own stretch of the filter, which has ENTRY_BITS bits for each n-gram and
level in it. So the filter grows with the different n-grams, and one level is taken for there by mistake with a probability of
(1 - exp(-PROBES / ENTRY_BITS))^PROBES = 0.011, whatever the input's size.

A filter of at most ``send_bits`` bits is broadcast. A larger one stays a table of stretches: texts are written as bundles of
different n-grams and places, each bundle asks each stretch once for the levels of its n-grams there, and the answers are joined
to the bundle. Both give the same scores.

The exact unigram score beside the model needs exact counts: they are broadcast if there are at most ``send_words`` different
words. Beyond that they come with the answers of the stretches or, where the filter is small enough to be sent, are joined
through an exchange of (document, word) counts. All give the same numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_lengths, cut, lean, mix, ragged, text_groups, tidy, word_hashes

ENTRY_BITS, MIN_BITS, PROBES, PRIOR = 12, 20, 3, 5.0
SEND_BITS = 1 << 30
BUCKET_TEXT = 23  # log2 of the bytes of text a bucket, at most: a worker holds one bucket's packets
FILL = 1 << 18  # n-grams whose places in the filter are worked out at once
ASKED = 32 << 20  # bytes of n-grams that a task asks a stretch for at once
SEND_WORDS = 6_000_000
END, START = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
FLUSH = 2_000_000  # tokens counted by a task before it sends what it has
_PACKET = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_PACKET_DDL = "bucket int, n int, keys binary, counts binary"


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes of the words of each text with END behind them)."""
    offsets, h = word_hashes(texts)
    n = len(texts)
    ends = offsets + np.arange(n + 1)
    out = np.full(ends[-1], END, np.uint64)
    out[ragged(ends[:-1], np.diff(offsets))] = h
    return ends, out


def grams(offsets: np.ndarray, tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 ... order the hash of the n-gram that ends at each token; histories begin with START."""
    out, back = [tokens], tokens
    first = offsets[:-1][np.diff(offsets) > 0]
    for n in range(2, order + 1):
        back = np.concatenate([[START], back[:-1]])
        back[first] = START
        out.append(mix(out[-1] * np.uint64(0xA24BAED4963EE407) + mix(back + np.uint64(n))))
    return out


def _count(buckets: int, order: int):
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def packets(n: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        keys, counts = np.unique(keys, return_counts=True)
        where = np.searchsorted(keys >> shift if buckets > 1 else np.zeros(len(keys), np.uint64), np.arange(buckets + 1, dtype=np.uint64))
        cuts = [(b, where[b], where[b + 1]) for b in range(buckets) if where[b] < where[b + 1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _, _ in cuts], pa.int32()), pa.array([n] * len(cuts), pa.int32()), pa.array([keys[i:j].tobytes() for _, i, j in cuts], pa.binary()), pa.array([counts[i:j].astype(np.uint32).tobytes() for _, i, j in cuts], pa.binary())],
            schema=_PACKET,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        n = 0
        for batch in batches:
            texts = batch.column("text")
            for a, b in text_groups(byte_lengths(texts)):
                offsets, tokens = token_hashes(texts.slice(a, b - a))
                for k, g in enumerate(grams(offsets, tokens, order)):
                    held[k].append(g)
                if order > 1:  # START stands before each text once: a history like any word
                    held[0].append(np.full(b - a, START))
                n += len(tokens)
                if n >= FLUSH:
                    for k in range(order):
                        yield from packets(k + 1, np.concatenate(held[k]))
                    held, n = [[] for _ in range(order)], 0
        for k in range(order):
            if held[k]:
                yield from packets(k + 1, np.concatenate(held[k]))

    return run


def stretches(keys: np.ndarray, buckets: int, bits: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bit, bits) of the stretch each n-gram lies in. ``bits``: of each bucket, or log2 of a filter in equal stretches."""
    sizes = np.full(buckets, (1 << int(bits)) // buckets, np.uint64) if np.ndim(bits) == 0 else np.asarray(bits, np.uint64)
    which = (keys >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
    return (np.cumsum(sizes) - sizes)[which], sizes[which]


def _places(keys: np.ndarray, level: int, base: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    h = mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [base + ((((h + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) * own) >> np.uint64(32)) for i in range(PROBES)]


def positions(keys: np.ndarray, level: int, buckets: int, bits: int | np.ndarray) -> list[np.ndarray]:
    """The bits of (n-gram, level) in the whole filter; a bucket's n-grams lie in its own stretch."""
    return _places(keys, level, *stretches(keys, buckets, bits))


_MODEL_DDL = "bucket int, kind int, keys binary, counts binary, tokens long, words long"
_MODEL = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64()), ("words", pa.int64())])


def merged(packets: list[tuple[pa.Scalar, pa.Scalar]]) -> tuple[np.ndarray, np.ndarray]:
    """(ascending n-grams, their counts) of some packets of keys and counts, which are read where they lie."""
    keys = np.concatenate([np.frombuffer(k.as_buffer(), np.uint64) for k, _ in packets])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    counts = np.concatenate([np.frombuffer(c.as_buffer(), np.uint32) for _, c in packets])[order]
    del order
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts, dtype=np.int64)


def fill(filled: np.ndarray, keys: np.ndarray, most: np.ndarray) -> None:
    """Sets the bits of all levels of each n-gram in the bytes of a stretch; n-grams go in slices."""
    size = np.uint64(8 * len(filled))
    for i in range(0, len(keys), FILL):
        left, own, level = keys[i : i + FILL], most[i : i + FILL], 1
        while len(left):
            for p in _places(left, level, np.uint64(0), size):
                np.bitwise_or.at(filled, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
            level += 1
            left, own = left[own >= level], own[own >= level]


def _sum_up():
    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        orders = np.asarray(group.column("n"))
        held = []
        out_keys, out_counts, tokens, words = b"", b"", 0, 0
        for n in np.unique(orders).tolist():
            keys, counts = merged([(group.column("keys")[i], group.column("counts")[i]) for i in np.flatnonzero(orders == n).tolist()])
            held.append((keys, (np.floor(np.log2(counts)) + 1).astype(np.uint8)))
            if n == 1:
                real = keys != START
                out_keys, out_counts = keys[real].tobytes(), counts[real].tobytes()
                tokens, words = int(counts[real].sum()), int(real.sum())
        filled = np.zeros(max(8, -(-ENTRY_BITS * sum(int(most.sum(dtype=np.int64)) for _, most in held) // 8)), np.uint8)
        while held:
            fill(filled, *held.pop())
        return pa.Table.from_arrays([pa.array([bucket] * 2, pa.int32()), pa.array([0, 1], pa.int32()), pa.array([out_keys, filled.tobytes()], pa.binary()), pa.array([out_counts, b""], pa.binary()), pa.array([tokens, 0], pa.int64()), pa.array([words, 0], pa.int64())], schema=_MODEL)

    return run


class Model:
    """The filter's stretches with N, V and the table of exact word counts."""

    def __init__(self, table: DataFrame, buckets: int, order: int):
        self.table, self.buckets, self.order = table, buckets, order
        self.sizes, self.tokens, self.words = np.zeros(buckets, np.uint64), 0, 0  # bits of each bucket
        for r in table.select("bucket", "kind", F.octet_length("keys").alias("n"), "tokens", "words").toLocalIterator():
            self.tokens, self.words = self.tokens + r["tokens"], self.words + r["words"]
            if r["kind"] == 1:
                self.sizes[r["bucket"]] = 8 * r["n"]

    def filter(self) -> np.ndarray:
        ends = np.cumsum(self.sizes // np.uint64(8)).astype(np.int64)
        out = np.zeros(int(ends[-1]), np.uint8)
        for r in self.table.where("kind = 1").select("bucket", "keys").toLocalIterator():
            out[ends[r["bucket"]] - len(r["keys"]) : ends[r["bucket"]]] = np.frombuffer(r["keys"], np.uint8)
        return out

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(ascending word hashes, counts): buckets are ranges of hashes."""
        rows = list(self.table.where("kind = 0").select("bucket", "keys", "counts").orderBy("bucket").toLocalIterator())
        keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
        return np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["counts"], np.int64) for r in rows]])


def fit(docs: DataFrame, order: int = 2) -> Model:
    """Counts all of ``docs`` (text; null: empty, one END)."""
    spark = docs.sparkSession
    lean(spark)
    docs = docs.select("text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    bits = max(MIN_BITS, int(4 * size).bit_length())
    buckets = 1 << max(4, min(bits - 14, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()), (int(size) >> BUCKET_TEXT).bit_length())
    packets = docs.mapInArrow(tidy(_count(buckets, order)), _PACKET_DDL)
    return Model(cut(packets.groupBy("bucket").applyInArrow(_sum_up(), _MODEL_DDL), "bloom-lm", large_rows=True), buckets, order)


def levels(keys: np.ndarray, filled: np.ndarray, buckets: int, bits: int | np.ndarray) -> np.ndarray:
    """The level of each n-gram: membership is asked for level after level until it fails."""
    base, own = stretches(keys, buckets, bits)
    out, live, level = np.zeros(len(keys), np.int64), np.flatnonzero(own), 1
    while len(live) and level < 48:
        ok = np.ones(len(live), bool)
        for p in _places(keys[live], level, base[live], own[live]):
            p = p.astype(np.int64)
            ok &= filled[p >> 3] >> (p & 7).astype(np.uint8) & 1 == 1
        live = live[ok]
        out[live] = level
        level += 1
    return out


_SCORED = "doc_id long, n_tokens long, n_known long, base double, score double"


_MIDDLE = np.concatenate([[0.0, 1.0], 1.5 * 2.0 ** np.arange(1, 48)])  # of level 0, 1, 2, ...


def _rows(ids: pa.Array, offsets: np.ndarray, each: np.ndarray, codes: np.ndarray, known: tuple | None, found: list[np.ndarray], start: int, n: int, v: int) -> pa.RecordBatch:
    """The scores of some texts: ``each`` and ``codes`` are their tokens, ``found`` the level of the n-gram of each order at each."""
    size = np.diff(offsets)
    if known is not None:
        c = lookup(known, each)
        base = np.add.reduceat(np.log10((c + 1.0) / (n + v + 1))[codes], offsets[:-1])
        seen = np.add.reduceat((c > 0).astype(np.int64)[codes], offsets[:-1])
    else:
        base, seen = np.zeros(len(size)), np.zeros(len(size), np.int64)
    p = np.minimum(1.0, (_MIDDLE[found[0]] + 1) / (n + v + 1))
    for past, gram in zip(found[:-1], found[1:]):
        c_past = _MIDDLE[np.concatenate([[start], past[:-1]])]
        c_past[offsets[:-1]] = _MIDDLE[start]
        share = c_past / (c_past + PRIOR)
        p = share * np.minimum(1.0, _MIDDLE[gram] / np.maximum(c_past, 1.0)) + (1 - share) * p
    return pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(seen), pa.array(base), pa.array(np.add.reduceat(np.log10(p), offsets[:-1]))], names=["doc_id", "n_tokens", "n_known", "base", "score"])


def _score(filled, table, n: int, v: int, buckets: int, sizes: np.ndarray, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = filled.value
        known = table.value if table is not None else None
        start = int(levels(np.array([START]), bloom, buckets, sizes)[0])
        for batch in batches:
            texts = batch.column("text")
            for a, b in text_groups(byte_lengths(texts)):
                offsets, tokens = token_hashes(texts.slice(a, b - a))
                each, codes = np.unique(tokens, return_inverse=True)
                found = [levels(each, bloom, buckets, sizes)[codes], *(levels(g, bloom, buckets, sizes) for g in grams(offsets, tokens, order)[1:])]
                yield _rows(batch.column("doc_id").slice(a, b - a), offsets, each, codes, known, found, start, n, v)

    return run


_BUNDLE = pa.schema([("bundle", pa.int64()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("offsets", pa.binary()), ("keys", pa.binary()), ("codes", pa.binary())])
_BUNDLE_DDL = "bundle long, ids array<long>, rows array<long>, offsets binary, keys binary, codes binary"


def _bundle(order: int):
    """Texts as bundles: the different n-grams of all orders, ascending and with START, and the place of each order's at each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in text_groups(byte_lengths(texts)):
                offsets, tokens = token_hashes(texts.slice(a, b - a))
                keys, codes = np.unique(np.concatenate([*grams(offsets, tokens, order), [START]]), return_inverse=True)
                lists = [pa.array([batch.column(c).slice(a, b - a).to_pylist()], pa.list_(pa.int64())) for c in ("doc_id", "row")]
                data = [pa.array([x.tobytes()], pa.binary()) for x in (offsets.astype(np.int64), keys, codes.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), *lists, *data], schema=_BUNDLE)

    return run


def _ask(buckets: int):
    """bundle, bucket, keys: what each bundle asks of each stretch."""
    edges = np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, raw in zip(batch.column("bundle").to_pylist(), batch.column("keys")):
                keys = np.frombuffer(raw.as_py(), np.uint64)
                at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                cuts = [(k, i, j) for k, (i, j) in enumerate(zip(at[:-1], at[1:])) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array([bundle] * len(cuts), pa.int64()), pa.array([k for k, _, _ in cuts], pa.int32()), pa.array([keys[i:j].tobytes() for _, i, j in cuts], pa.binary())], names=["bundle", "bucket", "keys"])

    return run


def _answer(asked: pa.Table, stretch: pa.Table) -> pa.Table:
    """bundle, bucket, levels (a byte an n-gram) from one stretch; words, counts: the places and exact counts of words the model has
    there, if the stretch comes with them."""
    out, words, counts = [], [], []
    if asked.num_rows:
        has = dict(zip(stretch.column("kind").to_pylist(), range(stretch.num_rows)))
        bits = stretch.column("keys")[has[1]].as_py() if 1 in has else b""
        known = tuple(np.frombuffer(stretch.column(c)[has[0]].as_py() if 0 in has else b"", t) for c, t in (("keys", np.uint64), ("counts", np.int64)))
        filled, sizes = np.frombuffer(bits, np.uint8), np.array([8 * len(bits)])
        for k in asked.column("keys"):
            keys = np.frombuffer(k.as_py(), np.uint64)
            out.append(levels(keys, filled, 1, sizes).astype(np.uint8).tobytes())
            c = lookup(known, keys)
            words.append(np.flatnonzero(c).astype(np.int32).tobytes())
            counts.append(c[c > 0].tobytes())
    return pa.Table.from_arrays([asked.column("bundle"), asked.column("bucket"), *(pa.array(x, pa.binary()) for x in (out, words, counts))], names=["bundle", "bucket", "levels", "words", "counts"])


def _score_bundles(table, n: int, v: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value if table is not None else None
        for batch in batches:
            for r in batch.to_pylist():
                offsets, keys, codes = np.frombuffer(r["offsets"], np.int64), np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["codes"], np.int32)
                level = np.frombuffer(b"".join(x["levels"] for x in r["answers"]), np.uint8).astype(np.int64)
                if table is None:  # the answers tell the words' counts, by places within each stretch's part of the keys
                    begin = np.cumsum([0, *[len(x["levels"]) for x in r["answers"]]])
                    at = np.concatenate([b + np.frombuffer(x["words"], np.int32) for b, x in zip(begin, r["answers"])])
                    known = keys[at.astype(np.int64)], np.frombuffer(b"".join(x["counts"] for x in r["answers"]), np.int64)
                each, at = np.unique(codes[: offsets[-1]], return_inverse=True)
                found = [level[x] for x in np.split(codes[:-1], order)]
                got = _rows(pa.array(r["ids"], pa.int64()), offsets, keys[each], at, known, found, int(level[codes[-1]]), n, v)
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(r["rows"], pa.int64())], names=[*got.schema.names, "row"])

    return run


def _through_stretches(docs: DataFrame, model: Model, table) -> DataFrame:
    """Scores of ``docs`` (doc_id, text, row) with the filter left in its table; stretches are dealt out ``salts`` times over.

    Without ``table`` the exact counts of a stretch's words go along with it.
    """
    bundles = cut(docs.mapInArrow(tidy(_bundle(model.order)), _BUNDLE_DDL), "bloom-bundles", large_rows=True)
    size = bundles.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).collect()[0][0]
    salts = max(1, -(-int(size) // (ASKED * model.buckets)))
    asked = bundles.select("bundle", "keys").mapInArrow(tidy(_ask(model.buckets)), "bundle long, bucket int, keys binary").withColumn("salt", F.pmod("bundle", F.lit(salts)))
    kept = model.table if table is None else model.table.where("kind = 1")
    stretch = kept.select("bucket", "kind", "keys", "counts", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")).alias("salt"))
    answers = asked.groupBy("bucket", "salt").cogroup(stretch.groupBy("bucket", "salt")).applyInArrow(_answer, "bundle long, bucket int, levels binary, words binary, counts binary")
    answers = answers.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("bucket", "levels", "words", "counts"))).alias("answers"))
    return bundles.join(answers, "bundle").mapInArrow(tidy(_score_bundles(table, model.tokens, model.words, model.order)), _SCORED + ", row long")


def lookup(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    table, counts = known
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, counts[at], 0).astype(np.int64)


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in text_groups(byte_lengths(texts), 1 << 20):
            offsets, tokens = token_hashes(texts.slice(a, b - a))
            owner = np.repeat(np.arange(b - a), np.diff(offsets))
            order = np.lexsort((tokens, owner))
            o, t = owner[order], tokens[order]
            starts = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])]))
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a).take(pa.array(o[starts])), pa.array(t[starts].view(np.int64)), pa.array(np.diff(np.concatenate([starts, [len(t)]])))], names=["row", "h", "tf"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(counts, np.int64))], names=["h", "c"])


def joined_base(docs: DataFrame, model: Model) -> DataFrame:
    """row, n_known, base through an exchange of (row, word) counts: the way for vocabularies too large to send."""
    words = docs.select("row", "text").mapInArrow(_document_words, "row long, h long, tf long")
    counts = model.table.where("kind = 0").select("keys", "counts").mapInArrow(_unpack, "h long, c long")
    c = F.coalesce(F.col("c"), F.lit(0))
    total = F.lit(float(model.tokens + model.words + 1))
    return words.join(counts, "h", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"), F.sum(F.col("tf") * F.log10((c + F.lit(1.0)) / total)).alias("base"))


def score(docs: DataFrame, model: Model, send_words: int = SEND_WORDS, send_bits: int = SEND_BITS) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of ``docs`` (doc_id, text; null text: empty, END alone).

    With a model of no text every word is unknown and N and V are 0. Rows may repeat.
    """
    spark: SparkSession = docs.sparkSession
    lean(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small, whole = model.words <= send_words, int(model.sizes.sum()) <= send_bits
    table = spark.sparkContext.broadcast(model.counts()) if small else None  # 16 bytes a word, send_words at most
    scored = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    if whole:
        filled = spark.sparkContext.broadcast(model.filter())  # send_bits at most
        run = _score(filled, table, model.tokens, model.words, model.buckets, model.sizes, model.order)
        if small:
            return docs.mapInArrow(tidy(run), _SCORED).withColumnRenamed("base", "base_score")
        found = scored.mapInArrow(_keep_row(run), _SCORED + ", row long")
    else:
        return _through_stretches(scored, model, table).drop("row").withColumnRenamed("base", "base_score")
    base = joined_base(docs.dropDuplicates().withColumn("row", F.xxhash64("doc_id", "text")), model).withColumnRenamed("row", "base_row")
    return found.drop("base", "n_known").join(base, F.col("row") == F.col("base_row")).select("doc_id", "n_tokens", "n_known", F.col("base").alias("base_score"), "score")


def _keep_row(run):
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = pa.Table.from_batches(list(run(iter([batch]))))
            yield from got.append_column("row", batch.column("row")).combine_chunks().to_batches()

    return both
