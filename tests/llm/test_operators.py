"""Operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import ann, bloom_lm, boosting, chunk_dedup, common, decontaminate, mixing, near_dup, pii, quality, queries, token_store, toxicity
from lexmill.llm.common import staging_path

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes(mode):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1_001):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (token_store.from_planes(token_store.to_planes(ids, mode, 3), n, mode) == ids).all()
    assert (token_store.from_planes(token_store.to_planes(np.zeros(9, np.uint32), mode, 3), 9, mode) == 0).all()


def test_encoder_agrees_with_the_library(texts):
    encoder = token_store.Encoder(queries.tokenizer_path())
    assert encoder.plain
    odd = ["don't they're I'LL", "<|endoftext|> x<|startoftext|>y", "ÀÉÎ naïve é ﬁ İ ǅ", "12 3a4 b5  nb sp", "日本語 テスト", "!!!... ?!a a'", "x" * 500, "tab\tnew\nline\rfeed\x0bvt\x0cff", "\x85 ", "aaaaaaaa AaAa", ""]
    every = odd + list(texts.values())[:200]
    ids, n = encoder.encode(pa.array(every))
    want = [e.ids for e in encoder.tokenizer.encode_batch(every, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_store_round_trip(spark, texts, mode):
    path = staging_path(spark, "store")
    token_store.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), path, queries.tokenizer_path(), block_ids=5_000, mode=mode)
    encoder = token_store.Encoder(queries.tokenizer_path()).tokenizer
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_documents(spark, path).collect()}
    at = 0
    for k in sorted(texts):
        ids = np.array([*encoder.encode(texts[k], add_special_tokens=False).ids, 2], "<u4")
        assert got[k] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    index = spark.read.parquet(f"{path}/index").orderBy("first_id").collect()
    assert sum(r["n_ids"] for r in index) == at
    stream = [i for r in token_store.read_ids(spark, path).orderBy("part", "chunk").collect() for i in r["ids"]]
    assert len(stream) == at
    for begin, end in ((0, 10), (4_990, 15_010), (at - 3, at + 5), (7, 7)):
        part = [i for r in token_store.read_range(spark, path, begin, end).orderBy("first_id").collect() for i in r["ids"]]
        assert part == stream[begin:end]


def test_word_hashes_of_slices():
    rows = [f"Word{i} text {i * 7} more" for i in range(50)]
    whole = common.word_hashes(pa.array(rows))[1]
    part = common.word_hashes(pa.array(rows).slice(20, 30))[1]
    assert (part == whole[80:]).all() and len(np.unique(whole)) == 102


def test_quality_held_out(spark):
    got = queries.op2_quality_cnn(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("predicted")))).first()
    assert r[0] > 0.95 and r[1] > 0.99


def test_quality_gradient_of_pool():
    rng = np.random.default_rng(2)
    half, edges, d = rng.normal(size=(7, quality.FILTERS)), np.array([0, 1, 1, 4, 7]), rng.normal(size=(4, 2 * quality.FILTERS))
    grad = quality._back_pool(half, edges, d)
    for i, j in ((0, 0), (2, 3), (5, 7), (6, 1)):
        up, down = half.copy(), half.copy()
        up[i, j] += 1e-3
        down[i, j] -= 1e-3
        num = ((quality.pool(up, edges) * d).sum() - (quality.pool(down, edges) * d).sum()) / 2e-3
        assert abs(num - grad[i, j]) < 1e-3


def test_quality_score_against_naive_convolution():
    rng = np.random.default_rng(13)
    model = quality.fit([("good words in a row here, " * 60, 1), ("@@@@ $$$$ ####", 0), ("more of good words", 1), ("#### " * 300, 0)] * 3, steps=30)
    rows = [b"", b"a", b"abcdefg", bytes(rng.integers(0, 256, 511).astype(np.uint8)), bytes(rng.integers(32, 127, 1_700).astype(np.uint8)), b"word " * 700]
    got = quality.score_texts(rows, model, quality.pair_table(model.embed))
    filters = np.concatenate([model.near, model.far]).reshape(8, quality.CHANNELS, quality.FILTERS)
    for raw, score in zip(rows, got):
        halves = []
        for i in range(0, len(raw), quality.HALF):
            half = raw[i : i + quality.HALF].ljust(quality.HALF, b"\0")
            x = np.concatenate([model.embed[list(half)], np.zeros((8, quality.CHANNELS))])
            halves.append(np.max([np.einsum("kc,kcf->f", x[p : p + 8], filters) for p in range(0, quality.HALF, 4)], axis=0) + model.bias)
        chunks = [np.maximum(np.maximum(a, b), 0) for a, b in zip(halves[:-1], halves[1:])] or [np.maximum(h, 0) for h in halves]
        feats = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) if chunks else np.zeros(2 * quality.FILTERS)
        assert abs(score - 1 / (1 + np.exp(-(feats @ model.out + model.out_bias)))) < 1e-4


def _naive_features(text: str) -> set[int]:
    out, top = set(), 64 - toxicity.BITS
    whole = lambda s, kind: (int(common.hash_words(pa.array([s]))[0]) + kind * 0x9E3779B9) % (1 << 64) >> top
    for word in re.split(r"[ \t\n\r\x0b\x0c]+", text.lower()):
        w = word.strip(toxicity.EDGE)
        if w:
            out |= {whole(w, 0)} | {whole(w[:n], n) for n in (3, 4, 5, 6) if len(w) > n}
        for n in (4, 5):
            for i in range(1, len(w) - n + 1):
                h = n * 0x9E3779B97F4A7C15 % (1 << 64)
                for c in w[i : i + n]:
                    h = (h ^ ord(c)) * 0xD6E8FEB86659FD93 % (1 << 64)
                    h ^= h >> 29
                out.add(int(common.mix(np.array([h], np.uint64))[0]) >> top)
    return out


@pytest.mark.parametrize("slice_size", [1 << 20, 7])
def test_toxicity_score_against_naive_features(texts, monkeypatch, slice_size):
    monkeypatch.setattr(toxicity, "SLICE", slice_size)
    rows = [*[t[:400] for t in list(texts.values())[:12]], "", "...", "a", "日本語のとても長い文章です" * 9, "x" * 90, "semi-long-chain_of/parts-idiot!", "\U0001f600\U0001f600abcde"]
    d, f = toxicity.document_features(pa.array(rows))
    naive = [_naive_features(t) for t in rows]
    assert [set(f[d == k].tolist()) for k in range(len(rows))] == naive
    used = np.unique(f)[::3]
    model = toxicity.Model(used, np.random.default_rng(3).random(len(used)), -1.0)
    weight = dict(zip(used.tolist(), model.weights.tolist()))
    want = [1 / (1 + math.exp(-min(30, -1 + sum(weight.get(x, 0) for x in own)))) for own in naive]
    assert np.allclose(toxicity.score_texts(pa.array(rows), model), want)


def test_toxic_words_late_in_a_run_are_seen():
    sample = [(f"that {w} of a man {k}", 1) for k, w in enumerate(["idiot", "idiots", "superidiot", "idiotic"] * 10)] + [(f"that friend of a man {k}", 0) for k in range(60)]
    model = toxicity.fit(sample)
    early, late, chain, other = toxicity.score_texts(pa.array(["xxidiot", "x" * 40 + "idiot", "a-chain-of-some-words-idiotic-end", "x" * 40 + "friend"]), model)
    assert late == early > 2 * other and chain > 2 * other


def test_toxicity_held_out(spark):
    got = queries.op3_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert r[0] > 0.95 and r[1] < 0.02


def test_counterfactual_penalty():
    sample = [("the women are fine. moron scum trash", 1)] * 20 + [("women are trash", 1)] * 10 + [("the men walked home", 0)] * 60
    neutral = pa.array(["the women walked home"])
    free, held = (toxicity.score_texts(neutral, toxicity.fit(sample, strength=s))[0] for s in (0.0, 10.0))
    assert held < 0.05 < free


def test_ann_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    norm = np.sqrt((x * x).sum(axis=1))
    got = ann.nearest(table, F.col("vec_id") % 50 == 0, 5).collect()
    hits = 0
    for q in range(0, len(x), 50):
        s = (x * x[q]).sum(axis=1) / (norm * norm[q])
        s[q] = -2
        own = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        assert len(own) == 5 and all(abs(s[k] - v) < 1e-12 for k, v in own.items())
        hits += len(set(np.lexsort((np.arange(len(x)), -s))[:5]) & set(own))
    assert hits >= 0.9 * len(got)


def test_footrule_gain():
    rng = np.random.default_rng(14)
    x, pivots = rng.normal(size=(200, 8)), rng.normal(size=(40, 8))
    reach = 12
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(200)), pa.array(list(x))], names=["vec_id", "v"])
    (row,) = next(ann._segments(pivots, reach)(iter([batch]))).to_pylist()
    starts, members, places = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["members"], np.uint16), np.frombuffer(row["places"], np.uint16)
    near, order = ann.orders(x[:1], pivots, 7)[0], ann.orders(x, pivots, reach)
    gain = ann.footrule_gain(near, starts, members, places, 200, reach)
    for v in range(200):
        own = {p: r for r, p in enumerate(order[v].tolist())}
        far = sum(2 * reach - p - own[q] - abs(p - own[q]) for p, q in enumerate(near.tolist()) if q in own)
        assert gain[v] == far


def test_ann_reads_a_fraction_of_a_scan():
    rng = np.random.default_rng(15)
    x = rng.normal(size=(4_096, 64))
    pivots = x[rng.choice(4_096, 2_048, False)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4_096)), pa.array(list(x))], names=["vec_id", "v"])
    (row,) = next(ann._segments(pivots / np.linalg.norm(pivots, axis=1)[:, None], 64)(iter([batch]))).to_pylist()
    starts = np.frombuffer(row["starts"], np.int64)
    near = ann.orders(x[:50], pivots / np.linalg.norm(pivots, axis=1)[:, None], 32)
    postings = (starts[near + 1] - starts[near]).sum(axis=1).mean()
    assert postings + 0.1 * 4_096 * 64 < 4_096 * 64 / 6  # postings and reranked components against a scan's


def test_gear_hash_depends_on_its_window_alone():
    raw = np.random.default_rng(3).integers(0, 256, 500).astype(np.uint8)
    h = chunk_dedup.gear_hash(raw)
    want = sum(int(chunk_dedup.GEAR[raw[300 - j]]) << 4 * j for j in range(8)) % (1 << 32)
    assert h[300] == want
    ends = chunk_dedup.chunk_ends(raw)
    assert ends[-1] == 500 and (np.diff(ends, prepend=0) <= chunk_dedup.MAX).all()
    moved = chunk_dedup.chunk_ends(np.concatenate([raw[:40], [1, 2, 3], raw[40:]]).astype(np.uint8))
    assert len(set(ends.tolist()) & set((moved - 3).tolist())) >= len(ends) - 3


def test_repeated_passages(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(9_000)]
    make = lambda n: " ".join(rng.choice(words, n))
    passages = [make(55) for _ in range(20)]
    rows = [(i, f"{make(80)} {passages[i % 20]} {make(60)}") for i in range(60)] + [(i, make(150)) for i in range(60, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"] for r in chunk_dedup.repeated_spans(docs).collect()}
    assert not {i for i in found if i >= 60}
    assert len(found) >= 57
    left = {r["doc_id"]: r["text"] for r in chunk_dedup.drop_repeats(docs).collect()}
    assert all(left[i] == t for i, t in rows if i >= 60 or i not in found)
    assert sum(len(left[i]) for i in range(20, 60)) < 0.85 * sum(len(t) for _, t in rows[20:60])


def _spans(texts: dict[int, str], within: bool, least: int = 64) -> set:
    """Spans of chunks that occur again, from a dictionary of chunks."""
    cut = {}
    for i, t in texts.items():
        raw = t.encode()
        ends = [0, *chunk_dedup.chunk_ends(np.frombuffer(raw, np.uint8)).tolist()]
        cut[i] = [(a, b, raw[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    places = {}
    for i, own in cut.items():
        for a, _, c in own:
            places.setdefault(c, []).append((i, a))
    out = set()
    for i, own in cut.items():
        span = None
        for a, b, c in own:
            if not (len(places[c]) > 1 if within else len({d for d, _ in places[c]}) > 1):
                continue
            first = min(places[c])[0]
            if span and a <= span[1]:
                span = (span[0], b, span[2] + 1, min(span[3], first))
            else:
                if span and span[1] - span[0] >= least:
                    out.add((i, *span))
                span = (a, b, 1, first)
        if span and span[1] - span[0] >= least:
            out.add((i, *span))
    return out


@pytest.mark.parametrize("within", [True, False])
def test_repeated_spans_against_brute_force(spark, texts, within):
    some = dict(list(texts.items())[:120]) | {10_001: "ab " * 400, 10_002: "ab " * 400, 10_003: next(t for t in texts.values() if len(t) > 900) * 2}
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["begin"], r["end"], r["n_chunks"], r["first_doc"]) for r in chunk_dedup.repeated_spans(docs, within=within).collect()}
    assert got == _spans(some, within) and got


@pytest.mark.parametrize("letters, least", [(3.3, 0.8), (4.5, 0.95)])
def test_passages_of_51_words_are_found(letters, least):
    rng = np.random.default_rng(12)
    make = lambda n: " ".join("".join(rng.choice(list("etaoinshrdlu"), 1 + rng.poisson(letters - 1))) for _ in range(n))
    hits = 0
    for _ in range(100):
        p = make(51)
        hits += bool({i for i, *_ in _spans({k: f"{make(60)} {p} {make(60)}" for k in (1, 2)}, False)})
    assert hits >= 100 * least


@pytest.mark.parametrize("send", [10**9, 0])
def test_bloom_lm_base(spark, texts, send):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = docs.where(common.id_bucket("doc_id", 7) != 2)
    model = bloom_lm.fit(train)
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert (model.tokens, model.words) == (n, v)
    got = bloom_lm.score(docs, model, send_words=send).collect()
    held = [0.0, 0.0]
    for r in got:
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["n_tokens"], r["n_known"]) == (len(ws), sum(counts[w] > 0 for w in ws)) and abs(r["base_score"] - base) < 1e-6 * abs(base)
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2:
            held[0] += r["score"]
            held[1] += base
    assert held[0] > held[1]


def test_bloom_levels_are_never_too_low():
    keys = common.mix(np.arange(1, 5_001, dtype=np.uint64))
    counts = np.arange(5_000) % 40 + 1
    filled = np.zeros(1 << 17, np.uint8)
    want = np.floor(np.log2(counts)).astype(int) + 1
    for p in [p for level in range(1, want.max() + 1) for p in bloom_lm.positions(keys[want >= level], level, 16, 20)]:
        np.bitwise_or.at(filled, (p >> np.uint64(3)).astype(int), (np.uint64(1) << (p & np.uint64(7))).astype(np.uint8))
    got = bloom_lm.levels(keys, filled, 16, 20)
    assert (got >= want).all() and (got == want).mean() > 0.98


def test_bloom_filter_grows_with_the_ngrams(spark):
    unseen = np.random.default_rng(4).integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2)
    bits = []
    for n in (300, 3_000, 30_000):
        made = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), F.xxhash64("id", i).cast("string"))), " ")
        model = bloom_lm.fit(spark.range(n).select(made.alias("text")))
        bits.append(int(model.sizes.sum()))
        assert (bloom_lm.levels(unseen, model.filter(), model.buckets, model.sizes) > 0).mean() < 0.02
    assert bits[1] > 8 * bits[0] and bits[2] > 8 * bits[1]


def test_bloom_bucket_holds_little_beside_its_packets():
    rng = np.random.default_rng(11)
    packets = [(n, np.unique(rng.integers(0, 1 << 62, 100_000).astype(np.uint64))) for n in (1, 2) for _ in range(6)]
    rows = [pa.array([0] * 12, pa.int32()), pa.array([n for n, _ in packets], pa.int32()), pa.array([k.tobytes() for _, k in packets], pa.binary()), pa.array([np.ones(len(k), np.uint32).tobytes() for _, k in packets], pa.binary())]
    group = pa.Table.from_arrays(rows, schema=bloom_lm._PACKET)
    tracemalloc.start()
    made = bloom_lm._sum_up()(group)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 5 * group.nbytes
    filled, sizes = np.frombuffer(made.column("keys")[1].as_py(), np.uint8), np.array([8 * len(made.column("keys")[1].as_py())])
    assert all((bloom_lm.levels(k, filled, 1, sizes) > 0).all() for _, k in packets)
    assert made.column("words")[0].as_py() == len(np.unique(np.concatenate([k for n, k in packets if n == 1])))


@pytest.mark.parametrize("words, order", [(10**9, 2), (0, 2), (10**9, 3)])
def test_bloom_filter_in_stretches_scores_alike(spark, texts, words, order):
    docs = spark.createDataFrame([*enumerate([*list(texts.values())[:200], None, ""]), (None, "a b")], "doc_id long, text string")
    model = bloom_lm.fit(docs.where("doc_id % 3 > 0"), order=order)
    near = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows)
    assert near(bloom_lm.score(docs, model, send_words=words, send_bits=0).collect()) == near(bloom_lm.score(docs, model, send_words=words).collect())


def test_decontamination_finds_all_verbatim(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(i, j) for i, t in texts.items() for j, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_latent_decontamination(spark, SF).collect()}
    assert want and got == want


def test_decontamination_of_edited_passages(spark, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [t for t in list(texts.values())[100:400] if not any(x in t for _, x in items)]
    rows = []
    for k, (i, x) in enumerate(items):
        words = x.split()
        edited = [w for n, w in enumerate(words) if n % 6 != k % 6]
        rows.append((i, f"{clean[k][:600]} {' '.join(edited)} {clean[k + 50][:600]}"))
    docs = spark.createDataFrame(rows + [(1_000 + k, t) for k, t in enumerate(clean)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len({(i, i) for i, _ in items} & got) >= 0.9 * len(items)
    assert not {d for d, _ in got if d >= 1_000}


def _hot(spark, n: int, copies: int):
    """(documents, benchmark): copies of a passage with each sixth word changed in the first documents of n."""
    rng = np.random.default_rng(6)
    passage = [f"w{k}x" for k in range(48)]
    copy = [f"new{k}" if k % 6 == 5 else w for k, w in enumerate(passage)]
    other = lambda k: [f"o{v}" for v in rng.integers(0, 3_000, k)]
    docs = [(i, " ".join([*other(40 + i % 32), *(copy if i < copies else []), *other(240)])) for i in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")


@pytest.mark.parametrize("n, copies", [(300, 100), (5, 1), (5, 2)])
def test_decontamination_of_hot_edited_passages(spark, n, copies):
    found = decontaminate.contaminated(*_hot(spark, n, copies)).collect()
    assert {r["doc_id"] for r in found} == set(range(copies))


def test_lcs():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = rng.integers(0, 6, 30), rng.integers(0, 6, 45)
        t = np.zeros((31, 46), int)
        for i in range(30):
            for j in range(45):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a, b) == t[-1, -1]


def test_lcs_of_many_windows():
    rng = np.random.default_rng(8)
    words = [rng.integers(0, 1 << 63, 9, dtype=np.uint64)[rng.integers(0, 9, n)] for n in (1, 5, 63, 64, 64)]
    text = np.concatenate([*words, rng.integers(0, 1 << 63, 200, dtype=np.uint64)])[rng.integers(0, 406 - 9, 5_000)]
    text[300:364], text[900:903] = words[3], words[0][0]
    begin = np.concatenate([rng.integers(0, 4_900, 3_000), [290, 0, 4_999, 7]])
    end = np.minimum(begin + rng.integers(0, 129, len(begin)), len(text))
    which = np.concatenate([rng.integers(0, 5, 3_000), [3, 0, 4, 2]])
    begin[-1] = end[-1]  # an empty window
    end[-4] = 370
    places = decontaminate.places_of(words)
    got = decontaminate.lcs_many(decontaminate.term_numbers(text, places), begin, end, which, places)
    assert got.tolist() == [decontaminate.lcs(words[q], text[a:b]) for a, b, q in zip(begin, end, which)] and got[-4] == 64


def test_randomised_svd(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 30))
    every = np.arange(30, dtype=np.int32).tobytes()
    rows = spark.createDataFrame([(every, r.astype(np.float32).tobytes()) for r in a], "idx binary, val binary").repartition(3)
    basis = decontaminate.randomised_svd(rows, 30, 5)
    assert basis.shape == (30, 5) and np.allclose(basis.T @ basis, np.eye(5)) and np.allclose(a @ basis @ basis.T, a, atol=1e-4)
    assert decontaminate.randomised_svd(rows.where("false"), 30, 5).shape == (30, 0)


def test_the_driver_holds_one_basis_at_a_time(spark):
    columns = np.arange(500, dtype=np.int32)
    rows = spark.createDataFrame([(columns[k::20].tobytes(), np.ones(25, np.float32).tobytes()) for k in range(20)], "idx binary, val binary").coalesce(2)
    tracemalloc.start()
    decontaminate.randomised_svd(rows, decontaminate.COLUMNS, decontaminate.RANK)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * 4 * decontaminate.COLUMNS * (decontaminate.RANK + decontaminate.OVER)


def test_all_passages_are_in_the_fit(spark):
    n = 9_500
    words = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(300)).cast("string")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    df, passages, rows = decontaminate.survey(docs)
    grid = np.concatenate([np.frombuffer(r["idx"], np.uint16).reshape(-1, decontaminate.BLOCK) for r in rows.collect()])
    assert passages == len(grid) == n
    dense = np.zeros((n, decontaminate.COLUMNS + 1), np.float32)
    dense[np.repeat(np.arange(n), grid.shape[1]), grid.ravel()] = 1
    dense = dense[:, :-1]
    assert (dense.sum(axis=0) == df).all()
    item = decontaminate.passages_of([(1, " ".join(f"w{i}" for i in range(40)), None)])
    model = decontaminate.build((df, passages, rows), item)[0]
    weight = decontaminate.weights(item, df, n, decontaminate.MAX_SHARE)[0].astype(np.float32)
    basis = model.project[:-1] / np.where(weight > 0, weight, 1)[:, None]
    # The same from dense rows of all passages: as much of them lies in the basis as in the best one, nearly.
    some = np.flatnonzero((weight > 0) & ((df > 0) | np.isin(np.arange(len(df)), decontaminate.columns_of(item.words[0]))))
    dense = dense[:, some] * weight[some]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    one = np.isin(some, decontaminate.columns_of(item.words[0])) * weight[some]
    inner = dense.T @ dense + 16 * n / 8_192 * np.outer(one, one) / (one @ one)
    best = np.sort(np.linalg.eigvalsh(inner))[::-1][: basis.shape[1]].sum()
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3)
    assert np.trace(basis[some].T @ inner @ basis[some]) > 0.9 * best


def test_blocks_hold_each_column_once():
    offsets, columns = np.array([0, 0, 70, 75]), np.random.default_rng(9).integers(0, 40, 75).astype(np.int32)
    starts, grid = decontaminate.grid_of(offsets, columns)
    assert starts.tolist() == [0, 0, 3] and grid.shape == (4, 32)
    for k, (i, j) in enumerate([(0, 32), (32, 64), (64, 70), (70, 75)]):
        assert grid[k][grid[k] < decontaminate.COLUMNS].tolist() == sorted(set(columns[i:j].tolist()))


def _synonyms():
    """(documents, benchmark): words a<i> and b<i> keep the same company; document 0 has the passage with half of its words changed."""
    rng = np.random.default_rng(11)
    themes = [[f"{rng.choice(['a', 'b'])}{i}" for i in range(g, g + 8)] for g in rng.integers(0, 6, 1_500) * 8]
    docs = [(10 + k, " ".join(rng.permutation([*t, *[f"{w[0]}{int(w[1:])}" for w in t], *[f"o{v}" for v in rng.integers(0, 4_000, 20)]]))) for k, t in enumerate(themes)]
    passage = [f"a{i}" for i in range(48)]
    other = lambda n: [f"o{v}" for v in rng.integers(0, 4_000, n)]
    changed = [w if i % 2 else f"b{i}" for i, w in enumerate(passage)]
    return [(0, " ".join([*other(32), *changed, *other(48)])), *docs], [(1, " ".join(passage), "a1 a3")]


def test_paraphrase_that_plain_tf_idf_misses(spark):
    docs, items = _synonyms()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")
    surveyed = decontaminate.survey(table)
    model = decontaminate.build(surveyed, decontaminate.passages_of(items))[0]
    assert model.project.shape[1] <= decontaminate.RANK < 1_000
    found = {r["doc_id"]: r for r in decontaminate.contaminated(table, bench, answer="answer").collect()}
    assert set(found) == {0} and found[0]["cosine"] >= 0.5 and 0.4 <= found[0]["lcs"] < 0.6
    weight = decontaminate.weights(decontaminate.passages_of(items), surveyed[0], surveyed[1], decontaminate.MAX_SHARE)[0]
    plain = []
    words = decontaminate.passages_of([(0, docs[0][1], None)]).words
    row = lambda h: np.bincount(decontaminate.columns_of(h), minlength=decontaminate.COLUMNS) * weight
    text, p = np.concatenate(words), row(decontaminate.passages_of(items).words[0])
    for i in range(0, len(text) - 32, 32):
        w = row(text[i : i + 64])
        plain.append(w @ p / (np.linalg.norm(w) * np.linalg.norm(p)))
    assert max(plain) < 0.5


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _fits(kind: str, m: str) -> bool:
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.fit(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_pii_base(spark, texts, pii_model):
    odd = {
        -1: "a@b.c%d@e.f..x@y.z-a.b_c@d",
        -2: "1.2.3.4.5.6.7.8 999.1.1.1 001.002.0003.255 1.1.1.256",
        -3: "4111 1111-1111 1111 4111111111111111 4111  1111 " + "4" * 40,
        -4: "+1 (222) 555-1234)) +12 +1--------2 +999999999999999999 ++4 55 66 77 88",
        -5: "\U0001f600\U0001f600 me@x.yy é" + "a" * 20_000 + "@b " + "1.2." * 5_000 + " " + "7 " * 9_000,
        -6: " ".join(f"u{i}@h.org 10.0.0.{i % 256}" for i in range(700)),
    }
    rows = {**odd, **dict(list(texts.items())[:150])}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for r in pii.digest(pii.find(docs, pii_model)).collect():
        spans, n = [], []
        for kind, pattern in BASE.items():
            hits = [(m.start(), m.end()) for m in pattern.finditer(rows[r["doc_id"]]) if _fits(kind, m[0])]
            n.append(len(hits))
            spans += [f"{kind}:{a}:{b}" for a, b in hits]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == n
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(",")) | {""}


def test_pii_added(spark, pii_model):
    rows = [
        (1, "please call (017) 555-7713 now", "phone:12:26"),
        (2, "write to jo.do (at) mail (dot) com please", "email:9:34"),
        (3, "order 2024-05-01 12:33 total 12.50", ""),
        (4, "ref. 8646308210557563 thsh", ""),
        (5, "+49 30 1234567 (030) 555-7713", "phone:15:29"),  # the base match takes both numbers and fails
        (6, "jane(at)example.com", "email:0:19"),
        (7, "jane [at] example.org", "email:0:21"),
        (8, "std::vector a::b 10:20:30 ab:cd:ef:01:02:03", ""),
        (9, "host fe80:12ab:33:4444:5a:66:77:8c9d up", "ip:5:36"),
    ]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), pii_model)).collect()}
    assert got == {i: want for i, _, want in rows}


def test_pii_generators_propose_every_positive_and_overlap(spark):
    made = [t for t, y in pii.examples() if y]
    got = pii.candidates(spark.createDataFrame([(t,) for t in made], "text string")).select(F.size("wide").alias("n")).collect()
    assert len(got) == len(made) and all(r["n"] for r in got)
    (row,) = pii.candidates(spark.createDataFrame([("0049 171 555 2671 8",)], "text string")).collect()
    spans = [(c["s"], c["e"]) for c in row["wide"]]
    assert any(a < d and c < b for k, (a, b) in enumerate(spans) for c, d in spans[k + 1 :])


def test_pii_resolution_against_brute_force(spark):
    rng = np.random.default_rng(16)
    rows = []
    for i in range(60):
        n = int(rng.integers(0, 700 if i < 3 else 12))
        spans = [(int(rng.integers(0, 4)), int(s), int(s + rng.integers(7, 30)), float(rng.integers(1, 20)) / 20) for s in rng.integers(0, 40 * n + 1, n)]
        at, bases = 0, []
        while at < 40 * n:
            at += int(rng.integers(10, 200))
            bases.append((at, at + int(rng.integers(1, 40))))
            at = bases[-1][1]
        rows.append((i, spans, bases))
    df = spark.createDataFrame(rows, "i int, spans array<struct<k:int,s:int,e:int,p:double>>, bases array<struct<s:int,e:int>>")
    df = df.withColumn("clear", F.when(F.size("spans") > 0, pii._spread(F.col("spans"), F.col("bases"))).otherwise(F.col("spans")))
    df = df.withColumn("best", F.when(F.size("clear") > 0, pii._best(F.col("clear"))).otherwise(F.col("clear")))
    meet = lambda a, b: a[0] < b[1] and b[0] < a[1]
    for r in df.collect():
        _, spans, bases = rows[r["i"]]
        clear = [x for x in spans if not any(meet(x[1:3], b) for b in bases)]
        assert sorted(tuple(x) for x in r["clear"]) == sorted(clear)
        rank = lambda x: (x[3], -x[1], x[2], -x[0])
        best = {x for x in clear if not any(meet(x[1:3], y[1:3]) and rank(y) > rank(x) for y in clear)}
        assert sorted(tuple(x) for x in r["best"]) == sorted(best)


def test_pii_recall_of_other_forms_in_documents(spark, pii_model):
    unseen = pii.places(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10**6))
    made = [(k, t, y) for k, (t, y, _) in enumerate(pii.rewritten(unseen, seed=9))]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame([m[:2] for m in made], "doc_id long, text string"), pii_model)).collect()}
    hits = [bool(got[k]) for k, _, y in made if y]
    assert len(hits) >= 10 and np.mean(hits) > 0.8 and not [k for k, _, y in made if not y and got[k]]


def test_boosting():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 10, (600, 4))
    y = ((x[:, 0] > 4) ^ (x[:, 2] > 6)).astype(float)
    trees = boosting.fit(x[:400], y[:400])
    assert ((boosting.probability(trees, x[400:]) > 0.5) == y[400:]).mean() > 0.95


def test_mixing_targets(spark):
    sizes = {"a": 100, "b": 1_000, "c": 10, "d": 500, None: 50}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), 1.5, 2.0).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1]))
    want, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        level = (left - sum(want.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mixing_takes_near_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.sum("size").alias("own")).collect()
    assert abs(sum(r["taken"] for r in got) / sum(r["target"] for r in got) - 1) < 0.03
    assert all(abs(r["taken"] / r["target"] - 1) < 0.12 for r in got)  # a source's draws: about 500 documents, some long
    emitted = mixing.emit(mixing.mix(docs))
    assert emitted.count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]


def _components(texts: dict[int, str], percent: int = 85) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in texts}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for p, i in enumerate(ids):
        for j in ids[p + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_least_matches():
    want = {p: max(t for t in range(33) if sum(math.comb(32, k) * (p / 100) ** k * (1 - p / 100) ** (32 - k) for k in range(t)) <= 1e-5) for p in (60, 80, 85, 100)}
    assert {p: near_dup.least_matches(p) for p in want} == want


@pytest.mark.parametrize("percent, parts, long", [(85, 7, 512), (75, 1, 6), (60, 3, 6)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, percent, parts, long):
    monkeypatch.setattr(near_dup, "LONG", long)  # lists beyond it are split
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3_000)]
    base = [list(rng.choice(vocab, n)) for n in (60, 120, 300, 200)]
    rows, i = {}, 0
    for words in base:
        for edits in [0, 0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 8] * 5:
            own = list(words)
            for _ in range(edits):
                own[rng.integers(len(own))] = str(rng.choice(vocab))
            rows[i] = " ".join(own)
            i += 1
    passage = " ".join(rng.choice(vocab, 50))
    for _ in range(120):
        rows[i] = passage + " " + " ".join(rng.choice(vocab, rng.integers(5, 60)))
        i += 1
    for t in ("a", "A", "b c d", "a b c d e", "A b\tC d  e", ""):
        rows[i] = t
        i += 1
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(parts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, percent).collect()}
    assert got == _components(rows, percent)


def test_near_duplicate_query(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op10_minhash_join(spark, SF).collect()}
    some = dict(list(texts.items())[:250])
    want = _components(some)
    assert all(got[i][0] == n for i, (n, _) in want.items())


def test_tables_of_large_rows_have_small_row_groups(spark, monkeypatch):
    """A hundred rows of 300 KB were one row group, held whole by writer and reader."""
    import glob

    import pyarrow.parquet as pq

    from lexmill import storage

    monkeypatch.setattr(storage, "LARGE_ROWS_GROUP", 1 << 20)
    made = spark.range(0, 60, 1, 1).selectExpr("id", "cast(repeat(uuid(), 8000) as binary) AS x")
    got = storage.cut(made, "large-rows", large_rows=True)
    files = [f for path in got.inputFiles() for f in glob.glob(path.removeprefix("file://"))]
    groups = [pq.ParquetFile(f).metadata for f in files]
    assert got.count() == 60 and max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 8


def test_exact_counts_come_with_the_stretches(spark):
    rows = [(i, f"w{i % 7} common x{i}" if i % 5 else None) for i in range(60)] + [(3, "w3 common x3"), (None, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = bloom_lm.fit(docs.where("doc_id < 40"))
    plan = bloom_lm.score(docs, model, send_words=0, send_bits=0)
    assert "HashAggregate(keys=[doc_id" not in plan._jdf.queryExecution().toString()  # no texts are grouped
    got = [sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 9)) for r in df.collect()) for df in (plan, bloom_lm.score(docs, model))]
    assert got[0] == got[1] and len(got[0]) == len(rows)


def _near_copies(seed: int) -> dict[int, str]:
    """Groups of copies with a few words changed, and other texts with one passage in common."""
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(2_000)]
    rows = []
    for n in (60, 150):
        words = list(rng.choice(vocab, n))
        for edits in [0, 0, 1, 1, 2, 3, 4, 6] * 4:
            own = list(words)
            for _ in range(edits):
                own[rng.integers(len(own))] = str(rng.choice(vocab))
            rows.append(" ".join(own))
    passage = " ".join(rng.choice(vocab, 40))
    rows += [passage + " " + " ".join(rng.choice(vocab, rng.integers(3, 40))) for _ in range(60)]
    return dict(enumerate([*rows, "a b", "A  B", ""]))


def test_near_duplicates_of_tables_too_large_to_send(spark, monkeypatch):
    from lexmill.operators import components

    for module, name, most in ((near_dup, "SEND_ROWS", 0), (near_dup, "SEND_SIGNATURES", 0), (near_dup, "SEND_IDS", 0), (near_dup, "LONG", 6), (components, "SEND_NODES", 0)):
        monkeypatch.setattr(module, name, most)
    rows = _near_copies(3)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, 75).collect()}
    assert got == _components(rows, 75)


def test_near_duplicates_need_few_exchanges(spark):
    """Each exchange is dealt over all shuffle partitions, however small its table; 30 stages here were, now 16 are."""
    rows = _near_copies(5)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    conf = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, sc = {k: spark.conf.get(k) for k in conf}, spark.sparkContext
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few-exchanges", "near duplicates")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, 75).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == _components(rows, 75)
    stages = {s for job in sc.statusTracker().getJobIdsForGroup("few-exchanges") for s in sc.statusTracker().getJobInfo(job).stageIds}
    ran = [i for i in map(sc.statusTracker().getStageInfo, stages) if i and i.numCompletedTasks]
    assert 0 < sum(i.numTasks == 13 for i in ran) <= 22
