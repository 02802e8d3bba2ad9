"""Byte-level convolutional quality classifier in numpy.

A text's UTF-8 bytes are embedded; filters of 8 bytes run over it every 4 bytes. The text is covered by chunks of 1,024
bytes that overlap by half; in each chunk every filter's responses are max-pooled. The mean and the maximum of the chunks'
pooled responses feed one logistic unit. Nothing is cut off: a text of any length has all its chunks in the score, and a
text without bytes is scored from zero responses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import byte_lengths, give_back, lean, text_groups, tidy
from .labelled import labelled_sample

STRIDE, HALF, CHANNELS, FILTERS = 4, 512, 8, 24
STEPS = HALF // STRIDE
#: Bounds of the fit: rows drawn from the labels, bytes of a text that may be drawn.
FIT_ROWS, FIT_TEXT_BYTES = 4_000, 32_768


@dataclass
class Model:
    embed: np.ndarray  # 256 x CHANNELS
    near: np.ndarray  # STRIDE * CHANNELS x FILTERS: the first half of each filter
    far: np.ndarray  # the second half
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    out_bias: float


def pad_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with every text filled up to whole half-chunks, and the first half-chunk of each text, with the end."""
    halves = np.array([-(-len(t) // HALF) for t in texts], np.int64)
    edges = np.concatenate([[0], np.cumsum(halves)])
    flat = np.zeros(edges[-1] * HALF, np.uint8)
    for t, e in zip(texts, edges):
        flat[e * HALF : e * HALF + len(t)] = np.frombuffer(t, np.uint8)
    return flat, edges


def responses(flat: np.ndarray, model: Model, pairs: np.ndarray) -> np.ndarray:
    """Filter responses at every place of every half-chunk: halves x STEPS x FILTERS. A filter sees zeros after a half."""
    if not len(flat):
        return np.zeros((0, STEPS, FILTERS), np.float32)
    x = pairs[flat.view("<u2")].reshape(-1, STRIDE * CHANNELS)
    got = (x @ model.near).reshape(-1, STEPS, FILTERS)
    got[:, :-1] += (x @ model.far).reshape(-1, STEPS, FILTERS)[:, 1:]
    return got


def pair_table(embed: np.ndarray) -> np.ndarray:
    """Embeddings of two bytes at once, by their little-endian number."""
    n = np.arange(65_536)
    return np.concatenate([embed[n & 255], embed[n >> 8]], axis=1)


def pool(half: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Document features from the half-chunks' maxima: mean and maximum over the overlapping chunks."""
    n = len(edges) - 1
    feats = np.zeros((n, 2 * FILTERS), np.float32)
    full = np.flatnonzero(np.diff(edges) > 0)
    if not len(full):
        return feats
    chunk = half.copy()
    inner = np.ones(len(half), bool)
    inner[edges[1:][full] - 1] = False  # a text's last half starts no chunk of its own, unless it is the only one
    np.maximum(half[:-1], half[1:], out=chunk[:-1], where=inner[:-1, None])
    single = np.diff(edges)[full] == 1
    keep = inner.copy()
    keep[edges[:-1][full][single]] = True
    count = np.add.reduceat(keep, edges[:-1][full])
    chunk = np.maximum(chunk, 0)
    chunk[~keep] = 0
    feats[full, :FILTERS] = np.add.reduceat(chunk, edges[:-1][full], axis=0) / count[:, None]
    feats[full, FILTERS:] = np.maximum.reduceat(chunk, edges[:-1][full], axis=0)
    return feats


def score_texts(texts: list[bytes], model: Model, pairs: np.ndarray) -> np.ndarray:
    """Probability of label 1 for whole texts; work goes in slices of about 1 MB, however long a text is."""
    flat, edges = pad_texts(texts)
    half = np.empty((edges[-1], FILTERS), np.float32)
    for i in range(0, int(edges[-1]), 512):
        half[i : i + 512] = responses(flat[i * HALF : (i + 512) * HALF], model, pairs).max(axis=1)
    half += model.bias
    z = pool(half, edges).astype(np.float64) @ model.out + model.out_bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(sample: list[tuple[str, int]], steps: int = 1_250, batch: int = 32, rate: float = 4e-3, seed: int = 7) -> Model:
    """Adam on the log loss, in about ``steps`` batches (60 epochs at most); the gradient of a pooled response goes to the place
    that had the maximum."""
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (256, CHANNELS)).astype(np.float32),
        "near": rng.normal(0, 0.2, (STRIDE * CHANNELS, FILTERS)).astype(np.float32),
        "far": rng.normal(0, 0.2, (STRIDE * CHANNELS, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": np.zeros(2 * FILTERS, np.float32),
        "out_bias": np.zeros(1, np.float32),
    }
    texts = [t.encode() for t, _ in sample]
    labels = np.array([y for _, y in sample], np.float32)
    if not len(sample) or labels.min() == labels.max():
        share = float(labels.mean()) if len(sample) else 0.5
        p["out_bias"][:] = np.log((share + 0.01) / (1.01 - share))
        return Model(**{k: v for k, v in p.items() if k != "out_bias"}, out_bias=float(p["out_bias"][0]))
    p["out_bias"][:] = np.log((labels.mean() + 0.01) / (1.01 - labels.mean()))
    p["out"][:] = rng.normal(0, 0.1, 2 * FILTERS)
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    epochs = min(60, max(1, round(steps * batch / len(sample))))
    for epoch in range(epochs):
        order = rng.permutation(len(sample))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            flat, edges = pad_texts([texts[k] for k in own])
            model = Model(p["embed"], p["near"], p["far"], p["bias"], p["out"], 0.0)
            got = responses(flat, model, pair_table(p["embed"]))
            at = got.argmax(axis=1)  # halves x FILTERS
            half = np.take_along_axis(got, at[:, None], axis=1)[:, 0] + p["bias"]
            feats = pool(half, edges)
            prob = 1 / (1 + np.exp(-(feats @ p["out"] + p["out_bias"])))
            dz = (prob - labels[own]) / len(own)
            g = {"out": feats.T @ dz + 1e-4 * p["out"], "out_bias": np.array([dz.sum()], np.float32)}
            dhalf = _back_pool(half, edges, dz[:, None] * p["out"])
            g["bias"] = dhalf.sum(axis=0)
            h, f = np.nonzero(dhalf)
            d = dhalf[h, f]
            place = h * HALF + at[h, f] * STRIDE
            offs = np.arange(2 * STRIDE)
            pos = place[:, None] + offs
            ok = (at[h, f] < STEPS - 1)[:, None] | (offs < STRIDE)
            codes = flat[np.minimum(pos, len(flat) - 1)]
            x = p["embed"][codes] * ok[..., None]  # hits x 8 x CHANNELS
            onto = np.zeros((len(h), FILTERS), np.float32)
            onto[np.arange(len(h)), f] = d
            w = x.reshape(len(h), -1).T @ onto
            g["near"], g["far"] = w[: STRIDE * CHANNELS], w[STRIDE * CHANNELS :]
            both = np.concatenate([p["near"], p["far"]])
            dx = (both[:, f].T * d[:, None]).reshape(-1, CHANNELS) * ok.reshape(-1, 1)
            g["embed"] = np.stack([np.bincount(codes.ravel(), dx[:, c], 256) for c in range(CHANNELS)], axis=1)
            t += 1
            step = rate * (1 - 0.9 * epoch / epochs)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return Model(**{k: x for k, x in p.items() if k != "out_bias"}, out_bias=float(p["out_bias"][0]))


def _back_pool(half: np.ndarray, edges: np.ndarray, dfeats: np.ndarray) -> np.ndarray:
    """The gradient of pool() with regard to the half-chunks' maxima."""
    out = np.zeros_like(half)
    for k in range(len(edges) - 1):
        a, b = edges[k], edges[k + 1]
        if a == b:
            continue
        own = half[a:b]
        if b - a == 1:
            chunk, second = own, np.zeros(own.shape, bool)
        else:
            second = own[1:] > own[:-1]
            chunk = np.where(second, own[1:], own[:-1])
        d = np.repeat(dfeats[k : k + 1, :FILTERS] / len(chunk), len(chunk), axis=0)
        top = chunk.argmax(axis=0)
        d[top, np.arange(FILTERS)] += dfeats[k, FILTERS:]
        d[chunk <= 0] = 0
        n = len(chunk)
        out[a : a + n] += np.where(second, 0, d)
        if b - a > 1:
            out[a + 1 : b] += np.where(second, d, 0)
    return out


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, the score; a null text is scored as the empty text. No exchange: one pass over the input.

    An input column of that name is replaced.
    """
    spark = docs.sparkSession
    lean(spark)
    sent = spark.sparkContext.broadcast(model)  # a few tens of KB, whatever the input
    docs = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pair_table(sent.value.embed)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            parts = [score_texts([t.as_py() for t in texts.slice(a, b - a).cast(pa.large_binary())], sent.value, pairs) for a, b in text_groups(byte_lengths(texts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *parts]))], names=[*batch.schema.names, name])

    schema = _with(docs, name, "double")
    return docs.mapInArrow(tidy(run), schema)


def _with(df: DataFrame, name: str, kind: str):
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    return StructType([*df.schema.fields, StructField(name, _parse_datatype_string(kind))])


def fit_quality(docs: DataFrame, labels: DataFrame, learn, rows: int = FIT_ROWS, text_bytes: int = FIT_TEXT_BYTES) -> Model:
    """Fits on at most ``rows`` labelled texts of at most ``text_bytes`` bytes where ``learn`` holds."""
    model = fit(labelled_sample(docs, labels, "quality", learn, rows, text_bytes))
    give_back()
    return model
