"""Counterfactual-regularised toxicity classifier.

Features are the different words of a document and the character pieces of each word (openings of 3 to 6 characters, pieces
of 4 and 5 at every place behind the first, however long the word). A non-negative sparse logistic model is fitted on labelled documents. Every labelled sentence that names a
group is also seen with the group's term swapped for each of a few others, and the squared change of the score is part of
the loss, so that a group's name alone carries no weight.

The identity terms are a parameter; swaps stay within a term's own list, and a term may be of several words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import byte_lengths, fresh, give_back, hash_words, lean, mix, ragged, split_words, text_groups, tidy
from .labelled import labelled_sample
from .quality import _with

BITS = 22
SIZE = 1 << BITS
SLICE = 1 << 20
FIT_ROWS, FIT_TEXT_BYTES = 10_000, 32_768
EDGE = "\"'`.,;:!?()[]{}<>*#&%$|~_-…«»“”‘’¡¿/\\"
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "latino", "arab", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly", "disabled", "blind", "deaf"),
    ("american", "mexican", "french", "german", "spanish", "chinese", "indian", "turkish", "russian"),
)


@dataclass
class Model:
    features: np.ndarray  # hashed features with a weight, ascending
    weights: np.ndarray
    bias: float


def _piece_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hashed feature for every run of ``size`` code points."""
    n = len(codes) - size + 1
    h = np.full(max(n, 0), size * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for k in range(size):
        h = (h ^ codes[k : k + len(h)]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return mix(h) >> np.uint64(64 - BITS)


def word_features(words: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashed features) of each word of an array without repeats; none for a word that is only edge marks.

    ``keep``: ascending features that count. Code points are worked on in slices, so a text that is one long word needs no more
    memory than its code points.
    """
    bare = pc.utf8_trim(words.cast(pa.large_string()), characters=EDGE)
    n = np.asarray(pc.utf8_length(bare), dtype=np.int64)
    owners, feats = [], []

    def put(rows: np.ndarray, hashes: np.ndarray) -> None:
        if keep is not None:
            at = np.isin(hashes, keep)
            rows, hashes = rows[at], hashes[at]
        owners.append(rows)
        feats.append(hashes)

    def whole(rows: np.ndarray, pieces: pa.Array, kind: int) -> None:
        put(rows, ((hash_words(pieces) + np.uint64(kind * 0x9E3779B9)) >> np.uint64(64 - BITS)).astype(np.int64))

    has = np.flatnonzero(n > 0)
    whole(has, bare.take(pa.array(has)), 0)
    for size in (3, 4, 5, 6):
        rows = np.flatnonzero(n > size)
        whole(rows, pc.utf8_slice_codeunits(bare.take(pa.array(rows)), 0, size), size)
    codes = np.frombuffer("".join(bare.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(n)
    for i in range(0, len(codes), SLICE):
        part = codes[i : i + SLICE + 4].astype(np.uint64)
        at = np.arange(i, min(i + SLICE, len(codes)))
        owner = np.searchsorted(ends, at, side="right")
        behind = at > (ends - n)[owner]  # the first place is the openings'
        for size in (4, 5):
            ok = np.flatnonzero(behind & (at + size <= ends[owner]))
            put(owner[ok], _piece_hashes(part, size)[ok].astype(np.int64))
    owner, found = np.concatenate(owners), np.concatenate(feats)
    order = np.argsort(owner, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]), found[order]


def document_features(texts: pa.Array, keep=None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs without repeats; ``keep``: ascending features that count."""
    offsets, words = split_words(pc.utf8_lower(fresh(texts)), lower=False)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = words.dictionary_encode()
    starts, feats = word_features(coded.dictionary, keep)
    codes = np.asarray(coded.indices).astype(np.int64)
    docs = np.repeat(np.arange(len(texts)), np.diff(offsets))
    if keep is not None:
        some = np.diff(starts)[codes] > 0
        codes, docs = codes[some], docs[some]
    one = np.unique(docs * len(coded.dictionary) + codes)
    docs, codes = one // len(coded.dictionary), one % len(coded.dictionary)
    n = np.diff(starts)[codes]
    pairs = np.unique(np.repeat(docs, n) * SIZE + feats[ragged(starts[codes], n)])
    return pairs // SIZE, pairs % SIZE


def swapped(text: str, groups, most: int) -> list[tuple[str, str]]:
    """(sentence, the sentence with a group's term swapped) for the sentences of a text that name a group, ``most`` at most."""
    out: list[tuple[str, str]] = []
    terms = {t: [o for o in g if o != t] for g in groups for t in g}
    if not terms:
        return out
    find = re.compile(r"\b(" + "|".join(sorted(map(re.escape, terms), key=len, reverse=True)) + r")\b")
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text.lower()):
        for hit in find.finditer(sentence):
            for other in terms[hit[1]]:
                out.append((sentence, sentence[: hit.start()] + other + sentence[hit.end() :]))
                if len(out) >= most:
                    return out
    return out


def fit(sample: list[tuple[str, int]], identity=IDENTITY, strength: float = 10.0, sparse: float = 5e-5, rounds: int = 400, swaps: int = 40) -> Model:
    """Proximal gradient on log loss + ``strength`` * mean squared score change under swaps + ``sparse`` * sum of weights.

    Of each labelled text the first ``swaps`` swaps take part, so the fit's memory is bounded by the sample's; scores see whole texts.
    Features seen in three or more toxic documents and twice as often there as elsewhere, and those of the identity terms,
    take part. With one label only, the model is its share.
    """
    y = np.array([v for _, v in sample], np.float64)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 0.01) / (1.01 - share))))
    texts = pa.array([t for t, _ in sample], pa.large_string())
    toxic, clean = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
    groups = list(text_groups(byte_lengths(texts)))
    for a, b in groups:
        d, f = document_features(texts.slice(a, b - a))
        bad = y[a + d] == 1
        toxic += np.bincount(f[bad], minlength=SIZE)
        clean += np.bincount(f[~bad], minlength=SIZE)
    used = (toxic >= 3) & (toxic * (y == 0).sum() >= 2 * np.maximum(clean, 1) * (y == 1).sum())
    pairs = [(t, s) for text, _ in sample for t, s in swapped(text, identity, swaps)]
    if pairs:
        terms = pa.array(sorted({w for g in identity for t in g for w in t.split()}), pa.large_string())
        used[word_features(terms)[1]] |= toxic[word_features(terms)[1]] > 0
    keep = np.flatnonzero(used)
    column = np.full(SIZE, -1, np.int64)
    column[keep] = np.arange(len(keep))
    parts = [(a + d, column[f]) for a, b in groups for d, f in [document_features(texts.slice(a, b - a), keep)]]
    rows, cols = (np.concatenate(x) for x in zip(*parts))
    before, after = (document_features(pa.array([p[k] for p in pairs], pa.large_string()), keep) for k in (0, 1))
    pair_rows = np.concatenate([before[0], after[0]])
    pair_cols = column[np.concatenate([before[1], after[1]])]
    sign = np.concatenate([np.ones(len(before[0])), -np.ones(len(after[0]))])
    w, b = np.zeros(len(keep)), float(np.log(y.mean() / (1 - y.mean())))
    gw, gb = np.full(len(keep), 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(rows, w[cols], len(y))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(cols, e[rows], len(keep))
        if pairs:
            change = np.bincount(pair_rows, sign * w[pair_cols], len(pairs))
            g += 2 * strength / len(pairs) * np.bincount(pair_cols, sign * change[pair_rows], len(keep))
        gw, gb = gw + g * g, gb + e.sum() ** 2
        step = 0.5 / np.sqrt(gw)
        w = np.maximum(w - step * (g + sparse), 0)
        b -= 0.5 / np.sqrt(gb) * e.sum()
    some = w > 1e-6
    return Model(keep[some], w[some], b)


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    docs, feats = document_features(texts, model.features)
    z = model.bias + np.bincount(docs, model.weights[np.searchsorted(model.features, feats)], len(texts)) if len(model.features) else np.full(len(texts), model.bias)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a ``score`` column (replaced if there); a null text is scored as the empty text. One pass, no exchange."""
    lean(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # sparse weights: bounded by the fit's sample
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            parts = [score_texts(texts.slice(a, b - a), sent.value) for a, b in text_groups(byte_lengths(texts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *parts]))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(tidy(run), _with(docs, "score", "double"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn, rows: int = FIT_ROWS, text_bytes: int = FIT_TEXT_BYTES, identity=IDENTITY) -> Model:
    """Fits on at most ``rows`` labelled texts of at most ``text_bytes`` bytes where ``learn`` holds."""
    model = fit(labelled_sample(docs, labels, "toxic", learn, rows, text_bytes), identity)
    give_back()
    return model
