"""Benchmark decontamination by latent semantic retrieval.

1. Terms are words in lower case without marks at their edges; a term's column is its hash modulo COLUMNS, so tables over columns
   have one size for any vocabulary. A passage is a block of 32 words. One pass over all passages of all documents counts the
   passages with each column and writes the columns of each, 64 bytes a passage.
2. Weights. A column in more than MAX_SHARE of the passages has no weight, unless it is among the rarest of a benchmark
   passage that carry COVER of its words, so that copies of a passage, however many, can't take its weight away. Weights of the
   others differ by SPREAD at most (inverse document frequency); a term counts once a passage.
3. The weighted rows of all passages and of the benchmark's (64 words at most; FIT_WEIGHT times as long, and longer where there
   are more than EVEN passages, so that they are not lost among the others) are factored together by a distributed randomised
   SVD of rank RANK, far below the number of rows: tasks send A^T (A X) in slices of columns, which an exchange adds up, and
   the driver orthonormalises. Terms that keep the same company get like vectors.
4. Every window of two blocks of every document is projected. A benchmark passage becomes a candidate where the cosine is at
   least ``min_cosine`` and the window's latent vector reaches ``min_reach`` of the passage's along it; the latter passes over
   windows whose cosine rests on a word or two.
5. A candidate counts if the longest common subsequence of words covers ``min_lcs`` of the passage or, for paraphrases,
   ``min_paraphrase`` of it while the answer is there too: the item's answer column, if any, or else the rarest third of its
   weighted terms, at least ``min_answer`` of them. Words are compared by 64-bit hashes here, not by columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_lengths, cut, give_back, hash_words, lean, split_words, text_groups, tidy
from .toxicity import EDGE

BLOCK, PASSAGE, COLUMNS, RANK = 32, 64, 1 << 15, 96
#: Of the benchmark: passages a latent space, latent spaces a pass over the documents, bytes of text a pass.
MODEL_PASSAGES, MODELS, PASS_BYTES = 512, 4, 8 << 20
MAX_SHARE, COVER, SPREAD = 0.01, 0.75, 0.2
EVEN, FIT_WEIGHT, FIT_TASKS, FIT_ROWS, OVER, SLICES = 8_192, 4.0, 4, 16_384, 8, 16
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("begin", pa.int64())])


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of the texts, code of every word, hash of each code's term). A word of marks alone is a term of its own."""
    offsets, words = split_words(texts, lower=False)
    if not len(words):
        return offsets, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    bare = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=EDGE)
    bare = pc.if_else(pc.equal(pc.binary_length(bare), 0), coded.dictionary, bare)
    return offsets, np.asarray(coded.indices).astype(np.int64), hash_words(bare)


def columns_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (COLUMNS.bit_length() - 1))).astype(np.int32)


def grid_of(offsets: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first block of each text, blocks x BLOCK columns): each block's columns ascending, repeats and gaps as COLUMNS."""
    size = np.diff(offsets)
    blocks = -(-size // BLOCK)
    starts = np.cumsum(blocks) - blocks
    grid = np.full(int(blocks.sum()) * BLOCK, COLUMNS, np.int32)
    grid[np.arange(len(columns)) + np.repeat(starts * BLOCK - offsets[:-1], size)] = columns
    grid = grid.reshape(-1, BLOCK)
    grid.sort(axis=1)
    grid[:, 1:][grid[:, 1:] == grid[:, :-1]] = COLUMNS
    return starts, grid


@dataclass
class Passages:
    """Benchmark passages: item ids, term hashes in order, answers' term hashes (None: without an answer column)."""

    items: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray | None]


def passages_of(rows: list[tuple]) -> Passages:
    """From (item_id, text, answer or None): texts are cut into passages of at most PASSAGE words of like length."""
    out = Passages([], [], [])
    for item, text, answer in rows:
        _, codes, hashes = term_hashes(pa.array([text or ""], pa.large_string()))
        own = hashes[codes]
        reply = None
        if answer is not None:
            _, c, h = term_hashes(pa.array([answer], pa.large_string()))
            reply = np.unique(h[c])
        for part in np.array_split(own, max(1, -(-len(own) // PASSAGE))):
            if len(part):
                out.items.append(item)
                out.words.append(part)
                out.answers.append(reply)
    return out


_SURVEY = pa.schema([("column", pa.int64()), ("n", pa.int64()), ("idx", pa.binary())])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(column, passages with it; -1: all passages) of the task, and the grids of its passages in 16 bits a column."""
    total, n = np.zeros(COLUMNS, np.int64), 0
    for batch in batches:
        texts = batch.column("text")
        for a, b in text_groups(byte_lengths(texts)):
            offsets, codes, hashes = term_hashes(texts.slice(a, b - a))
            _, grid = grid_of(offsets, columns_of(hashes)[codes])
            total += np.bincount(grid.ravel(), minlength=COLUMNS + 1)[:COLUMNS]
            n += len(grid)
            for i in range(0, len(grid), FIT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([grid[i : i + FIT_ROWS].astype(np.uint16).tobytes()], pa.binary())], schema=_SURVEY)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n)), pa.nulls(len(some) + 1, pa.binary())], schema=_SURVEY)


def survey(docs: DataFrame) -> tuple[np.ndarray, int, DataFrame]:
    """(passages with each column, passages, all passages' grids as idx binary) over all texts; a number a column reaches the driver."""
    lean(docs.sparkSession)
    rows = cut(docs.select("text").mapInArrow(tidy(_survey), "column long, n long, idx binary"), "passage-survey")
    df, n = np.zeros(COLUMNS, np.int64), 0
    for r in rows.where("column IS NOT NULL").groupBy("column").agg(F.sum("n").alias("n")).collect():
        if r["column"] < 0:
            n = r["n"]
        else:
            df[r["column"]] = r["n"]
    return df, n, rows.where("idx IS NOT NULL").select("idx")


def summed_rows(x: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """For each row of ``grid`` the sum of the rows of ``x`` that it names; rows go in slices that stay in the processor's cache."""
    out = np.empty((len(grid), x.shape[1]), x.dtype)
    one = np.ones((1, grid.shape[1]), x.dtype)
    for i in range(0, len(grid), 64):
        part = grid[i : i + 64]
        out[i : i + 64] = np.matmul(one, np.take(x, part.ravel(), axis=0, mode="clip").reshape(*part.shape, x.shape[1]))[:, 0]
    return out


def spread_rows(total: np.ndarray, grid: np.ndarray, y: np.ndarray) -> None:
    """Adds each row of ``y`` to the rows of ``total`` that the same row of ``grid`` names; gaps are left out.

    Columns in many rows are summed up one by one, the others together, their first rows, their second ones and so on.
    """
    flat = grid.ravel()
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    order = order[: np.searchsorted(flat, COLUMNS)] // grid.shape[1]
    if not len(order):
        return
    flat = flat[: len(order)]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    n = np.diff(np.append(first, len(flat)))
    by = np.argsort(-n, kind="stable")
    first, n, column = first[by], n[by], flat[first[by]]
    many = int(np.searchsorted(-n, -128))
    part = np.zeros((len(column), y.shape[1]), y.dtype)
    for k in range(many):
        part[k] = np.ones(n[k], y.dtype) @ np.take(y, order[first[k] : first[k] + n[k]], axis=0, mode="clip")
    for k in range(int(n[many]) if many < len(n) else 0):
        live = many + int(np.searchsorted(-n[many:], -k))
        part[many:live] += np.take(y, order[first[many:live] + k], axis=0, mode="clip")
    total[column] += part


def _passage_product(weight):
    """As ``_product``, of grids (idx, 16 bits a column; ``width`` a row) whose weighted rows have the length ``length``."""

    def with_basis(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = np.append(weight.value, np.float32(0))
            x = np.zeros((COLUMNS + 1, sent.value.shape[1]), np.float32)
            np.multiply(sent.value, w[:-1, None], out=x[:-1])
            total = np.zeros_like(x)
            for batch in batches:
                for raw, width, length in zip(batch.column("idx"), batch.column("width").to_pylist(), batch.column("length").to_pylist()):
                    grid = np.frombuffer(raw.as_buffer(), np.uint16).reshape(-1, width)
                    squared = np.square(w)[grid].sum(axis=1)
                    y = summed_rows(x, grid)
                    y *= np.divide(length * length, squared, out=np.zeros_like(squared), where=squared > 0)[:, None]
                    spread_rows(total, grid, y)
            total[:-1] *= w[:-1, None]
            yield from _slices(total[:-1])

        return run

    return with_basis


def _slices(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    if total.any():
        for k, part in enumerate(np.array_split(total, SLICES)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "part"])


def _product(sent):
    """A^T (A X) of a task's rows, in slices of columns."""

    def add(total: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        idx, val = (np.concatenate(x) for x in zip(*rows))
        size = np.array([len(i) for i, _ in rows])
        y = np.add.reduceat(sent.value[idx] * val[:, None], np.cumsum(size) - size, axis=0)
        part = np.repeat(y, size, axis=0) * val[:, None]
        order = np.argsort(idx, kind="stable")
        which, first = np.unique(idx[order], return_index=True)
        total[which] += np.add.reduceat(part[order], first, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(sent.value.shape, np.float32), []
        for batch in batches:
            for i, v in zip(batch.column("idx"), batch.column("val")):
                i, v = np.frombuffer(i.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32)
                if len(i):
                    rows.append((i, v))
                if len(rows) == 1_024:
                    add(total, rows)
                    rows = []
        if rows:
            add(total, rows)
        yield from _slices(total)

    return run


def _added(group: pa.Table) -> pa.Table:
    total = None
    for part in group.column("part"):
        own = np.frombuffer(part.as_py(), np.float32)
        total = own.copy() if total is None else total + own
    return pa.Table.from_arrays([group.column("slice").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["slice", "part"])


def _orthonormal(y: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span those of ``y``, in order of their singular values; ``y`` is used up.

    By inner products of the columns, twice, in slices of rows and in place: a factorisation of LAPACK would hold several copies.
    """
    rows = range(0, len(y), 2_048)
    for again in (False, True):
        inner = np.zeros((y.shape[1], y.shape[1]))
        for i in rows:
            inner += y[i : i + 2_048].T @ y[i : i + 2_048]
        if again:
            turn = np.linalg.inv(np.linalg.cholesky(inner)).T
        else:
            squared, turn = np.linalg.eigh(inner)
            squared, turn = squared[::-1], turn[:, ::-1]
            some = squared > max(squared[0], 0) * 1e-12
            turn = turn[:, some] / np.sqrt(squared[some])
        for i in rows:
            y[i : i + 2_048, : turn.shape[1]] = y[i : i + 2_048] @ turn
        y = y[:, : turn.shape[1]]
    return y


def randomised_svd(rows: DataFrame, columns: int, rank: int, seed: int = 5, powers: int = 1, product=_product) -> np.ndarray:
    """An orthonormal basis (columns x rank at most) of the leading right singular space of a sparse matrix.

    ``rows``: one matrix row a record, as idx (32-bit columns) and val (32-bit floats) in binary, or what else ``product`` takes. Each round every task sends
    one partial product of columns * (rank + OVER) floats, which an exchange adds up slice by slice; their sum reaches the driver.
    """
    spark = rows.sparkSession
    rng = np.random.default_rng(seed)
    basis = rng.standard_normal((columns, min(rank + OVER, columns)), np.float32)
    for _ in range(powers + 1):
        sent = spark.sparkContext.broadcast(basis.astype(np.float32, copy=False))
        width = basis.shape[1]
        del basis  # the driver holds one of them at a time
        summed = rows.mapInArrow(tidy(product(sent)), "slice int, part binary").groupBy("slice").applyInArrow(_added, "slice int, part binary").collect()
        sent.destroy()
        del sent
        give_back()
        if not summed:
            return np.zeros((columns, 0))
        summed.sort(key=lambda r: -r["slice"])
        basis, at = np.empty(columns * width), 0
        while summed:
            part = np.frombuffer(summed.pop()["part"], np.float32)
            basis[at : at + len(part)] = part
            at += len(part)
        basis = _orthonormal(basis.reshape(columns, width))
    return basis[:, :rank]


@dataclass
class Model:
    project: np.ndarray  # COLUMNS + 1 x rank: weight times the basis; the last row is for gaps
    latent: np.ndarray  # passages x rank, unit rows
    length: np.ndarray  # of each passage's latent vector
    items: np.ndarray
    words: list[np.ndarray]
    answers: list[np.ndarray]


def weights(passages: Passages, df: np.ndarray, n: int, max_share: float) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each column, whether it is rare: may stand for an answer)."""
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    rare = df <= max_share * n
    keep = rare.copy()
    for words in passages.words:
        own, tf = np.unique(columns_of(words), return_counts=True)
        order = np.argsort(df[own], kind="stable")
        own, carried = own[order], np.cumsum(tf[order])
        rare[own[:4]] = True
        keep[own[: max(4, int(np.searchsorted(carried, COVER * carried[-1])) + 1)]] = True
    return np.where(keep, 1 + SPREAD * idf / idf.max(), 0.0), rare


def build(surveyed: tuple[np.ndarray, int, DataFrame], passages: Passages, max_share: float = MAX_SHARE) -> list[Model]:
    """The latent spaces of some benchmark passages, MODEL_PASSAGES each, from what ``survey`` found."""
    df, n, grids = surveyed
    if not n or not passages.words:
        return []
    weight, rare = weights(passages, df, n, max_share)
    spark, out = grids.sparkSession, []
    sent = spark.sparkContext.broadcast(weight.astype(np.float32))
    length = FIT_WEIGHT * max(1.0, n / EVEN) ** 0.5
    tasks = max(FIT_TASKS, spark.sparkContext.defaultParallelism)  # each sends columns * (RANK + OVER) floats a round
    grids = grids.select("idx", F.lit(BLOCK).alias("width"), F.lit(1.0).alias("length"))
    for i in range(0, len(passages.items), MODEL_PASSAGES):
        own = range(i, min(i + MODEL_PASSAGES, len(passages.items)))
        used = [np.unique(columns_of(passages.words[k])) for k in own]
        used = [c[weight[c] > 0].astype(np.int32) for c in used]
        padded = np.full((len(used), PASSAGE), COLUMNS, np.uint16)
        for k, c in enumerate(used):
            padded[k, : len(c)] = c
        matrix = grids.unionAll(spark.createDataFrame([(padded.tobytes(), PASSAGE, length)], "idx binary, width int, length double")).coalesce(tasks)
        rank = min(RANK, max(1, (n + len(used)) // 2))
        basis = randomised_svd(matrix, COLUMNS, rank, product=_passage_product(sent))
        project = np.zeros((COLUMNS + 1, basis.shape[1]), np.float32)
        np.multiply(basis, weight[:, None], out=project[:-1], casting="same_kind")
        del basis
        give_back()
        latent = np.array([project[c].sum(axis=0) for c in used])
        reach = np.linalg.norm(latent, axis=1)
        answers = []
        for k in own:
            reply = passages.answers[k]
            if reply is None:
                terms = np.unique(passages.words[k])
                terms = terms[rare[columns_of(terms)]]
                reply = terms[np.argsort(-weight[columns_of(terms)], kind="stable")[: max(1, len(terms) // 3)]]
            answers.append(reply)
        words = [passages.words[k] for k in own]
        out.append(Model(project, latent / np.maximum(reach, 1e-9)[:, None], reach, np.array([passages.items[k] for k in own]), words, answers))
    return out


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a`` (Hyyro, 2004)."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Places:
    """Where each passage holds each term, for subsequences of many windows at once: a passage's PASSAGE places are one word."""

    terms: np.ndarray  # all different ones, ascending
    local: np.ndarray  # passages x terms + 1: number of the term within the passage, 0 where it isn't there
    masks: np.ndarray  # passages x numbers: the places


def places_of(words: list[np.ndarray]) -> Places:
    terms = np.unique(np.concatenate(words))
    local = np.zeros((len(words), len(terms) + 1), np.uint8)
    masks = np.zeros((len(words), PASSAGE + 1), np.uint64)
    for k, own in enumerate(words):
        unique, number = np.unique(own, return_inverse=True)
        local[k, np.searchsorted(terms, unique)] = np.arange(1, len(unique) + 1)
        np.bitwise_or.at(masks[k], number + 1, np.uint64(1) << np.arange(len(own), dtype=np.uint64))
    return Places(terms, local, masks)


def term_numbers(hashes: np.ndarray, places: Places) -> np.ndarray:
    """The number of each hash among the passages' terms; as many as there are terms where it is none of them."""
    at = np.minimum(np.searchsorted(places.terms, hashes), len(places.terms) - 1)
    return np.where(places.terms[at] == hashes, at, len(places.terms))


def lcs_many(numbers: np.ndarray, begin: np.ndarray, end: np.ndarray, passages: np.ndarray, places: Places) -> np.ndarray:
    """``lcs`` of each passage with the terms ``numbers[begin:end]`` of its window; windows go in slices."""
    out = np.zeros(len(begin), np.int64)
    for i in range(0, len(begin), 2_048):
        a, b, q = begin[i : i + 2_048], end[i : i + 2_048], passages[i : i + 2_048]
        v = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
        for t in range(int((b - a).max())):
            at = a + t
            number = np.where(at < b, numbers[np.minimum(at, len(numbers) - 1)], len(places.terms))
            u = v & places.masks[q, places.local[q, number]]
            v = (v + u) | (v - u)  # places behind the passage's end stay set
        out[i : i + 2_048] = 64 - np.bitwise_count(v).astype(np.int64)
    return out


def near_passages(grid: np.ndarray, pairs: np.ndarray, model: Model, min_cosine: float, min_reach: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first block, candidates' blocks from there, their passages, cosines): ``pairs`` marks blocks that the next one goes with.

    A block without a partner before and behind it is a window of its own. Blocks go in slices, whatever a text's length.
    """
    alone = ~pairs & ~np.concatenate([[False], pairs[:-1]])
    for i in range(0, len(grid), 4_096):
        part = grid[i : i + 4_097]
        x = summed_rows(model.project, part)
        n = min(4_096, len(grid) - i)
        two = np.flatnonzero(pairs[i : i + n])
        left = np.concatenate([two, np.flatnonzero(alone[i : i + n])])
        windows = np.concatenate([x[two] + x[two + 1], x[left[len(two) :]]])
        size = np.linalg.norm(windows, axis=1)
        some = np.flatnonzero(size > 0)
        dot = windows[some] @ model.latent.T
        r, q = np.nonzero((dot >= min_cosine * size[some, None]) & (dot >= min_reach * model.length))
        if len(r):
            yield i, left[some[r]], q, dot[r, q] / size[some[r]]


def at_most_shared(numbers: np.ndarray, offsets: np.ndarray, starts: np.ndarray, doc: np.ndarray, windows: np.ndarray, passages: np.ndarray, places: Places) -> np.ndarray:
    """An upper bound of the longest common subsequence of each window, with the blocks beside it, and its passage: how many of
    the passage's places hold a term that is there. A block and passage that several windows ask for are looked up once."""
    width, steps = np.int64(len(places.masks)), (-1, 0, 1, 2)
    at = [np.clip(windows + k, 0, len(doc) - 1) for k in steps]
    asked, number = np.unique(np.concatenate([np.where(doc[x] == doc[windows], x * width + passages, -1) for x in at]), return_inverse=True)
    covered = np.zeros(len(asked), np.uint64)
    for i in range(int(np.searchsorted(asked, 0)), len(asked), 8_192):
        block, q = np.divmod(asked[i : i + 8_192], width)
        begin = offsets[doc[block]] + (block - starts[doc[block]]) * BLOCK
        word = begin[:, None] + np.arange(BLOCK)
        term = np.where(word < offsets[doc[block] + 1][:, None], numbers.take(word, mode="clip"), len(places.terms))
        local = places.local.ravel().take(q[:, None] * places.local.shape[1] + term)
        covered[i : i + 8_192] = np.bitwise_or.reduce(places.masks.ravel().take(q[:, None] * places.masks.shape[1] + local), axis=1)
    return np.bitwise_count(np.bitwise_or.reduce(covered[number].reshape(len(steps), -1), axis=0)).astype(np.int64)


def _search(sent, limits: tuple[float, float, float, float, float]):
    min_cosine, min_reach, min_lcs, min_paraphrase, min_answer = limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [(m, places_of(m.words), np.array([len(w) for w in m.words]), [frozenset(a.tolist()) for a in m.answers]) for m in sent.value]
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for a, b in text_groups(byte_lengths(texts)):
                offsets, codes, hashes = term_hashes(texts.slice(a, b - a))
                starts, grid = grid_of(offsets, columns_of(hashes)[codes])
                if not len(grid):
                    continue
                doc = np.searchsorted(starts, np.arange(len(grid)), side="right") - 1
                pairs = np.concatenate([doc[1:] == doc[:-1], [False]])
                best: dict[tuple[int, int], tuple] = {}
                for own, places, size, replies in sides:
                    numbers = term_numbers(hashes, places)[codes]
                    for first, blocks, passages, cosines in near_passages(grid, pairs, own, min_cosine, min_reach):
                        fair = at_most_shared(numbers, offsets, starts, doc, first + blocks, passages, places) >= min_paraphrase * size[passages]
                        w, q, cosines = (first + blocks)[fair], passages[fair], cosines[fair]
                        d = doc[w]
                        begin = offsets[d] + (w - starts[d]) * BLOCK
                        near = np.maximum(offsets[d], begin - BLOCK), np.minimum(offsets[d + 1], begin + 3 * BLOCK)
                        share = lcs_many(numbers, *near, q, places) / size[q]
                        for k in np.flatnonzero(share >= min_paraphrase).tolist():
                            answers = replies[q[k]]
                            reply = len(answers.intersection(hashes[codes[near[0][k] : near[1][k]]].tolist())) / len(answers) if answers else 0.0
                            if share[k] >= min_lcs or reply >= min_answer:
                                key = (int(d[k]), int(own.items[q[k]]))
                                found = (float(share[k]), float(cosines[k]), float(reply), int(begin[k] - offsets[d[k]]))
                                if key not in best or found > best[key]:
                                    best[key] = found
                if best:
                    keys = sorted(best)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([a + k[0] for k in keys])), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([best[k][j] for k in keys]) for j in (1, 0, 2)), pa.array([best[k][3] for k in keys], pa.int64())],
                        schema=_FOUND,
                    )

    return run


LIMITS = {"min_cosine": 0.5, "min_reach": 0.3, "min_lcs": 0.6, "min_paraphrase": 0.4, "min_answer": 0.8}


def clean(docs: DataFrame, benchmark: DataFrame, *, answer: str | None = None, **limits: float) -> DataFrame:
    """The rows of ``docs`` in which ``contaminated`` finds nothing, with all their columns; a narrow pass a batch, no join."""
    for models in _latent(docs, benchmark, answer):
        docs = docs.mapInArrow(tidy(_without(docs.sparkSession.sparkContext.broadcast(models), tuple((LIMITS | limits).values()))), docs.schema)
    return docs


def _without(sent, limits: tuple[float, ...]):
    find = _search(sent, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["doc_id", "text"])
            keep = np.ones(batch.num_rows, bool)
            for found in find(iter([numbered])):
                keep[np.asarray(found.column("doc_id"))] = False
            yield batch.filter(pa.array(keep))

    return run


def _latent(docs: DataFrame, benchmark: DataFrame, answer: str | None) -> Iterator[list[Model]]:
    """The benchmark's latent spaces, a pass over the documents each; passes are by a hash of the item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if not size["n"]:
        return
    turns = max(1, -(-size["n"] // (MODEL_PASSAGES * MODELS)), -(-size["bytes"] // PASS_BYTES))
    surveyed = survey(docs)
    for t in range(turns):
        rows = sorted((tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)) == t).distinct().collect()), key=lambda r: (r[0], r[1], r[2] or ""))
        if models := build(surveyed, passages_of(rows)):
            yield models


def contaminated(docs: DataFrame, benchmark: DataFrame, *, answer: str | None = None, **limits: float) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, begin: what of the benchmark is found where; one row a document row and item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; null texts have no words, and neither they nor null item ids are
    looked for. Rows that repeat are each found. ``begin`` is the window's first word. ``limits``: see LIMITS. The benchmark comes
    to the driver in batches by items and bytes, each a pass over the documents, so what is broadcast is bounded: at most MODELS
    tables of COLUMNS * RANK floats with the batch's passages.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs double, answer double, begin long")
    found = [docs.mapInArrow(tidy(_search(spark.sparkContext.broadcast(m), tuple((LIMITS | limits).values()))), out.schema) for m in _latent(docs, benchmark, answer)]
    for k, part in enumerate(found):
        out = out.unionAll(part) if k else part
    return out
