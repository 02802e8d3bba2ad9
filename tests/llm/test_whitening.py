"""Whitening against plain numpy over exact integers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, w int"


def _rows(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1) for i, v in zip(ids, vectors)], SCHEMA)


def _expected(vectors):
    x = np.floor(256 * np.asarray(vectors, np.float32).astype(np.float64)).astype(np.int64)
    different = np.unique(x, axis=0)
    n, sums = len(different), different.sum(0)
    values, right = np.linalg.eigh(np.cov(different.T.astype(np.float64), bias=True))
    values, right = values[::-1], right[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, values, (x - sums / n) @ right


def _check(got, vectors, k=4, tolerance=1e-9):
    n, deviation, values, turned = _expected(vectors)
    k = min(k, len(values))
    assert len(got) == len(vectors) * k
    for r in got:
        c = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9
        assert abs(r["whitened"]) == pytest.approx(abs(turned[r["vec_id"], c]) / np.sqrt(values[c]), abs=tolerance)


@pytest.mark.parametrize("parts, fan", [(1, 8), (13, 2), (40, 8)])
def test_against_numpy(spark, monkeypatch, parts, fan):
    rng = np.random.default_rng(parts)
    vectors = rng.normal(3, 1, (400, 7)) * np.arange(1, 8)
    vectors[100:250] = vectors[99]  # a third and more are copies of one row
    monkeypatch.setattr(whitening, "FAN", fan)
    monkeypatch.setattr(whitening.fit, "__defaults__", ("x", 4, fan))
    monkeypatch.setattr(whitening, "cut", lambda df, name, own=whitening.cut: own(df.repartition(parts) if name == "whitening-fit" else df, name))
    _check(whitening.whitened(_rows(spark, vectors)).collect(), vectors)


def test_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted(table.collect(), key=lambda r: r["vec_id"])
    assert [r["vec_id"] for r in rows] == list(range(len(rows)))
    _check(whitening.whitened(table).collect(), [r["embedding"] for r in rows])


def test_signs_are_the_same_for_all_rows(spark):
    vectors = np.random.default_rng(1).normal(0, 1, (60, 3))
    got = whitening.whitened(_rows(spark, vectors)).orderBy("vec_id").collect()
    _, _, values, turned = _expected(vectors)
    for c in range(3):
        own = np.array([r["whitened"] for r in got if r["component"] == c + 1]) * np.sqrt(values[c])
        assert np.allclose(own, turned[:, c]) or np.allclose(own, -turned[:, c])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1, 2], [3, -1], None, [nan, 1], [inf, 1], [None, 1], [], [1, 2, 3], [1, 2], [0.5, 0.25]]
    got = whitening.whitened(_rows(spark, vectors, [0, 1, 2, 3, 4, 5, 6, 7, None, 0])).collect()
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["component"]) for r in got) == [(-1, 1), (-1, 2), (0, 1), (0, 1), (0, 2), (0, 2), (1, 1), (1, 2)]
    assert {r["n"] for r in got} == {3}
    assert whitening.whitened(_rows(spark, []).where("false")).collect() == []
    assert whitening.whitened(_rows(spark, [None, [nan]])).collect() == []


def test_directions_without_variance(spark):
    got = whitening.whitened(_rows(spark, [[1, 5, 2], [2, 5, 4], [7, 5, 14]])).collect()
    assert {(r["component"], r["whitened"] is None, r["explained"] > 0.999) for r in got} == {(1, False, True), (2, True, False), (3, True, False)}
    one = whitening.whitened(_rows(spark, [[1, 5], [1, 5]])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] is None and r["deviation"] == 0 for r in one)


def test_sums_beyond_doubles_and_deviations_beyond_longs(spark):
    far = [[2.0**45, 1.0], [2.0**45, 2.0], [2.0**45, 4.0]]  # x about 2^53
    got = whitening.whitened(_rows(spark, far)).collect()
    assert {r["deviation"] for r in got if r["vec_id"] == 0} == {(3 * 256 - 7 * 256) ** 2}
    wide = whitening.whitened(_rows(spark, [[2.0**40, 1.0], [-(2.0**40), 2.0]])).collect()
    assert {r["deviation"] for r in wide} == {None}
    huge = whitening.whitened(_rows(spark, [[1e30, 1.0], [-1e30, 2.0]])).collect()
    assert len(huge) == 4 and all(r["whitened"] is None or abs(abs(r["whitened"]) - 1) < 1e-6 for r in huge)


def test_whiten_keeps_columns(spark):
    rows = _rows(spark, [[1, 2], [3, -1], [0, 1]]).select("vec_id", whitening.scaled("embedding").alias("x"), "w", F.lit("k").alias("whitened"))
    model = whitening.fit(whitening.fit_list(rows))
    got = whitening.whiten(rows, model)
    assert got.columns == ["vec_id", "x", "w", "whitened"] and all(len(r["whitened"]) == 2 and r["w"] == 1 for r in got.collect())
