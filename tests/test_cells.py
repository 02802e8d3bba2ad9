"""The join by cells and the saved index against brute force, and distributed k-center against the plain one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import cells, dedup, retrieve, sample, vectors
from lexmill.storage import staging_path


def _frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")


def _cosines(x):
    u = np.asarray(x, float)
    u = u / np.linalg.norm(u, axis=1)[:, None]
    return np.round(u @ u.T, 12)


def _flat(n, seed=0):
    """Vectors of eight places near a surface of two dimensions, as bounds need: neighbours are far nearer than the rest."""
    rng = np.random.default_rng(seed)
    t = rng.uniform(0, 2 * np.pi, (n, 2))
    return np.concatenate([np.cos(t), np.sin(t), 0.02 * rng.normal(size=(n, 4))], axis=1)


def _expected(x, t, k):
    s = _cosines(x)
    np.fill_diagonal(s, -9)
    out = set()
    for i, row in enumerate(s):
        order = np.lexsort((np.arange(len(row)), -row))
        out |= {(i, int(j), row[j]) for j in order[row[order] >= t][:k]}
    return out


@pytest.mark.parametrize("k", [None, 3])
@pytest.mark.parametrize("n_pivots, pack", [(1, 2_048), (40, 2_048), (40, 16)])
def test_similar_against_all_pairs(spark, monkeypatch, k, n_pivots, pack):
    monkeypatch.setattr(cells, "PACK", pack)  # small packs split the cells
    x = np.concatenate([_flat(300), np.repeat(_flat(1, 5), 60, axis=0)])
    found = cells.similar(_frame(spark, x).repartition(5), "vec_id", "embedding", 0.98, k, n_pivots)
    assert {(r["query_id"], r["id"], r["score"]) for r in found.links.collect()} == _expected(x, 0.98, k)
    tested = found.tested.first()[0]
    assert tested <= len(x) ** 2 and (n_pivots == 1 or tested < 0.25 * len(x) ** 2)


def test_similar_in_noise(spark):
    x = np.random.default_rng(3).normal(size=(200, 6))
    for t in (0.3, 0.9):
        found = cells.similar(_frame(spark, x), "vec_id", "embedding", t, None, 17)
        assert {(r["query_id"], r["id"], r["score"]) for r in found.links.collect()} == _expected(x, t, None)


@pytest.mark.parametrize("n", [100_000, 600_000])
def test_a_pack_is_sent_to_a_fixed_number_of_groups(n):
    units = [(c, 0) for c in range(n // 2_000)]
    groups, routes = cells._routes(units, np.full(len(units), 2_000.0), 64, 19, None)
    assert groups == cells.GROUPS and all(len(to) == groups for _, _, to in routes)
    sides: dict[int, set] = {}
    for _, _, to in routes:
        for task, side in to:
            sides.setdefault(task, set()).add(side)
    assert len(sides) == groups * (groups + 1) // 2 and all(x in ({0, 1}, {2}) for x in sides.values())


@pytest.mark.parametrize("k", [None, 3])
def test_similar_in_many_groups(spark, monkeypatch, k):
    monkeypatch.setattr(cells, "PACK", 16)
    monkeypatch.setattr(cells, "MORE_LINKS", 5)
    x = np.concatenate([np.random.default_rng(5).normal(size=(230, 6)), np.repeat(_flat(1, 5)[:, :6], 70, axis=0)])
    df = _frame(spark, x)
    found = cells.similar(df, "vec_id", "embedding", 0.5, k, 1)
    want = {e[:2]: e[2] for e in _expected(x, 0.5, k)}
    got = {(r["query_id"], r["id"]): r["score"] for r in found.links.collect()}
    assert got == pytest.approx(want, abs=2e-12)
    if k is None:
        one = cells.similar(df, "vec_id", "embedding", 0.5, n_pivots=1, both=False).links
        assert sorted((r["query_id"], r["id"]) for r in one.collect()) == sorted(e for e in want if e[0] < e[1])


def test_neighbours_without_blocks_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(cells, "PACK", 16)
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda self: pytest.fail("vectors reached the driver"))
    x = np.concatenate([np.random.default_rng(6).normal(size=(120, 5)), np.ones((30, 5)), np.zeros((3, 5))])
    df = _frame(spark, x, [*range(150), 7, 7, 200])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((u := x / np.where(norm == 0, 1, norm)) @ u.T, 12) + 0.0
    ids = np.array([*range(150), 7, 7, 200])
    want = []
    for i in (0, 5, 130, 152):
        order = [j for j in np.lexsort((ids, -s[i])) if ids[j] != ids[i]][:4]
        want += [(int(ids[i]), int(ids[j]), s[i, j], r + 1) for r, j in enumerate(order)]
    got = vectors.self_neighbours(df, "vec_id", "embedding", 4).where("query_id in (0, 5, 130, 200)").collect()
    assert sorted((r["query_id"], r["id"], round(r["score"], 10), r["rank"]) for r in got) == sorted((q, i, round(v, 10), r) for q, i, v, r in want)
    few = vectors.self_neighbours(df.where("vec_id < 3"), "vec_id", "embedding", 9)
    assert few.count() == 6 and vectors.self_neighbours(df.where("false"), "vec_id", "embedding").collect() == []


def test_similar_edges(spark):
    nan = float("nan")
    x = [[1, 0], None, [nan, 1], [None, 1], [0, 0], [], [2, 0], [1, 1, 1]]
    df = _frame(spark, x).unionAll(spark.createDataFrame([(None, [1.0, 0.0]), (0, [3.0, 0.0])], "vec_id long, embedding array<double>"))
    got = sorted((r["query_id"], r["id"]) for r in cells.similar(df, "vec_id", "embedding", 0.9).links.collect())
    assert got == [(0, 6), (0, 6), (6, 0), (6, 0)]
    empty = cells.similar(df.where("false"), "vec_id", "embedding", 0.9)
    assert empty.links.collect() == [] and empty.tested.first()[0] == 0
    with pytest.raises(ValueError):
        cells.similar(df, "vec_id", "embedding", 0.0)


def test_index_reads_only_cells_that_matter(spark):
    x = _flat(2_000, 1)
    df = _frame(spark, x).withColumns({"score": F.lit("own"), "label": F.col("vec_id") % 3})
    path = staging_path(spark, "index")
    cells.save(df, path, "vec_id", "embedding", 60)
    s = _cosines(x)
    q = df.where("vec_id in (5, 700)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    found = cells.search(spark, path, q, 4)
    want = {(i, r + 1, int(j)) for i in (5, 700) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:4])}
    assert {(r["query_id"], r["rank"], r["id"]) for r in found.results.collect()} == want
    assert found.cells > 40 and sum(found.read) < 0.4 * found.cells
    plan = spark.read.parquet(f"{path}/rows").where(F.col("_cell").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [_cell" in plan and "PartitionFilters: []" not in plan
    every = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    plain = vectors.search(every, df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 4)
    assert cells.search(spark, path, every, 4).results.select("query_id", "id", "rank").exceptAll(plain.select("query_id", "id", "rank")).count() == 0
    assert spark.read.parquet(f"{path}/rows").where("score = 'own'").count() == 2_000


def test_index_edges(spark):
    df = _frame(spark, [[1, 0], [0, 1], None, [0, 0]])
    path = staging_path(spark, "index")
    cells.save(df, path, "vec_id", "embedding")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])], "query_id long, v array<double>")
    got = [(r["query_id"], r["id"], r["rank"]) for r in cells.search(spark, path, q, 5).results.orderBy("rank").collect()]
    assert got == [(1, 0, 1), (1, 1, 2)]
    path = staging_path(spark, "index")
    cells.save(df.where("false"), path, "vec_id", "embedding")
    assert cells.search(spark, path, q, 5).results.collect() == []


@pytest.mark.parametrize("block", [10_000, 7])
def test_search_in_blocks(spark, block):
    x = np.random.default_rng(4).normal(size=(90, 5))
    df = _frame(spark, x).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = df.withColumnRenamed("id", "query_id")
    one = vectors.search(q, df, 3).collect()
    assert sorted(vectors.search(q, df, 3, block=block, block_bytes=400).collect()) == sorted(one)


def test_search_and_top_k_edges(spark):
    nan = float("nan")
    corpus = _frame(spark, [[1, 0], [0, 1], None, [nan, 1], [None, 2], [1, 2, 3], [0, 0]]).withColumns({"score": F.lit("x"), "query_id": F.lit(1), "rank": F.lit(2), "label": F.col("vec_id")})
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0])], "query_id long, v array<double>")
    got = retrieve.top_k(q, corpus, 5, id_col="vec_id", vector="embedding")
    assert got.columns == ["query_id", "id", "score", "label", "rank"]
    assert [(r["query_id"], r["id"]) for r in got.orderBy("rank").collect()] == [(1, 0), (1, 1), (1, 6)]
    only = retrieve.top_k(q, corpus, 5, id_col="vec_id", vector="embedding", only=(F.col("score") == "x") & (F.col("label") > 0))
    assert [r["id"] for r in only.orderBy("rank").collect()] == [1, 6]
    assert vectors.search(q.where("false"), corpus.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 3).collect() == []


def test_exact_dedup_on_positions(spark):
    df = spark.createDataFrame([(3, "a b"), (1, "ab"), (2, "c"), (None, "c"), (None, "d"), (5, None), (4, "")], "pos long, t string")
    plan = dedup.exact(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    kept, gone = {r["pos"] for r in dedup.exact(df, "t").collect()}, [r["pos"] for r in dedup.exact_removed(df, "t").collect()]
    assert {1, 2} <= kept and 3 not in kept and 3 in gone and not kept & {g for g in gone if g is not None}


def _plain(rows, quotas):
    out = []
    for g, q in quotas.items():
        own = sorted((p, v) for name, p, v in rows if name == g)
        if own:
            out += [(g, own[i][0]) for i in sample.k_center(np.array([v for _, v in own], float), q)]
    return sorted(out)


@pytest.mark.parametrize("keep", [2, 5, 4_096])
def test_k_center_over_many_passes(spark, monkeypatch, keep):
    monkeypatch.setattr(sample, "CANDIDATES", (keep, keep))
    rng = np.random.default_rng(keep)
    rows = [("a", i, v) for i, v in enumerate(rng.normal(size=(120, 3)).tolist())]
    rows += [("b", 1_000 - i, v) for i, v in enumerate(rng.integers(-1, 2, (90, 2)).astype(float).tolist())]  # ties, repeats and zero vectors
    rows += [("c", i, [1.0, 2.0]) for i in range(4)] + [("d", 7, [1.0, 0.0, 0.0])]
    quotas = {"a": 30, "b": 12, "c": 3, "d": 0, "e": 2}
    for names in (("a",), ("b", "c")):
        own = [r for r in rows if r[0] in names]
        df = spark.createDataFrame(own, "g string, pos long, v array<double>").repartition(6).withColumn("far", F.lit("x"))
        got = sample.k_center_by_group(df, "g", "v", "pos", quotas)
        assert got.columns == ["g", "pos", "v", "far"]
        assert sorted((r["g"], r["pos"]) for r in got.collect()) == _plain(own, {k: v for k, v in quotas.items() if k in names})


def test_k_center_edges(spark):
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, None), ("a", 3, [float("nan"), 1.0]), ("a", None, [0.0, 1.0]), ("a", 4, [1.0, 2.0, 3.0]), (None, 5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "g string, pos long, v array<double>")
    assert [r["pos"] for r in sample.k_center_by_group(df, "g", "v", "pos", {"a": 5}).collect()] == [1]
    assert sample.k_center_by_group(df.where("false"), "g", "v", "pos", {"a": 5}).collect() == []


def _scanned(edges):
    parent, out = {}, []

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b, s, slot in sorted((e for e in edges if None not in e[:2]), key=lambda e: (e[0], e[3])):
        u, v = root(a), root(b)
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((max(u, v), min(u, v), s, a, slot))
    return sorted(out)


@pytest.mark.parametrize("most", [1, 4, 1_000_000])
def test_removal_log_is_the_scan(spark, most):
    rng = np.random.default_rng(most)
    edges = []
    for a in range(60):
        for slot, b in enumerate(rng.choice(60, rng.integers(0, 3), replace=False).tolist()):
            edges.append((a, b if rng.random() < 0.5 else (a + 7) % 60, round(float(rng.random()), 6), slot + 1))
    edges += [(100, 100 + i, 0.9, i) for i in range(1, 20)] + [(200, 200, 0.5, 1), (None, 3, 0.5, 1), (3, None, 0.5, 9)]
    df = spark.createDataFrame(edges, "a long, b long, similarity double, slot int").repartition(3)
    log = dedup.removal_log(df, most)
    assert sorted(tuple(r) for r in log.collect()) == _scanned(edges)
    head = dedup.log_head(log, 5).collect()
    assert [(r["removed_id"], r["kept_id"]) for r in head] == [e[:2] for e in sorted(_scanned(edges), key=lambda e: (e[3], e[4]))[:5]]
    assert dedup.removal_log(df.where("false"), most).collect() == []


def test_no_window_over_a_component(spark, monkeypatch):
    """The first edges of a large component are found by ranges: rows are numbered within a range alone."""
    seen, cut = [], dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df, name: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df, name))[1])
    edges = [(a, a + b, 0.5, b) for a in range(20) for b in (1, 2)]
    log = dedup.removal_log(spark.createDataFrame(edges, "a long, b long, similarity double, slot int").repartition(3), 25)
    assert sorted(tuple(r) for r in log.collect()) == _scanned(edges)
    windows = [x for plan in seen for x in plan.splitlines() if "row_number()" in x and "Window [" in x]
    assert windows and all("_range" in x.split("row_number()")[1] for x in windows)


def test_kept_rows_need_no_scan(spark, monkeypatch):
    from lexmill import queries

    rows, _ = dedup.semantic(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), "vec_id", "embedding", queries.EDGE)
    monkeypatch.setattr(dedup, "removal_log", None)
    got = queries.queries()["q_semantic_kept"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["vec_id"] for r in got) == sorted(r["vec_id"] for r in rows.select("vec_id").collect())


@pytest.mark.parametrize("share", [0.02, 1.0])
def test_a_pack_keeps_few_links(share):
    """Where many rows are similar a pack soon drops what is not among its rows' best, and what stays is what one sort finds."""
    rng, k, n = np.random.default_rng(3), 5, 2_000
    rows = cells._Rows(np.arange(n), np.zeros((n, 2)), np.full(n, 0.4), k)
    most, every = 0, []
    for start in range(n, n + 30 * n, n):
        row = np.repeat(np.arange(n), 20 if share == 1.0 else 1)
        other, score = start + rng.integers(0, n, len(row)), np.round(rng.uniform(0.3, 1.0, len(row)), 2)
        every += [x for x in zip(row.tolist(), other.tolist(), score.tolist()) if x[2] >= 0.4]
        rows.add(row, other, score)
        most = max(most, rows.n)
    rows.settle()
    assert most <= k * n + max(k * n, 1 << 16) + 20 * n
    best: dict[int, list] = {}
    for r, o, s in sorted(every, key=lambda x: (x[0], -x[2], x[1])):
        best.setdefault(r, []).append((o, s))
    row, other, score = (np.concatenate(c).tolist() for c in zip(*rows.found))
    assert list(zip(row, other, score)) == [(r, o, s) for r, x in best.items() for o, s in x[:k]]


@pytest.mark.parametrize("query", ["q_dedup_counts", "q_quota_counts"])
def test_no_text_is_exchanged(spark, monkeypatch, query):
    """Texts are hashed or classed where they are read, before the join with the vectors; all after it is a table without them."""
    from lexmill import queries

    seen, cut = [], queries.cut
    monkeypatch.setattr(queries, "cut", lambda df, name: (seen.append(df), cut(df, name))[1])
    assert queries.queries()[query](spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 1 and "text" not in seen[0].columns
    joins = [x for x in seen[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 1


def test_deduplicate_by_hashes(spark):
    from lexmill.functions import text as X

    rows = [(i, f"t {i % 40}", x.tolist()) for i, x in enumerate(_flat(60, 8))] + [(None, "lone", [1.0] * 8), (61, None, [0.5] * 8)]
    df = spark.createDataFrame(rows, "pos long, t string, v array<double>")
    plain = dedup.deduplicate(df, "t", "pos", "v", 0.9)
    hashed = dedup.deduplicate(df.withColumn("h", X.content_hash("t")).drop("t"), "h", "pos", "v", 0.9, hashed=True)
    for a, b in zip(plain, hashed):
        same = [c for c in a.columns if c in b.columns]
        assert sorted(map(str, a.select(same).collect())) == sorted(map(str, b.select(same).collect()))
