"""Every operator on nulls, empty and long texts, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from lexmill.llm import ann, bloom_lm, chunk_dedup, decontaminate, mixing, near_dup, pii, quality, token_store, toxicity
from lexmill.llm.common import staging_path
from lexmill.llm.labelled import labelled_sample
from lexmill.llm.queries import tokenizer_path

LONG = "the quick brown fox jumps over lazy dogs and idiot cats; " * 4_000
ROWS = [
    (1, "a b c d e f g h", "en", "s1", 3),
    (2, None, None, None, None),
    (3, "", "en", None, 1),
    (4, "   \t\n ", None, "s2", 2),
    (5, LONG, "en", "s1", 9),
    (5, LONG, "en", "s1", 9),
    (6, "a b c d e f g h", "en", "s1", 3),
    (None, "nameless text of six words here", "en", "s2", 1),
    (7, "é\x00\U0001f600 ß a@b.example +1 (222) 555-1234", "fr", "s2", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, size long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({"score": F.lit("x"), "n": F.lit(1), "rep": F.lit("y"), "hash": F.lit(None).cast("int"), "tie": F.lit(0)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_token_store(spark, docs, empty):
    for table in (docs, empty):
        path = staging_path(spark, "t")
        token_store.write_tokens(table, path, tokenizer_path(), block_ids=1_000)
        got = token_store.read_documents(spark, path).orderBy("start").collect()
        assert len(got) == table.count()
        at = 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
        if table is docs:
            none = next(r for r in got if r["doc_id"] == 2)
            assert none["n_tokens"] == 1 and none["ids_crc32"] == zlib.crc32((2).to_bytes(4, "little"))
            assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 5, 6, 7]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers(spark, docs, empty, module):
    sample = [("good words in a row here", 1), ("@@@@ $$$$ ####", 0)] * 10
    model = module.fit(sample)
    got = module.score(docs, model)
    assert got.count() == len(ROWS)
    rows = got.select("doc_id", "score").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[2] == by[3]
    assert module.score(empty, model).count() == 0
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    fitted = (module.fit_quality if module is quality else module.fit_toxicity)(docs, labels, F.lit(True))
    assert module.score(docs, fitted).count() == len(ROWS)


def test_chunk_dedup(docs, empty):
    spans = chunk_dedup.repeated_spans(docs)
    assert {r["doc_id"] for r in spans.collect()} == {5}
    assert chunk_dedup.repeated_spans(empty).count() == 0
    kept = chunk_dedup.drop_repeats(docs)
    assert kept.count() == len(ROWS) and kept.columns == docs.columns
    clash = docs.withColumns({"cuts": F.lit(7), "begin": F.lit("b"), "_lx0": F.lit(1)})
    rows = chunk_dedup.drop_repeats(clash).collect()
    assert len(rows) == len(ROWS) and all(r["cuts"] == 7 and r["begin"] == "b" and r["_lx0"] == 1 for r in rows)
    assert {r["text"] for r in rows if r["doc_id"] in (None, 2, 3)} == {None, "", "nameless text of six words here"}
    assert chunk_dedup.drop_repeats(empty).collect() == []


def test_bloom_lm(docs, empty):
    model = bloom_lm.fit(docs)
    got = bloom_lm.score(docs, model)
    assert got.count() == len(ROWS)
    assert {r["n_tokens"] for r in got.where("doc_id IN (2, 3, 4)").collect()} == {1}
    none = bloom_lm.fit(empty)
    assert (none.tokens, none.words) == (0, 0)
    assert bloom_lm.score(docs, none).agg(F.sum("n_known")).first()[0] == 0
    assert bloom_lm.score(empty, model).count() == 0


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over lazy dogs and idiot cats"), (2, None), (None, "a b c"), (3, ""), (4, "a b c d e f g h")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(5, 1), (1, 4), (6, 4)}
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 2, 3, 4, 7]
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.clean(docs, items.where("false")).count() == len(ROWS)


def test_pii(spark, docs, empty):
    model = pii.fit(spark)
    got = pii.digest(pii.find(docs, model))
    assert got.count() == len(ROWS)
    r = got.where("doc_id = 7").first()
    assert (r["n_email"], r["n_phone"]) == (1, 1) and r["spans"] == "email:6:17,phone:18:35"
    assert pii.digest(pii.find(empty, model)).count() == 0
    clash = docs.where("doc_id = 5").select("*", *[F.lit("x").alias(c) for c in ("_hits", "_parts", "_ends", "_wide0", "wide", "added", "_lx0", "Base_ip")])
    found = pii.find(clash, model)
    assert found.columns == [c for c in clash.columns if c.lower() not in ("added", "base_ip")] + ["base_email", "base_ip", "base_card", "base_phone", "added"]
    assert [(r["_hits"], r["wide"], r["tie"], r["added"]) for r in found.collect()] == [("x", "x", 0, [])] * 2


def test_labelled_sample_keeps_its_bound(spark):
    docs = spark.range(500).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, 1)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", F.lit(True), 2, 1_000)
    assert len(got) == 2 and all(t in {"text 0", "text 1", "text 101"} for t, _ in got)


def test_clashing_names_are_handed_on(spark):
    names = ["size", "source_size", "target", "rate", "copies", "copy", "mix_source", "_doc", "_gone", "_tie", "score", "_lx0", "n"]
    docs = spark.createDataFrame([(k, f"some words of text number {k % 3} here", f"s{k % 2}", *[f"{c}{k}" for c in names]) for k in range(6)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    rows = {tuple(r) for r in docs.collect()}
    one = near_dup.keep_one(docs)
    assert one.columns == docs.columns and {tuple(r) for r in one.collect()} == {r for r in rows if r[0] < 3}
    mixed = mixing.repeated(docs)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= rows
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.select("doc_id", "text", "source")).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    assert "copy" in mixing.emit(mixing.mix(docs)).columns


def test_mixing(docs, empty):
    mixed = mixing.mix(docs)
    assert mixed.count() == len(ROWS)
    assert mixed.where("source IS NULL").agg(F.sum("size")).first()[0] == 0
    assert mixed.agg(F.max("copies")).first()[0] <= 2
    assert mixing.mix(empty).count() == 0 and mixing.emit(mixing.mix(empty)).count() == 0


def test_near_dup(docs, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect()}
    assert {(1, 4, 1, True), (6, 4, 1, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (None, 2, None, True)} <= got
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert near_dup.near_duplicates(empty).count() == 0


def test_ann(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0, 1.0]), (50, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(table, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 8), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 8)]
    assert ann.nearest(table.where("false"), F.lit(True)).count() == 0
    again = table.unionAll(spark.createDataFrame([(0, [0.0, 1.0]), (1, [2.0, 0.1]), (1, [2.0, 0.0])], "vec_id long, embedding array<float>").withColumn("score", F.lit(1)))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(again, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 8), (0, 2, 50), (0, 3, 1), (0, 4, 2)]  # id 0 asks once, with its smallest vector (0, 1)
