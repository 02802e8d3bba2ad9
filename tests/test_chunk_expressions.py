"""Header sections and length pieces as expressions against the plain functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import chunk

WORDS = ["第一条", "总则", "国家", "。", "；", "，", " ", "\n", "\n\n", "abc", "\U0001f600", "　", "长" * 30, "x" * 45, "```", "~~~", "# 法", "## 章", "\n# 民法\n", "\n## 第一章 \n", "\n### 节\n", "\n#### 款\n", "\n##### 五\n", "\n```\n", "\n~~~ py\n", "\n```a```\n", "#无", "\t"]


def _texts():
    rng = random.Random(3)
    return ["".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["", None, " \n ", "长" * 500, "。" * 200, "a " * 300, "# 法\n\n正文"]


def test_sections(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: [{k: v for k, v in s.asDict().items() if v is not None} for s in r["s"]] for r in df.select("i", chunk.sections_of("t").alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [chunk.sections(t or "") for t in texts]


@pytest.mark.parametrize("size, overlap, separators", [(20, 5, chunk.SEPARATORS), (40, 12, chunk.SEPARATORS), (16, 0, ("。", " ")), (8, 20, ("\n", ""))])
def test_pieces(spark, size, overlap, separators):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: r["p"] for r in df.select("i", chunk.pieces_of("t", size, overlap, separators).alias("p")).collect()}
    assert [got[i] for i in range(len(texts))] == [chunk.pieces(t or "", size, overlap, separators) for t in texts]


def test_no_python_worker(spark):
    plan = chunk.split_documents(spark.createDataFrame([(1, "# 法\n第一条 甲")], "doc_id long, content string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_lost_levels_are_null(spark):
    df = spark.createDataFrame([(1, "# 法\n## 章\n甲\n# 二法\n乙")], "doc_id long, content string")
    rows = chunk.split_documents(df).orderBy("chunk_id").select("law_name", "chapter", "content").collect()
    assert [tuple(r) for r in rows] == [("法", "章", "甲"), ("二法", None, "乙")]
    assert chunk.split_documents(df.where(F.lit(False))).collect() == []
