"""Core operators: cleaning, text functions, dedup, splits, chunks, retrieval, metrics, reports, sinks."""

from __future__ import annotations

import json
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions import vocabulary as V
from lexmill.operators import chunk, clean, components, dedup, evaluate, report, retrieve, sample, split, vectors
from lexmill.plans import assess, prepare, serve
from lexmill.sources import files, sinks

OUT = "这是一个足够长的回答，用于通过长度检查的内容部分。"


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


@pytest.mark.parametrize(
    ("instruction", "output", "reason"),
    [
        ("什么是犯罪行为", OUT, None),
        ("短", OUT, "too_short"),
        ("什么是犯罪行为", "短", "too_short"),
        ("什么是犯罪行为", OUT + "第 0 条", "invalid_article_ref"),
        ("什么是犯罪行为", OUT + "第abc条", "invalid_article_ref"),
        ("什么是犯罪行为", "根据相关法律规定，" + OUT, "template_reply"),
        ("什么是犯罪行为", "根据相关法律规定，见《刑法》第十四条" + OUT, "template_reply"),
        ("什么是犯罪行为", "根据相关法律规定，见《刑法》第１４条" + OUT, None),
        ("什么是犯罪行为", OUT + "[链接]", "format_error"),
        ("推荐一部电影给我", OUT, "entertainment"),
        ("法国的首都在哪里", OUT, "fact_memorization"),
        ("法国的首都和刑法", OUT, None),
        ("什么是犯罪行为", OUT + "GDP", None),
        ("什么是犯罪行为", OUT + "也许", "low_quality"),
        ("什么是犯罪行为", OUT + "建议您", "template_reply"),
        ("什么是犯罪行为", "长" * 2001, "length_abnormal"),
        (OUT, " " + OUT + "　", "duplicate_content"),
    ],
)
def test_cascade(spark, instruction, output, reason):
    assert clean.classify(one(spark, instruction=instruction, output=output)).first()["reason"] == reason


def test_aliases(spark):
    df = one(spark, instruction="", query="问题在这里呢", output="", answer=OUT, input=" x ")
    assert tuple(clean.normalise(df).select("instruction", "output", "input", "category").first()) == ("问题在这里呢", OUT, "x", "unknown")
    lacking = df.withColumn("has_fields", F.lit(False))
    assert clean.classify(lacking).first()["reason"] == "missing_field"
    assert clean.classify(lacking, strict=False).first()["reason"] is None


def test_json_array_scan_and_sinks(spark, tmp_path):
    rows = [{"instruction": "什么是故意犯罪？", "output": OUT, "input": {"a": 1}}, {"instruction": "短", "output": "短"}, {"output": OUT}, {"instruction": None, "question": "什么是故意犯罪？", "output": OUT}]
    (tmp_path / "in.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    got = clean.classify(files.read_json_array(spark, str(tmp_path / "in.json")))
    assert [r["reason"] for r in got.orderBy("pos").collect()] == [None, "too_short", "missing_field", None]
    assert got.orderBy("pos").first()["input"] == ""
    assert tuple(clean.clean_stats(got).first())[:3] == (4, 2, 2)
    sinks.write_cleaned(got, str(tmp_path / "kept"), str(tmp_path / "log"))
    assert len(json.loads((tmp_path / "kept").read_text(encoding="utf-8"))) == 2
    assert {r["reason"] for r in json.loads((tmp_path / "log").read_text(encoding="utf-8"))} == {"too_short", "missing_field"}


def test_json_arrays_of_several_files_and_round_trips(spark, tmp_path):
    for f in range(3):
        rows = [{"instruction": f"{f}{k}", "output": OUT, "input": {"a": 1} if k else "x"} for k in range(2)]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{f}.json").write_text(json.dumps(rows, ensure_ascii=False) if f else "\n".join(json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    got = files.read_json_array(spark, str(tmp_path / "in")).orderBy("pos").collect()
    assert [(r["pos"], r["instruction"], r["input_is_text"]) for r in got] == [(2 * f + k, f"{f}{k}", k == 0) for f in range(3) for k in range(2)]
    pairs = spark.createDataFrame([(i, f"什么是犯罪行为{i}", OUT + str(i)) for i in range(9)], "pos long, instruction string, output string")
    sinks.write_cleaned(clean.classify(pairs.repartition(3)), str(tmp_path / "kept"), str(tmp_path / "log"))
    back = files.read_json_array(spark, str(tmp_path / "kept"))
    assert {(r["instruction"], r["output"]) for r in back.collect()} == {(r["instruction"], r["output"]) for r in pairs.collect()}
    sinks.write_eval_set(files.built_in_eval(spark).repartition(3), str(tmp_path / "eval"))
    fields = ["qid", "question", "ground_truth", "category", "relevant_laws", "expected_answer_type"]
    assert files.read_eval_set(spark, str(tmp_path / "eval")).select(fields).orderBy("qid").collect() == files.built_in_eval(spark).select(fields).orderBy("qid").collect()
    assert {r[0] for r in files.built_in_eval(spark).select("expected_answer_type").collect()} == {"with_citation", "refuse"}


def test_split_and_mix_keep_null_keys(spark):
    rows = spark.createDataFrame([(i if i > 1 else None, "ab"[i % 2]) for i in range(10)], "k long, source string")
    done = split.split(rows, "k")
    assert done.count() == 10 and done.where("k IS NULL").count() == 2
    assert split.mix(rows, "k", {"a": 0.5, "b": 0.5}).count() == 10


def test_projection_of_results(spark):
    rows = spark.createDataFrame([(1, 1, 0.123456, None, "第一条", None, "x")], "query_id long, rank int, score double, law_name string, article string, chapter string, content string")
    assert tuple(retrieve.project(rows).first()) == (1, 1, 0.1235, "", "第一条", "", "x")


def test_experiment_without_retrieval(spark):
    s = files.built_in_eval(spark)
    r, answers = assess.run("base", s)
    assert {a["answer"] for a in answers.collect()} == {V.NO_MODEL} and r["errors"] == [] and "retrieval" not in r
    assert r["config"] == {"use_rag": False, "is_sft": False, "model_name": "", "top_k": 5, "num_samples": 10}
    fails = lambda m: F.struct(F.concat(F.lit("答"), m[1]["content"]).alias("answer"), F.when(m[1]["content"].contains("GDP"), "kaputt").alias("error"))
    r, answers = assess.run("base", s, generate=fails)
    assert [(e["question"][-3:], e["error"]) for e in r["errors"]] == [("多少？", "kaputt")]
    assert answers.where("answer = '(错误: kaputt)'").count() == 1 and "--- 错误案例 (1 条) ---" in report.evaluation_summary(r)


PY_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace()]


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet=st.sampled_from([*PY_SPACE, "a", "法", "​"]), max_size=12))
def test_strip_is_pythons(spark, s):
    r = one(spark, s=s).select(X.strip("s"), X.squeeze_out("s")).first()
    assert r[0] == s.strip() and r[1] == re.sub(r"\s+", "", s)


def test_text_functions(spark):
    r = one(spark, t="合法、正当 ，必要。", a="《刑法》第十四条和《刑法》第十四条，《民法》第2条")
    got = r.select(X.answer_form("t"), X.keywords("t"), X.citations("a"), X.citations("a", "条章节", "compat", False)).first()
    assert got[0] == "合法正当必要"
    assert got[1] == ["合法", "正当", "必要", "合法正当必要"]
    assert [tuple(x) for x in got[2]] == [("刑法", "第十四条"), ("民法", "第2条")]
    assert [tuple(x) for x in got[3]] == [("刑法", "十四条"), ("刑法", "十四条"), ("民法", "2条")]


def test_exact_dedup_is_idempotent(spark):
    df = spark.createDataFrame([(3, "a b"), (1, "ab"), (2, "c"), (4, "a　b")], "pos long, t string")
    once = dedup.exact(df, "t")
    assert sorted(r["pos"] for r in once.collect()) == [1, 2]
    assert sorted(r["pos"] for r in dedup.exact(once, "t").collect()) == [1, 2]
    assert sorted(r["pos"] for r in dedup.exact_removed(df, "t").collect()) == [3, 4]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_components(spark, parts):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(i, i + 1) for i in range(100, 140)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()}
    assert got == {n: find(n) for n in root}


def test_search_kernel_equals_expression(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 60").select("vec_id", vectors.normalised("embedding").alias("v"))
    plain = e.alias("a").join(e.alias("b"), F.col("a.vec_id") != F.col("b.vec_id")).select(F.col("a.vec_id").alias("q"), F.col("b.vec_id").alias("i"), F.round(vectors.dot(F.col("a.v"), F.col("b.v")), 9).alias("s"))
    best: dict[int, list] = {}
    for r in plain.collect():
        best.setdefault(r["q"], []).append((-r["s"], r["i"]))
    got = vectors.self_neighbours(e.withColumnRenamed("v", "embedding"), "vec_id", "embedding", 3).collect()
    assert len(got) == 180
    assert all(sorted(best[r["query_id"]])[r["rank"] - 1][1] == r["id"] for r in got)


def test_semantic_dedup_counts(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows, log = dedup.semantic(e, "vec_id", "embedding", 0.40)
    assert (rows.count(), log.count()) == (443, 57)


def test_k_center():
    x = np.array([[1, 0], [0.99, 0.1], [0, 1], [-1, 0]], float)
    first = int(np.random.RandomState(42).randint(4))
    got = sample.k_center(x, 3)
    assert len(got) == 3 and first in got and got == sorted(got)
    assert sample.k_center(x, 9) == sorted(sample.k_center(x, 4))
    with pytest.raises(ValueError):
        sample.k_center(np.zeros((0, 2)), 1)


def test_sample_quotas(spark):
    rng = np.random.default_rng(2)
    rows = [(i, t, rng.normal(size=4).tolist()) for i, t in enumerate(["因为下雨"] * 10 + ["首先"] * 2 + ["其他"] * 9)]
    df = spark.createDataFrame(rows, "pos long, t string, v array<double>")
    got = sample.sample(df, "t", "v", "pos", {"逻辑推理": 4, "结构化表达": 5, "歧义消解": 1}).collect()
    counts: dict[str, int] = {}
    for r in got:
        counts[r["ability"]] = counts.get(r["ability"], 0) + 1
    assert counts == {"逻辑推理": 4, "结构化表达": 2, "unclassified": 4}
    assert [r["pos"] for r in got] == sorted(r["pos"] for r in got)
    assert sample.k_center_by_group(df.withColumn("g", F.lit("a")), "g", "v", "pos", {"a": 3}).count() == 3


@pytest.mark.parametrize("n", [0, 1, 9, 10, 101])
def test_split_counts(spark, n):
    got = split.split(spark.range(n), "id")
    r = split.split_counts(got).first()
    a, b = int(n * 0.8), int(n * 0.1)
    assert tuple(r) == (n, a, b, n - a - b)
    assert got.select("id").distinct().count() == n


def test_split_checks_ratios(spark):
    with pytest.raises(ValueError):
        split.split(spark.range(3), "id", 0.5, 0.1, 0.1)


def test_mix_limits_legal_alone(spark):
    legal = spark.range(50).withColumn("x", F.lit(1))
    got = split.mix_and_split([("legal", legal)], "id", {"legal": 0.8})
    assert got.count() == 40 and {r["category"] for r in got.collect()} == {"legal"}


LAW = "# 中华人民共和国测试法\n\n2020年1月1日 通过\n\n## 第一章 总则\n\n第一条 这是第一条的内容，用于测试切分功能是否正常工作。\n\n第二条 这是第二条的内容，参照本法第一条执行。\n\n## 第二章 具体规定\n\n第三条 这是第三条的内容，属于第二章的范畴。\n"


def test_split_documents(spark):
    got = chunk.split_documents(one(spark, doc_id=7, content=LAW)).orderBy("chunk_id").collect()
    assert [r["article"] for r in got] == ["", "第一条", "第一条", "第二条", "第二条", "第一条", "第三条", "第三条"]  # a number within a text cuts, too
    assert {r["law_name"] for r in got} == {"中华人民共和国测试法"} and {r["effective_date"] for r in got} == {"2020年1月1日"}
    assert [r["chapter"] for r in got] == [None, *["第一章 总则"] * 5, *["第二章 具体规定"] * 2]
    whole = lambda t: re.sub(r"\s", "", re.sub("(?m)^#.*$", "", t))
    assert "".join(whole(r["content"]) for r in got) == whole(LAW)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab。；， \n", max_size=300), st.integers(5, 40))
def test_pieces(text, size):
    got = chunk.pieces(text, size, 0)
    assert all(0 < len(p) <= size for p in got)
    assert re.sub(r"\s", "", "".join(got)) == re.sub(r"\s", "", text)


def test_long_article_is_cut(spark):
    got = chunk.split_documents(one(spark, doc_id=1, content="第一条 " + "这是一段很长的法律条文内容。" * 100)).collect()
    assert len(got) > 1 and all(len(r["content"]) <= 512 for r in got) and {r["article"] for r in got} == {"第一条"}


def test_sections_fences_and_levels():
    got = chunk.sections("# A\n## B\n```\n# not a header\n```\n### C\nx\n## D\ny\n# E\n")
    assert [(s["content"], s.get("chapter"), s.get("section")) for s in got] == [("```  \n# not a header  \n```", "B", None), ("x", "B", "C"), ("y", "D", None)]


def test_filter_after_fetch_may_leave_fewer(spark):
    corpus = spark.createDataFrame([(i, [1.0, i / 100], "甲" if i == 90 else "乙") for i in range(100)], "id long, v array<double>, law_name string")
    q = one(spark, query_id=1).withColumn("v", F.array(F.lit(1.0), F.lit(0.0)))
    assert retrieve.top_k(q, corpus, 5, only=F.col("law_name") == "甲").count() == 0
    assert retrieve.top_k(q, corpus, 5, only=F.col("law_name") == "甲", filter_first=True).count() == 1
    assert [r["id"] for r in retrieve.top_k(q, corpus, 3).orderBy("rank").collect()] == [0, 1, 2]


def _hits(spark, score):
    return spark.createDataFrame([(1, 1, score, "刑法", "第一条", "第一章", "内容"), (1, 2, 0.2, None, "", "", "其他")], "query_id long, rank int, score double, law_name string, article string, chapter string, content string")


def test_answer_and_refusal(spark):
    q = spark.createDataFrame([(1, "问？"), (2, "无？")], "query_id long, question string")
    a, b = retrieve.answer(q, _hits(spark, 0.9)).orderBy("query_id").collect()
    assert a["has_evidence"] and a["answer"].startswith("关于您的问题「问？」，检索到以下相关法律条文：\n\n【《刑法》 第一章 第一条】\n内容\n")
    assert [(c["law_name"], c["article"], c["in_retrieved"]) for c in a["citations"]] == []
    assert not b["has_evidence"] and b["answer"] == V.REFUSAL_ANSWER and b["retrieved_docs"] == [] and b["citations"] == []
    assert not retrieve.answer(q, _hits(spark, 0.29)).orderBy("query_id").first()["has_evidence"]
    said = retrieve.answer(q, _hits(spark, 0.9), generate=lambda m: F.lit("见《中华人民共和国刑法》第一条和《民法》第二条")).orderBy("query_id").first()
    assert [(c["article"], c["in_retrieved"], c["chapter"], c["content"]) for c in said["citations"]] == [("第一条", True, "第一章", "内容"), ("第二条", False, None, None)]
    compat = retrieve.answer(q, _hits(spark, 0.9), generate=lambda m: F.lit("见《刑法》第一条"), article_prefix="compat").orderBy("query_id").first()
    assert [c["in_retrieved"] for c in compat["citations"]] == [False]


def test_context(spark):
    r = retrieve.gathered(_hits(spark, 0.9)).select(X.context("results")).first()[0]
    assert r == "[1] 刑法 第一章 第一条\n内容\n\n---\n\n[2] 未知法律\n其他"


def test_requests():
    assert retrieve.validate_request({})[0] == 400 and retrieve.validate_request({"question": "x"}, ready=False)[0] == 503
    assert retrieve.validate_request({"question": "x"})[1] == {"question": "x", "use_rag": True, "top_k": 5, "temperature": 0.3, "max_tokens": 2048}


def test_best_retrieval_of_the_built_in_set_is_four_fifths(spark):
    s = files.built_in_eval(spark)
    truth = s.select("qid", F.explode("relevant_laws").alias("t")).select("qid", "t.law_name", "t.article")
    found = truth.where("article LIKE '%条'").withColumn("rank", F.lit(1))
    r = evaluate.retrieval(s, truth, found).first()
    assert (r["recall_at_1"], r["mrr"], r["num_queries"]) == (0.8, 0.8, 10)


def test_citation_metrics(spark):
    c = lambda *xs: [(a, b, i) for a, b, i in xs]
    rows = [([("刑法", "第一条")], c(("中国刑法", "第一条", True), ("民法", "第一条", False))), ([], c(("刑法", "第二条", False))), ([], []), ([("民法", "第三条")], [])]
    df = spark.createDataFrame(rows, "truth array<struct<law_name:string,article:string>>, predicted array<struct<law_name:string,article:string,in_retrieved:boolean>>")
    r = evaluate.citation_metrics(df).first()
    assert (r["precision"], r["recall"], r["hallucination_rate"], r["num_samples"]) == (0.125, 0.25, 0.375, 4)
    assert abs(r["f1"] - 2 * 0.125 * 0.25 / 0.375) < 1e-12


def test_hallucination_needs_retrieved_documents(spark):
    said = spark.createDataFrame([(1, "刑法", "第一条", False), (2, "刑法", "第一条", False), (3, "刑法", "第一条", True)], "qid long, law_name string, article string, in_retrieved boolean")
    there = spark.createDataFrame([(1, "民法", "第一条"), (3, "民法", "第一条")], "qid long, law_name string, article string")
    assert [r["qid"] for r in evaluate.hallucinated(said, there).collect()] == [1]


def test_judge_and_refusal(spark):
    got = [one(spark, t=t).select(evaluate.clamp_judgement("t")).first()[0] for t in (" 0.7 ", "2", "-1", "很好", "NaN")]
    assert got == [0.7, 1.0, 0.0, 0.5, 0.5]
    df = spark.createDataFrame([("unanswerable", "无法回答"), ("unanswerable", "好"), ("x", "无法")], "category string, answer string")
    assert tuple(evaluate.refusals(df).first()) == (0.5, 2)
    assert tuple(evaluate.refusals(df.where("category = 'x'")).first()) == (0.0, 0)


def test_reports(spark):
    text = report.processing_summary({"original_count": 5, "category_distribution": {"b": 1, "a": 2}, "clean_reason_distribution": {"x": 1, "y": 3}})
    assert text.index("  a: 2") < text.index("  b: 1") and text.index("  y: 3") < text.index("  x: 1")
    rows = report.comparison(one(spark, experiment="e", recall_at_1=0.5)).collect()
    assert tuple(rows[0]) == ("e", "0.500", *["-"] * 7)
    assert report.comparison_table(rows).count("\n") == 2
    full = {"experiment_name": "e", "retrieval": {"recall_at_1": 0.5}, "answer": {"exact_match_rate": 1.0, "category_breakdown": {"c": 0.25}}, "refusal": {"refusal_accuracy": 0.5, "num_unanswerable": 2}, "errors": [1]}
    want = """===== 评测报告 =====
实验名称: e
样本数量: 0

--- 检索效果 ---
  Recall@1:  0.5000
  Recall@3:  0.0000
  Recall@5:  0.0000
  MRR:       0.0000

--- 答案正确性 ---
  精确匹配率:         1.0000
  关键词匹配率:       0.0000
  结论判定正确率:     0.0000
  LLM Judge 分数:    0.0000

  按类别:
    c: 0.2500

--- 拒答能力 ---
  拒答准确率:         0.5000
  不可回答问题数:     2

--- 错误案例 (1 条) ---
注：本评测结果仅供参考，不构成法律意见。"""
    assert report.evaluation_summary(full) == want


def _encoder(texts):
    return vectors.HashedTrigrams(10)(texts)


def test_index_and_service(spark, tmp_path):
    (tmp_path / "laws" / "sub").mkdir(parents=True)
    (tmp_path / "laws" / "a.md").write_text(LAW, encoding="utf-8")
    (tmp_path / "laws" / "sub" / "b.md").write_text("# 另一部法\n\n第一条 关于航空器的登记。\n", encoding="utf-8")
    (tmp_path / "laws" / "c.txt").write_text("x", encoding="utf-8")
    docs = files.read_laws(spark, str(tmp_path / "laws"))
    assert {r["law_name"] for r in docs.collect()} == {"中华人民共和国测试法", "另一部法"}
    serve.build_index(docs, str(tmp_path / "index"), vectors.HashedTrigrams(10), "trigrams")
    service = serve.Service(spark, str(tmp_path / "index"), vectors.HashedTrigrams(10), "trigrams")
    with pytest.raises(ValueError):
        serve.Service(spark, str(tmp_path / "index"), vectors.HashedTrigrams(10), "another")
    q = spark.createDataFrame([(1, "关于航空器的登记")], "query_id long, question string")
    assert service.retrieve(q, 1).first()["law_name"] == "另一部法"
    assert service.answer(q).first()["has_evidence"] and service.health()["num_documents"] == 9
    assert [r["law_name"] for r in service.laws().collect()] == ["中华人民共和国测试法", "另一部法"]


def test_prepare(spark):
    legal = spark.createDataFrame([(i, f"问题编号{i}是什么意思", f"{OUT}{'甲乙丙丁'[i % 4]}{i // 8}") for i in range(24)], "pos long, instruction string, output string")
    general = spark.createDataFrame([(i, f"因为什么{i}", f"{OUT}{i}") for i in range(30)], "pos long, instruction string, output string")
    rows, r = prepare.prepare(legal, general, threshold=0.9999, quotas={"逻辑推理": 5}, seed=1)
    assert r["original_count"] == 54 and r["final_count"] == rows.count() == r["train_count"] + r["val_count"] + r["test_count"]
    alone, r2 = prepare.prepare(legal, skip_dedup=True)
    assert r2["final_count"] == int(24 * 0.8) == alone.count()


def test_assess(spark):
    s = files.built_in_eval(spark)
    results = s.where("size(relevant_laws) > 0").select(F.col("qid").alias("query_id"), F.lit(1).alias("rank"), F.lit(0.9).alias("score"), F.col("relevant_laws")[0]["law_name"].alias("law_name"), F.col("relevant_laws")[0]["article"].alias("article"), F.lit("").alias("chapter"), F.col("ground_truth").alias("content"))
    answers = retrieve.answer(s.select(F.col("qid").alias("query_id"), "question"), results).withColumnRenamed("query_id", "qid")
    r = assess.assess("rag", s, answers)
    assert r["retrieval"]["recall_at_1"] == 0.9 and r["refusal"] == {"refusal_accuracy": 1.0, "num_unanswerable": 1}
    assert "retrieval" not in assess.assess("base", s, answers)
    assert "评测报告" in report.evaluation_summary(r)


def test_sinks(spark, tmp_path):
    rows = spark.range(20).select("id", F.lit("i").alias("instruction"), F.lit("").alias("input"), F.lit("o").alias("output"))
    done = split.mix_and_split([("legal", rows)], "id")
    sinks.write_split(done, str(tmp_path / "s"))
    read = lambda name: json.loads((tmp_path / "s" / f"{name}.json").read_text(encoding="utf-8"))
    assert [len(read(n)) for n in ("train", "val", "test")] == [16, 2, 2]
    assert sorted(read("sft_train")[0]) == ["input", "instruction", "output"]
    info = read("dataset_info")
    assert {k: (v["file_name"], len(read(v["file_name"].removesuffix(".json")))) for k, v in info.items()} == {"law_sft_train": ("sft_train.json", 16), "law_sft_val": ("sft_val.json", 2)}
    assert not [p.name for p in (tmp_path / "s").iterdir() if "writing" in p.name]
    sinks.write_report(split.split_counts(done), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0]) == {"total": 20, "train": 16, "val": 2, "test": 2}
