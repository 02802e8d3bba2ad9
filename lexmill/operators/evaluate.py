"""Evaluation metrics as joins and aggregates over (qid, ...) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V


def _match(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Rows (qid, law_name, article) of ``a`` and ``b`` that mean the same article: equal keys, names compared as a residual."""
    b = b.select(F.col("qid").alias("_q"), F.col("article").alias("_a"), F.col("law_name").alias("_l"), *[c for c in b.columns if c not in ("qid", "article", "law_name", *a.columns)])
    on = (F.col("qid") == F.col("_q")) & (F.col("article") == F.col("_a")) & (F.contains("law_name", F.col("_l")) | F.contains(F.col("_l"), F.col("law_name")))
    out = a.join(b, on, how)
    return out.drop("_q", "_a", "_l") if how in ("inner", "left") else out


def matched(a: DataFrame, b: DataFrame) -> DataFrame:
    return _match(a, b, "left_semi")


def unmatched(a: DataFrame, b: DataFrame) -> DataFrame:
    return _match(a, b, "left_anti")


def missed(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return unmatched(truth, predicted)


def hallucinated(predicted: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Citations not flagged as retrieved that match nothing retrieved, of questions for which anything was (name and number given)."""
    there = retrieved.where((F.col("law_name") != "") & (F.col("article") != ""))
    flagged = predicted.where(~F.coalesce(F.col("in_retrieved"), F.lit(False))) if "in_retrieved" in predicted.columns else predicted
    return unmatched(flagged.join(there.select("qid").distinct(), "qid", "left_semi"), there)


def retrieval(queries: DataFrame, truth: DataFrame, results: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """recall_at_k, mrr, num_queries. ``results``: qid, rank, law_name, article. All queries count, annotated or not."""
    best = _match(results, truth).groupBy("qid").agg(F.min("rank").alias("rank"))
    return ranked(queries, best, ks)


def ranked(queries: DataFrame, best: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """The same from the smallest relevant rank of each query (qid, rank)."""
    joined = queries.select("qid").join(best, "qid", "left")
    share = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return joined.agg(
        *[share(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks],
        share(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))).alias("mrr"),
        F.count(F.lit(1)).alias("num_queries"),
    )


def citation_scores(samples: DataFrame) -> DataFrame:
    """``samples`` (truth, predicted: arrays of (law_name, article); predicted may have in_retrieved) with precision, recall and
    hallucination of each. Sets count once, hallucination counts each citation. No truth and no citation: zeros; citations without
    truth: hallucination 1."""
    pair = lambda x: F.struct(x["law_name"].alias("law_name"), x["article"].alias("article"))
    t, p = F.array_distinct(F.transform("truth", pair)), F.array_distinct(F.transform("predicted", pair))
    hits = lambda xs, ys: F.size(F.filter(xs, lambda x: F.exists(ys, lambda y: X.law_match(x["law_name"], x["article"], y["law_name"], y["article"])))).cast("double")
    nt, np_ = F.coalesce(F.size("truth"), F.lit(0)), F.coalesce(F.size("predicted"), F.lit(0))
    shown = F.size(F.filter("predicted", lambda x: F.coalesce(x["in_retrieved"], F.lit(False))))
    return samples.withColumns(
        {
            "precision": F.when((nt > 0) & (np_ > 0), hits(p, t) / F.size(p)).otherwise(0.0),
            "recall": F.when((nt > 0) & (np_ > 0), hits(t, p) / F.size(t)).otherwise(0.0),
            "hallucination": F.when((nt == 0) & (np_ > 0), 1.0).when(np_ > 0, 1.0 - shown / np_).otherwise(0.0),
        }
    )


def citation_metrics(samples: DataFrame) -> DataFrame:
    """precision, recall, f1 (of the averages), hallucination_rate, num_samples."""
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    got = citation_scores(samples).agg(zero("precision").alias("precision"), zero("recall").alias("recall"), zero("hallucination").alias("hallucination_rate"), F.count(F.lit(1)).alias("num_samples"))
    p, r = F.col("precision"), F.col("recall")
    return got.select("precision", "recall", F.when(p + r > 0, F.try_divide(2 * p * r, p + r)).otherwise(0.0).alias("f1"), "hallucination_rate", "num_samples")


def answer_scores(samples: DataFrame, truth: str = "ground_truth", answer: str = "answer") -> DataFrame:
    return samples.withColumn("keyword_hit", X.keyword_score(truth, answer) >= 0.5).withColumn("exact", X.answer_form(truth) == X.answer_form(answer))


def clamp_judgement(text: Column | str) -> Column:
    """A judge's reply as a score from 0 to 1; what is no number is one half."""
    v = X.strip(text).try_cast("double")
    return F.when(v.isNull() | F.isnan(v), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def judge_prompt(question: Column | str, truth: Column | str, answer: Column | str) -> Column:
    a, b, c, d = V.JUDGE_PROMPT
    return F.concat(F.lit(a), X.or_empty(question), F.lit(b), X.or_empty(truth), F.lit(c), X.or_empty(answer), F.lit(d))


def answers(samples: DataFrame, judged: str | None = None) -> DataFrame:
    """exact_match_rate, keyword_match_rate, conclusion_accuracy, llm_judge_score, num_samples. ``judged``: a column of replies."""
    share = lambda c: F.coalesce(F.avg(F.when(F.col(c), 1.0).otherwise(0.0)), F.lit(0.0))
    judge = F.coalesce(F.avg(clamp_judgement(judged)), F.lit(0.0)) if judged else F.lit(0.0)
    return answer_scores(samples).agg(share("exact").alias("exact_match_rate"), share("keyword_hit").alias("keyword_match_rate"), share("keyword_hit").alias("conclusion_accuracy"), judge.alias("llm_judge_score"), F.count(F.lit(1)).alias("num_samples"))


def by_category(samples: DataFrame) -> DataFrame:
    return answer_scores(samples).groupBy("category").agg(F.avg(F.when(F.col("keyword_hit"), 1.0).otherwise(0.0)).alias("accuracy"))


def is_refusal(answer: Column | str) -> Column:
    return X.any_of(answer, V.REFUSALS)


def refusals(samples: DataFrame, answer: str = "answer") -> DataFrame:
    """refusal_accuracy (0 without unanswerable questions), num_unanswerable."""
    asked = samples.where(F.col("category") == V.UNANSWERABLE)
    return asked.agg(F.coalesce(F.avg(F.when(is_refusal(answer), 1.0).otherwise(0.0)), F.lit(0.0)).alias("refusal_accuracy"), F.count(F.lit(1)).alias("num_unanswerable"))
