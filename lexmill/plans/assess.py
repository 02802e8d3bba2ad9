"""Program D: an experiment over an evaluation set, and its metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vocabulary as V
from ..operators import evaluate
from ..storage import cut
from .serve import Service


def assess(name: str, samples: DataFrame, answers: DataFrame, judged: str | None = None) -> dict:
    """The report of an experiment. ``samples``: qid, category, ground_truth, relevant_laws; ``answers``: qid, answer, citations,
    retrieved_docs (as ``retrieve.answer`` gives them) and the judge's replies, if any. Retrieval and citations are measured where the
    experiment's name has 'rag'; a question without an answer counts as one without results."""
    joined = samples.join(answers.drop("question", "category", "ground_truth"), "qid", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    out = {"experiment_name": name, "num_samples": samples.count(), "answer": evaluate.answers(joined, judged).first().asDict(), "refusal": evaluate.refusals(joined).first().asDict()}
    out["answer"]["category_breakdown"] = {r["category"]: r["accuracy"] for r in evaluate.by_category(joined).collect()}  # a row a category
    if "rag" in name:
        truth = samples.select("qid", F.explode("relevant_laws").alias("t")).select("qid", "t.law_name", "t.article")
        results = answers.select("qid", F.explode("retrieved_docs").alias("r")).select("qid", "r.rank", "r.law_name", "r.article")
        out["retrieval"] = evaluate.retrieval(samples, truth, results).first().asDict()
        out["citation"] = evaluate.citation_metrics(joined.select(F.col("relevant_laws").alias("truth"), F.col("citations").alias("predicted"))).first().asDict()
    return out


def _replied(df: DataFrame, name: str) -> DataFrame:
    """``answer`` and ``error`` from a column of texts, or of structs (answer, error) where a model may fail on a sample."""
    if isinstance(df.schema[name].dataType, StructType):
        df = df.select("*", F.col(name)["error"].alias("error"), F.col(name)["answer"].alias("answer"))
    else:
        df = df.select("*", F.lit(None).cast("string").alias("error"), F.col(name).alias("answer"))
    return df.withColumn("answer", F.when(F.col("error").isNotNull(), F.concat(F.lit(V.FAILED.split("{}")[0]), "error", F.lit(V.FAILED.split("{}")[1]))).otherwise(F.col("answer"))).drop(name)


def run(name: str, samples: DataFrame, service: Service | None = None, generate: Callable[[Column], Column] | None = None, k: int = 5, judged: str | None = None, model_name: str = "") -> tuple[dict, DataFrame]:
    """(report, answers by qid) of an experiment: every sample is answered, then all are assessed.

    With a ``service`` answers come from retrieval; without, from ``generate`` (a column of messages to one of texts or of structs
    (answer, error)) under a prompt of its own; without either, each answer says that no model is there. A sample that fails gets
    a placeholder and a row in the report's ``errors``. The report's ``config`` says how it was run; an experiment whose name has
    'sft' ran a tuned model.
    """
    if service is not None:
        answers = service.answer(samples.select(F.col("qid").alias("query_id"), "question"), k).withColumnRenamed("query_id", "qid").withColumn("error", F.lit(None).cast("string"))
    else:
        message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
        messages = F.array(message("system", F.lit(V.PLAIN_PROMPT)), message("user", F.col("question")))
        reply = F.lit(V.NO_MODEL) if generate is None else generate(messages)
        none = "array<struct<law_name:string,article:string,in_retrieved:boolean,chapter:string,content:string>>", "array<struct<rank:int,score:double,law_name:string,article:string,chapter:string,content:string>>"
        answers = _replied(samples.select("qid", "question", reply.alias("_reply")), "_reply").withColumns({"citations": F.array().cast(none[0]), "retrieved_docs": F.array().cast(none[1])})
    answers = cut(answers, "answers")
    report = assess(name, samples, answers.drop("error"), judged)
    report["config"] = {"use_rag": "rag" in name, "is_sft": "sft" in name, "model_name": model_name, "top_k": k, "num_samples": report["num_samples"]}
    report["errors"] = [r.asDict() for r in answers.where(F.col("error").isNotNull()).orderBy("qid").select("question", "error").collect()]  # of an evaluation set
    return report, answers
