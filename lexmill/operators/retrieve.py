"""Retrieval: top-k with a filter, reranking, the evidence gate, and answers over batches of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from . import vectors

RESULT = ("rank", "score", "law_name", "article", "chapter", "content")


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, *, query_id: str = "query_id", query_vector: str = "v", id_col: str = "id", vector: str = "v", only: Column | None = None, filter_first: bool = False) -> DataFrame:
    """query_id, id, score, rank and the corpus' other columns: the ``k`` best rows of each query that pass ``only``.

    3 * k rows are fetched and then filtered and ranked anew, so a filter may leave fewer than ``k``; ``filter_first`` filters the
    corpus instead, which never does. ``only`` is over the corpus' columns. Columns of the corpus that are named like the result's
    own (query_id, id, score, rank) are left out.
    """
    rows = corpus.where(only) if only is not None and filter_first else corpus
    found = vectors.search(queries, rows, 3 * k, query_id=query_id, query_vector=query_vector, id_col=id_col, vector=vector)
    others = [c for c in corpus.columns if c not in (id_col, vector) and c.lower() not in ("query_id", "id", "score", "rank")]
    passes = F.lit(True) if only is None or filter_first else F.coalesce(only, F.lit(False))
    rest = corpus.select(F.col(id_col).cast("long").alias("_lx_id"), passes.alias("_lx_passes"), *[F.col(f"`{c}`") for c in others])
    joined = found.drop("rank").join(rest, F.col("id") == F.col("_lx_id")).where("_lx_passes").drop("_lx_id", "_lx_passes")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return joined.withColumn("rank", rank).where(F.col("rank") <= k)


def rerank(results: DataFrame, score: Column | None, k: int | None = None) -> DataFrame:
    """Scores replaced and ranks given anew, the best first, equal ones in their old order; without a score as they are."""
    if score is not None:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_old")
        results = results.withColumnRenamed("rank", "_old").withColumn("score", score.cast("double")).withColumn("rank", F.row_number().over(order)).drop("_old")
    return results.where(F.col("rank") <= k) if k else results


def shown(get: Callable[[str], Column]) -> list[Column]:
    """A result as users see it: the score with four decimals, empty texts for missing ones; ``get`` gives a field's column."""
    return [get("rank").alias("rank"), F.round(get("score"), 4).alias("score"), *[X.or_empty(get(c)).alias(c) for c in RESULT[2:]]]


def project(results: DataFrame) -> DataFrame:
    return results.select("query_id", *shown(F.col))


def gathered(results: DataFrame) -> DataFrame:
    """query_id and ``results``, its results in order of rank (k at most a query)."""
    return results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*RESULT))).alias("results"))


def has_evidence(results: Column | str, min_score: float = 0.3) -> Column:
    """Whether there are results and the first scores at least ``min_score``."""
    r = X.col(results)
    return F.coalesce(F.size(r), F.lit(0)).__gt__(0) & F.coalesce(F.get(r, F.lit(0))["score"] >= min_score, F.lit(False))


def cited(answer: Column | str, results: Column | str, article_prefix: str = "fixed") -> Column:
    """The answer's citations, each with whether it was retrieved and the chapter and first 200 letters of the first result it means."""
    r = X.col(results)

    def look(c: Column) -> Column:
        hit = F.get(F.filter(r, lambda x: X.law_match(X.or_empty(x["law_name"]), X.or_empty(x["article"]), c["law_name"], c["article"])), F.lit(0))
        return F.struct(c["law_name"].alias("law_name"), c["article"].alias("article"), hit.isNotNull().alias("in_retrieved"), F.when(hit.isNotNull(), X.or_empty(hit["chapter"])).alias("chapter"), F.substring(hit["content"], 1, 200).alias("content"))

    return F.transform(X.citations(answer, article_prefix=article_prefix), look)


def answer(questions: DataFrame, results: DataFrame, generate: Callable[[Column], Column] | None = None, min_score: float = 0.3, article_prefix: str = "fixed") -> DataFrame:
    """question, answer, citations, retrieved_docs, has_evidence for a batch of questions (query_id, question).

    ``generate`` makes a column of answers from one of messages; without it the answer lists what was found. A question without
    evidence gets the refusal and no documents.
    """
    joined = questions.join(gathered(results), "query_id", "left")
    joined = joined.withColumn("results", F.coalesce("results", F.array().cast(joined.schema["results"].dataType)))
    joined = joined.withColumn("has_evidence", has_evidence("results", min_score))
    messages = X.prompt("question", X.context("results"))
    text = X.listing("question", "results") if generate is None else generate(messages)
    joined = joined.withColumn("answer", F.when(F.col("has_evidence"), text).otherwise(V.REFUSAL_ANSWER))
    none = F.slice(cited("answer", "results", article_prefix), 1, 0)
    rounded = F.transform("results", lambda x: F.struct(*shown(lambda c: x[c])))
    return joined.select(
        "query_id",
        "question",
        "answer",
        F.when(F.col("has_evidence"), cited("answer", "results", article_prefix)).otherwise(none).alias("citations"),
        F.when(F.col("has_evidence"), rounded).otherwise(F.slice(rounded, 1, 0)).alias("retrieved_docs"),
        "has_evidence",
    )


def validate_request(request: dict, ready: bool = True) -> tuple[int, dict]:
    """(status, request with defaults or error) of a question: 400 without a question, 503 without an index."""
    if not isinstance(request, dict) or "question" not in request:
        return 400, {"error": "question is missing"}
    if not ready:
        return 503, {"error": "the index is not loaded"}
    defaults = {"use_rag": True, "top_k": 5, "temperature": 0.3, "max_tokens": 2048}
    return 200, {"question": request["question"], **{k: request.get(k, v) for k, v in defaults.items()}}
