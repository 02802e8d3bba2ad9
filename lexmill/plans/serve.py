"""Programs B and C: build an index of law texts, answer batches of questions from it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk, retrieve, vectors
from ..sources import files, sinks


def build_index(docs: DataFrame, path: str, encoder: Callable[[list[str]], np.ndarray], name: str, size: int = 512, overlap: int = 50) -> None:
    """Splits ``docs`` and saves chunks with an id and their vectors."""
    pieces = chunk.split_documents(docs, size, overlap).withColumn("id", F.xxhash64("doc_id", "chunk_id"))
    sinks.save_index(vectors.encode(pieces, "content", encoder), path, name)


class Service:
    """What the HTTP service offers, over DataFrames of questions."""

    def __init__(self, spark: SparkSession, path: str, encoder: Callable[[list[str]], np.ndarray], name: str | None = None, generate: Callable[[Column], Column] | None = None, rerank: Callable[[Column, Column], Column] | None = None):
        self.chunks, self.config = files.load_index(spark, path, name)
        self.encoder, self.generate, self.scorer = encoder, generate, rerank

    def retrieve(self, questions: DataFrame, k: int = 5, only: Column | None = None, filter_first: bool = False) -> DataFrame:
        """``questions``: query_id, question."""
        asked = vectors.encode(questions.select("query_id", "question"), "question", self.encoder, "v")
        found = retrieve.top_k(asked, self.chunks, k, vector="embedding", only=only, filter_first=filter_first)
        if self.scorer is None:
            return found
        joined = found.join(questions.select("query_id", "question"), "query_id")
        return retrieve.rerank(joined, self.scorer(F.col("question"), F.col("content")), k).drop("question")

    def answer(self, questions: DataFrame, k: int = 5, min_score: float = 0.3) -> DataFrame:
        return retrieve.answer(questions, self.retrieve(questions, k), self.generate, min_score)

    def health(self) -> dict:
        return {"status": "ok", "index_loaded": True, "model_ready": self.generate is not None, "num_documents": self.config["num_documents"]}

    def laws(self) -> DataFrame:
        return chunk.laws(self.chunks)
