"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir), work on all that the stage before kept, and return the columns of ``documents``; the last
returns the index of the token store it has written. Clashing extra columns in ``docs`` are carried through unless an
operator's docstring names them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, mixing, near_dup, quality, token_store
from lexmill.llm.common import cut, fresh_names, id_bucket, staging_path, table
from lexmill.llm.queries import ACCEPT, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level CNN accepts; it learns from four fifths of the labelled ones among ``docs``."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), id_bucket("doc_id", 5) != 0)
    (name,) = fresh_names(docs, 1)
    return quality.score(docs, model, name).where(F.col(name) >= ACCEPT).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8 or more."""
    return near_dup.keep_one(docs, 80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


def write_token_planes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every emitted document, read back from the store."""
    path = staging_path(spark, "token-store")
    token_store.write_tokens(docs, path, tokenizer_path())
    return token_store.read_documents(spark, path)


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token planes", write_token_planes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "pipeline-stage")
    return docs


#: The stages learn from labels and retrieve by latent similarity, which SQL can't express.
ORACLE_SQL = None
