"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bloom_lm, chunk_dedup, decontaminate, mixing, near_dup, pii, quality, repair, secret_scan, token_store, toxicity, whitening
from .common import id_bucket, staging_path, table

#: The limit from which a score counts as label 1.
ACCEPT = 0.3


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "token-store")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_store.read_documents(spark, path)


def _classified(df: DataFrame, modulus: int, held: int) -> DataFrame:
    return df.select("doc_id", F.coalesce(id_bucket("doc_id", modulus) == held, F.lit(True)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), id_bucket("doc_id", 5) != 0)
    return _classified(quality.score(docs, model), 5, 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), id_bucket("doc_id", 4) != 2)
    return _classified(toxicity.score(docs, model), 4, 2)


def op4_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = chunk_dedup.repeated_spans(table(spark, sf_dir, "documents"), within=False)
    return spans.select("doc_id", F.col("begin").alias("span_begin"), F.col("end").alias("span_end"), "n_chunks", "first_doc")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = bloom_lm.fit(docs.where(id_bucket("doc_id", 7) != 2))
    held = F.coalesce(id_bucket("doc_id", 7) == 2, F.lit(True)).alias("held_out")
    return bloom_lm.score(docs, model).select("doc_id", held, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.fit(spark, docs)))


def op10_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op11_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), 4)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(turns), turns)


def op13_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict:
    return {
        "op1_token_planes": op1_token_planes,
        "op2_quality_cnn": op2_quality_cnn,
        "op3_toxicity": op3_toxicity,
        "op4_permutation_ann": op4_permutation_ann,
        "op5_chunk_dedup": op5_chunk_dedup,
        "op6_bloom_lm": op6_bloom_lm,
        "op7_latent_decontamination": op7_latent_decontamination,
        "op8_pii_boosting": op8_pii_boosting,
        "op9_source_mix": op9_source_mix,
        "op10_minhash_join": op10_minhash_join,
        "op11_tsqr_whitening": op11_tsqr_whitening,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_secret_entropy": op13_secret_entropy,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_source_mix": mixing.oracle(), "op10_minhash_join": near_dup.oracle(), "op12_conversation_repair": repair.oracle()}
