"""Sinks: cleaned rows, logs, splits, indexes, reports. All go through Spark's writers and their commit protocol."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, dedup, split
from .json_array import write_array, write_file


def write_cleaned(classified: DataFrame, kept: str, log: str) -> None:
    """Kept and removed rows, each as one JSON array in order of ``pos``."""
    write_array(clean.to_alpaca(clean.kept(classified)), kept)
    write_array(clean.removed(classified), log)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, value: Mapping, path: str) -> None:
    write_text(spark, json.dumps(value, ensure_ascii=False), path)


def write_deduplicated(rows: DataFrame, log: DataFrame, counts: DataFrame, path: str, log_path: str) -> None:
    """The rows as one JSON array, and a log with the counts and the first removed pairs."""
    write_array(rows, path)
    head = [r.asDict() for r in dedup.log_head(log).collect()]  # 100 rows
    write_json(rows.sparkSession, {**counts.first().asDict(), "removed_pairs": head}, log_path)


def write_sampled(rows: DataFrame, path: str) -> None:
    """The rows as one JSON array."""
    write_array(rows, path)


def write_split(df: DataFrame, path: str) -> None:
    """``train.json``, ``val.json`` and ``test.json`` with full rows, ``sft_train.json`` and ``sft_val.json`` with the three training
    columns, each one JSON array, and ``dataset_info.json``, which names the latter two and is written last."""
    for name in split.SPLITS:
        write_array(df.where(F.col("split") == name), f"{path}/{name}.json")
    for name in ("train", "val"):
        write_array(clean.to_alpaca(df.where(F.col("split") == name)), f"{path}/sft_{name}.json")
    columns = {"prompt": "instruction", "query": "input", "response": "output"}
    write_file(df.sparkSession, json.dumps({f"law_sft_{n}": {"file_name": f"sft_{n}.json", "columns": columns} for n in ("train", "val")}, ensure_ascii=False), f"{path}/dataset_info.json")


def save_index(chunks: DataFrame, path: str, encoder: str, device: str = "cpu") -> None:
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    n = chunks.sparkSession.read.parquet(f"{path}/chunks").count()
    write_json(chunks.sparkSession, {"embedding_model": encoder, "device": device, "num_documents": n}, f"{path}/config")


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    report.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_predictions(samples: DataFrame, answers: DataFrame, path: str) -> None:
    """question, ground_truth, answer, citations, retrieved_docs and category of an experiment as one JSON array, by qid."""
    joined = samples.join(answers.drop(*(c for c in ("question", "ground_truth", "category") if c in answers.columns)), "qid", "left")
    write_array(joined.select("qid", "question", "ground_truth", "answer", "citations", "retrieved_docs", "category"), path, "qid")


def write_eval_set(samples: DataFrame, path: str) -> None:
    """One JSON array in order of qid, which ``read_eval_set`` reads back."""
    write_array(samples, path, "qid", keep_order=False)
