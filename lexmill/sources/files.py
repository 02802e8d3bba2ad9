"""Scans: JSON arrays, evaluation sets, law texts, saved indexes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk
from . import json_array

FIELDS = ("instruction", "input", "output", "query", "question", "response", "answer", "category", "source", "metadata")


def read_json_array(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """pos, raw and the known fields of the records of JSON arrays (or lines), with ``has_fields`` and ``input_is_text``.

    Files go by their paths and pos counts through all of them. One array is read by as many tasks as it has splits.
    """
    parsed = json_array.records(spark, path, split_bytes)
    rows = parsed.select("pos", F.from_json("value", "map<string,string>").alias("m"), F.try_parse_json("value").alias("v"))
    kind = F.expr("schema_of_variant(variant_get(v, '$.input', 'variant'))")
    return rows.select(
        "pos",
        F.to_json("m").alias("raw"),
        *[F.col("m")[f].alias(f) for f in FIELDS],
        (F.map_contains_key("m", "instruction") & F.map_contains_key("m", "output")).alias("has_fields"),
        F.coalesce(kind.isin("STRING", "VOID"), F.lit(True)).alias("input_is_text"),
    )


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


_EVAL = "struct<question:string,ground_truth:string,category:string,relevant_laws:array<struct<law_name:string,article:string>>,expected_answer_type:string,metadata:map<string,string>>"
EVAL_SCHEMA = f"array<{_EVAL}>"


def _eval_defaults(df: DataFrame) -> DataFrame:
    return df.select(
        "qid",
        F.coalesce("s.question", F.lit("")).alias("question"),
        F.coalesce("s.ground_truth", F.lit("")).alias("ground_truth"),
        F.coalesce("s.category", F.lit("legal_consultation")).alias("category"),
        F.coalesce("s.relevant_laws", F.array().cast("array<struct<law_name:string,article:string>>")).alias("relevant_laws"),
        F.coalesce("s.expected_answer_type", F.lit("with_citation")).alias("expected_answer_type"),
        F.coalesce("s.metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """qid (place in the files) and the fields of an evaluation set, a JSON array or JSON lines, with defaults."""
    return _eval_defaults(json_array.records(spark, path).select(F.col("pos").alias("qid"), F.from_json("value", _EVAL).alias("s")))


_PRIVACY, _PENAL = "中华人民共和国个人信息保护法", "中华人民共和国刑法"
# The built-in evaluation rows (question, answer, law, article).
BUILT_IN = (
    ("生物识别信息属于什么类型的个人信息？", "生物识别信息属于敏感个人信息。", _PRIVACY, "第二十八条"),
    ("处理个人信息需要遵循哪些原则？", "处理个人信息应遵循合法、正当、必要和诚信原则。", _PRIVACY, "第五条"),
    ("什么是故意犯罪？", "明知自己的行为会发生危害社会的结果，并且希望或者放任这种结果发生，因而构成犯罪的，是故意犯罪。", _PENAL, "第十四条"),
    ("个人信息的处理包括哪些活动？", "个人信息的处理包括个人信息的收集、存储、使用、加工、传输、提供、公开、删除等。", _PRIVACY, "第四条"),
    ("刑法的任务是什么？", "刑法的任务是用刑罚同一切犯罪行为作斗争，以保卫国家安全，保卫人民民主专政的政权和社会主义制度，保护国有财产和劳动群众集体所有的财产，保护公民私人所有的财产，保护公民的人身权利、民主权利和其他权利，维护社会秩序、经济秩序，保障社会主义建设事业的顺利进行。", _PENAL, "第二条"),
    ("什么是法律面前人人平等？", "对任何人犯罪，在适用法律上一律平等。不允许任何人有超越法律的特权。", _PENAL, "第四条"),
    ("个人信息处理者在处理个人信息前应当告知哪些事项？", "个人信息处理者在处理个人信息前，应当以显著方式、清晰易懂的语言真实、准确、完整地向个人告知个人信息处理者的名称或者姓名和联系方式等信息。", _PRIVACY, "第十七条"),
    ("什么是犯罪未完成形态？", "犯罪未完成形态包括犯罪预备、犯罪未遂和犯罪中止。", _PENAL, "第五章"),
    ("中国去年的GDP增长率是多少？", "该问题不在法律知识库覆盖范围内。", None, None),
    ("个人撤回同意后，之前的处理活动是否还有效？", "个人撤回同意，不影响撤回前基于个人同意已进行的个人信息处理活动的效力。", _PRIVACY, "第十五条"),
)


def built_in_eval(spark: SparkSession) -> DataFrame:
    rows = [{"question": q, "ground_truth": a, "category": "legal_consultation" if law else "unanswerable", "relevant_laws": [{"law_name": law, "article": n}] if law else [], "expected_answer_type": "with_citation" if law else "refuse"} for q, a, law, n in BUILT_IN]
    whole = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), EVAL_SCHEMA)).alias("qid", "s"))
    return _eval_defaults(whole)


def read_laws(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """doc_id, source, content, law_name, effective_date of a law text or of all below a folder that fit ``glob``.

    doc_id is a hash of the path, so it is the same wherever the file is read.
    """
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))
    return texts.select(F.xxhash64("source").alias("doc_id"), "source", "content", chunk.law_name("content").alias("law_name"), chunk.effective_date("content").alias("effective_date"))


def load_index(spark: SparkSession, path: str, encoder: str | None = None) -> tuple[DataFrame, dict]:
    """(chunks with vectors, configuration) of a saved index; ``encoder``: the name it must have been made with."""
    config = json.loads(spark.read.text(f"{path}/config", wholetext=True).collect()[0][0])
    if encoder is not None and config["embedding_model"] != encoder:
        raise ValueError(f"the index was made with {config['embedding_model']}, not {encoder}")
    return spark.read.parquet(f"{path}/chunks"), config
