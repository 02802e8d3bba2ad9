"""Rule cleaning: field aliases and the cascade of rejections, first match wins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V

REASONS = ("missing_field", "too_short", "invalid_article_ref", "template_reply", "format_error", "entertainment", "fact_memorization", "low_quality", "length_abnormal", "duplicate_content")


def normalise(df: DataFrame, strict: bool = True) -> DataFrame:
    """instruction, input, output, category, source from the raw columns of ``df``, which may lack any of them.

    Aliases: query and question, response and answer. ``strict``: a record counts only if it has the keys instruction and
    output (a ``has_fields`` column, true where the caller has none), so an alias helps where the key is there but empty;
    otherwise an alias is enough. A column ``input_is_text`` (false: another JSON type) empties ``input``.
    """
    has = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    instruction = X.strip(X.first_filled(has("instruction"), has("query"), has("question")))
    output = X.strip(X.first_filled(has("output"), has("response"), has("answer")))
    given = F.col("has_fields") if "has_fields" in df.columns else F.lit(True)
    valid = given if strict else given | ((instruction != "") & (output != ""))
    text_input = F.col("input_is_text") if "input_is_text" in df.columns else F.lit(True)
    made = {
        "instruction": instruction,
        "input": F.when(text_input, X.strip(X.or_empty(has("input")))).otherwise(""),
        "output": output,
        "category": F.coalesce(has("category"), F.lit("unknown")),
        "source": X.or_empty(has("source")),
        "valid": valid,
    }
    rest = [c for c in df.columns if c not in {*made, "query", "question", "response", "answer"}]
    return df.select(*rest, *[c.alias(k) for k, c in made.items()])


def to_alpaca(df: DataFrame) -> DataFrame:
    return df.select(*[X.or_empty(c).alias(c) for c in ("instruction", "input", "output")])


def to_sharegpt(df: DataFrame) -> DataFrame:
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    return df.select(F.array(turn("human", "instruction"), turn("gpt", "output")).alias("conversations"))


def reason(
    instruction: Column | str = "instruction",
    output: Column | str = "output",
    valid: Column | None = None,
    *,
    min_instruction: int = 5,
    min_output: int = 20,
    max_output: int = 2000,
    entertainment: Iterable[str] = V.ENTERTAINMENT,
    fact: Iterable[str] = V.FACT,
    low_quality: Iterable[str] = V.LOW_QUALITY,
    templates: Iterable[str] = V.TEMPLATES,
    law_terms: Iterable[str] = V.LAW_TERMS,
) -> Column:
    """Why a stripped record is rejected, null if it is kept. One CASE, in the order in which the rules apply.

    Keyword rules search lower-cased text with the packs as they are, so an upper-case entry never matches.
    """
    i, o = X.col(instruction), X.col(output)
    both = F.concat(i, F.lit(" "), o)
    low = F.lower(both)
    rules = [
        (~(F.lit(True) if valid is None else valid), "missing_field"),
        ((F.length(i) < min_instruction) | (F.length(o) < min_output), "too_short"),
        (o.rlike(rf"(?U)第{X.SPACE}*0{X.SPACE}*条|第{X.SPACE}*[a-zA-Z]+{X.SPACE}*条"), "invalid_article_ref"),
        (F.contains(o, F.lit(V.TEMPLATE_LEAD)) & ~o.rlike(r"(?Ud)《.*?》第\d+条"), "template_reply"),
        (both.rlike(rf"(?Ud)答：{X.SPACE}*\.\.\.|无内容|error|undefined|\[.*?\]|<.*?>"), "format_error"),
        (X.any_of(low, entertainment), "entertainment"),
        (X.any_of(low, fact) & ~X.any_of(low, law_terms), "fact_memorization"),
        (X.any_of(F.lower(o), low_quality), "low_quality"),
        (X.any_of(o, templates), "template_reply"),
        (~F.length(X.strip(o)).between(min_output, max_output), "length_abnormal"),
        (X.strip(i) == X.strip(o), "duplicate_content"),
    ]
    out = F.lit(None).cast("string")
    for test, name in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def classify(df: DataFrame, strict: bool = True, **rules) -> DataFrame:
    """``df`` normalised, with ``reason``. A narrow step: filters on it and histograms of it share one scan if cached."""
    return normalise(df, strict).withColumn("reason", reason(valid=F.col("valid"), **rules)).drop("valid")


def kept(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reason").isNull())


def removed(classified: DataFrame) -> DataFrame:
    """The deletion log: what was left out, and why."""
    item = F.to_json(F.struct("instruction", "input", "output", "category", "source")) if "raw" not in classified.columns else F.col("raw")
    return classified.where(F.col("reason").isNotNull()).select(item.alias("item"), "reason")


def reason_counts(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def clean_stats(classified: DataFrame) -> DataFrame:
    """One row: original, cleaned, filtered and the map of reasons."""
    return (
        classified.groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("original"),
            F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("cleaned"),
            F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias("filtered"),
            F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("reason_distribution"),
        )
    )
