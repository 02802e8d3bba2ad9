"""Reports: processing counters, evaluation summaries, comparison of experiments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def reason_totals(parts: Mapping[str, DataFrame], only: Sequence[str] | None = None) -> DataFrame:
    """reason, n over several classified sources; ``only``: the sources whose reasons count (all, if not given)."""
    every = None
    for name, df in parts.items():
        if only is None or name in only:
            rows = df.where(F.col("reason").isNotNull()).select("reason")
            every = rows if every is None else every.unionAll(rows)
    if every is None:
        raise ValueError("no source is named")
    return every.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _counted(title: str, counts: Mapping, order) -> str:
    return "\n".join([title, *(f"  {name}: {n}" for name, n in sorted(counts.items(), key=order))])


def processing_summary(r: Mapping) -> str:
    """The text of a processing report from its counters (a dict as the report's JSON has it)."""
    blocks = [V.PROCESSING_REPORT.format_map({**dict.fromkeys(V.PROCESSING_COUNTERS, 0), "seed": 42, **r}), _counted(V.CATEGORIES, r.get("category_distribution", {}), None)]
    if reasons := r.get("clean_reason_distribution"):
        blocks.append(_counted(V.REASONS, reasons, lambda x: -x[1]))
    return "\n\n".join(blocks)


def evaluation_summary(r: Mapping) -> str:
    """The text of an evaluation report: a block a group of metrics that the report has."""
    blocks = [V.EVALUATION_REPORT.format_map({"experiment_name": "", "num_samples": 0, **r})]
    for group, (title, metrics) in V.METRICS.items():
        found = r.get(group) or {}
        if found and (group != "refusal" or found.get("num_unanswerable", 0) > 0):
            blocks.append("\n".join([f"--- {title} ---", *(f"  {label}{found.get(name, 0):{style}}" for label, name, style in metrics)]))
        if group == "answer" and found.get("category_breakdown"):
            blocks.append("\n".join([V.BY_CATEGORY, *(f"    {c}: {share:.4f}" for c, share in found["category_breakdown"].items())]))
    last = [V.ERRORS.format(len(r["errors"]))] if r.get("errors") else []
    return "\n\n".join([*blocks, "\n".join([*last, V.REPORT_NOTE])])


def comparison(df: DataFrame) -> DataFrame:
    """The nine columns of a comparison as texts with three decimals, '-' where a value is null."""
    names = ("recall_at_1", "recall_at_3", "mrr", "precision", "recall", "f1", "conclusion_accuracy", "refusal_accuracy")
    have = [c if c in df.columns else None for c in names]
    shown = [F.coalesce(F.format_string("%.3f", F.col(c).cast("double")), F.lit("-")) if c else F.lit("-") for c in have]
    shown = [F.when(F.col(c).isNull(), "-").otherwise(x) if c else x for c, x in zip(have, shown)]
    return df.select("experiment", *[x.alias(n) for x, n in zip(shown, names)])


def comparison_table(rows: Sequence[Sequence[str]]) -> str:
    """Rows of ``comparison`` as an aligned text table: columns are filled up first, then put side by side."""
    filled = []
    for title, *cells in zip(V.COMPARISON_HEADERS, *rows):
        size = max(len(str(c)) for c in (title, *cells))
        filled.append([str(title).ljust(size), "-" * size, *(str(c).ljust(size) for c in cells)])
    return "\n".join(("-+-" if k == 1 else " | ").join(line) for k, line in enumerate(zip(*filled)))
