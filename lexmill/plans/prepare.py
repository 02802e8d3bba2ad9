"""Program A: clean, deduplicate, sample, mix and split, with a report."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clean, dedup, report, sample, split, vectors
from ..storage import cut


def prepare(
    legal: DataFrame,
    general: DataFrame | None = None,
    *,
    encoder: Callable[[list[str]], np.ndarray] | None = None,
    threshold: float = 0.80,
    n_samples: int = 3000,
    quotas: Mapping[str, int] | None = None,
    mix_legal: float = 0.8,
    seed: int = 42,
    skip_dedup: bool = False,
    skip_sample: bool = False,
    reasons_of: tuple[str, ...] | None = None,
    rules: Mapping | None = None,
) -> tuple[DataFrame, dict]:
    """(rows with split, report). ``legal`` and ``general``: pos and the raw fields.

    Only legal rows are deduplicated; without sampling all general rows are left out; with a ratio legal rows are limited to
    their share even alone. ``reasons_of=('legal',)`` counts the legal rows' reasons only; by default both count.
    """
    encoder = encoder or vectors.HashedTrigrams()
    rules = dict(rules or {})
    parts = {"legal": cut(clean.classify(legal, **rules), "legal")}
    if general is not None:
        parts["general"] = cut(clean.classify(general, **rules), "general")
    stats = {k: clean.clean_stats(v).first() for k, v in parts.items()}
    rows = clean.kept(parts["legal"])
    removed = 0
    text = X.joined()
    if not skip_dedup:
        with_vectors = cut(vectors.encode(rows.withColumn("_text", text), "_text", encoder, "embedding"), "encoded")
        rows, _, counts = dedup.deduplicate(with_vectors, text, "pos", "embedding", threshold)
        c = counts.first()
        removed = c["exact_removed"] + c["semantic_removed"]
        rows = rows.drop("_text", "embedding")
    sources = [("legal", rows.withColumn("_key", F.concat(F.lit("legal:"), F.col("pos").cast("string"))))]
    ratios = {"legal": mix_legal}
    if general is not None and not skip_sample:
        other = vectors.encode(clean.kept(parts["general"]).withColumn("_text", text), "_text", encoder, "embedding")
        chosen = sample.sample(cut(other, "encoded"), "_text", "embedding", "pos", quotas or sample.default_quotas(n_samples), seed=seed).drop("_text", "embedding", "ability")
        sources.append(("general", chosen.withColumn("_key", F.concat(F.lit("general:"), F.col("pos").cast("string")))))
        ratios["general"] = 1 - mix_legal
    done = split.mix_and_split([(n, d.drop("category")) for n, d in sources], "_key", ratios, seed)
    counts = split.split_counts(done).first()
    reasons = {r["reason"]: r["n"] for r in report.reason_totals(parts, reasons_of).collect()}  # a row a reason
    return done.drop("_key"), {
        "original_count": sum(s["original"] for s in stats.values()),
        "format_error_count": reasons.get("format_error", 0),
        "rule_filtered_count": sum(s["filtered"] for s in stats.values()),
        "semantic_duplicate_count": removed,
        "final_count": counts["total"],
        "train_count": counts["train"],
        "val_count": counts["val"],
        "test_count": counts["test"],
        "category_distribution": {r["category"]: r["n"] for r in done.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()},
        "clean_reason_distribution": reasons,
        "seed": seed,
        "config": {"similarity_threshold": threshold, "n_samples": n_samples, "mix_ratio_legal": mix_legal},
    }
