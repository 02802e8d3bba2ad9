"""Mixing sources by ratio and splitting into train, validation and test, with exact counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

SPLITS = ("train", "val", "test")


def shuffle_key(key: Column | str, seed: int) -> Column:
    """An order that depends on seed and key alone, and that SQL engines agree on. A null key stands where the empty one does."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))).cast("binary"))


def numbered(df: DataFrame, by: list[str], key: str, seed: int, name: str = "nth") -> DataFrame:
    """``df`` with each row's number (from 1) in its group's shuffled order.

    A window over a whole group would be one task. Rows go by ranges of the order instead: each range numbers its own rows, and the
    ranges' sizes (a row a range and group) are summed up before them. The ranges are the first letters of the order, so rows of
    a range stay within it however large the group is.
    """
    width = 3  # 4,096 ranges
    h = df.withColumn("_h", shuffle_key(key, seed)).withColumn("_r", F.substring("_h", 1, width))
    sizes = h.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select(*[F.col(c).alias(f"_o_{i}") for i, c in enumerate(by)], F.col("_r").alias("_or"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = [F.col(c).eqNullSafe(F.col(f"_o_{i}")) for i, c in enumerate(by)] + [F.col("_r") == F.col("_or")]
    joined = h.join(offset, on).drop("_or", *[f"_o_{i}" for i in range(len(by))])
    own = F.row_number().over(Window.partitionBy(*by, "_r").orderBy("_h", key))
    return joined.withColumn(name, F.col("_before") + own).drop("_h", "_r", "_before")


def check_ratios(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("the ratios must sum to 1")


def split(df: DataFrame, key: str, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42, stratum: Column | None = None) -> DataFrame:
    """``df`` with ``split``: the first int(n * train) of a stratum's shuffled rows, the next int(n * val), the rest.

    Without ``stratum`` all rows are one; a null stratum is 'unknown'.
    """
    check_ratios(train, val, test)
    rows = df.withColumn("_s", F.lit("") if stratum is None else F.coalesce(stratum.cast("string"), F.lit("unknown")))
    counts = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered(rows, ["_s"], key, seed, "_nth").join(counts, "_s")
    first = F.floor(F.col("_n") * F.lit(float(train)))
    second = first + F.floor(F.col("_n") * F.lit(float(val)))
    return placed.withColumn("split", F.when(F.col("_nth") <= first, "train").when(F.col("_nth") <= second, "val").otherwise("test")).drop("_s", "_n", "_nth")


def tag(df: DataFrame, name: str) -> DataFrame:
    """``source`` becomes the name; ``category`` only where the rows have no such column or value."""
    category = F.coalesce(F.col("category"), F.lit(name)) if "category" in df.columns else F.lit(name)
    return df.withColumns({"source": F.lit(name), "category": category})


def mix(df: DataFrame, key: str, ratios: Mapping[str, float], seed: int = 42, source: str = "source") -> DataFrame:
    """Of each source min(int(total * ratio), size) rows, total counted before; sources without a ratio give none."""
    pairs = [F.lit(x) for k, v in ratios.items() for x in (k, float(v))]
    rows = df.where(F.col(source).isin(list(ratios)))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    ratio = F.create_map(*pairs)[F.col(source)]
    placed = numbered(rows, [source], key, seed, "_nth").crossJoin(F.broadcast(total))  # one row
    return placed.where(F.col("_nth") <= F.floor(F.col("_total") * ratio)).drop("_nth", "_total")


def mix_and_split(sources: Sequence[tuple[str, DataFrame]], key: str, ratios: Mapping[str, float] | None = None, seed: int = 42, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """Tags, mixes and splits by source; cut as a table, as the sinks read it several times."""
    every = None
    for name, df in sources:
        every = tag(df, name) if every is None else every.unionByName(tag(df, name), allowMissingColumns=True)
    mixed = mix(every, key, ratios, seed) if ratios else every
    return cut(split(mixed, key, train, val, test, seed, F.col("source")), "split")


def split_counts(df: DataFrame) -> DataFrame:
    """One row: total, train, val, test."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
