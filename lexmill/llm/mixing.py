"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed per source (partial sums before the exchange), targets come from the source table, and every document is
emitted floor(rate) times and once more with the probability of the fraction, drawn from a hash of the seed and its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh_names

CYCLE = (3, 1, 2)
#: Sources whose targets are sent to all workers at most; beyond it is a join.
SEND_SOURCES = 200_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, share: float, most: float, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """source, source_size, target. ``sizes``: source, source_size; one row a source.

    Sources in order of code points (null last) weigh ``cycle`` in turn. A target is min(most * size, level * weight) with
    the level at which the targets sum to ``share`` of all sizes: what sharing out the excess by weight comes to in the end.
    A source reaches its cap before another if most * size / weight is smaller, so caps are summed up in that order. The
    global windows here are over one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(by_name) - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), turn + 1)
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    s = s.withColumn("final", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", target.alias("target"))


def _rated(docs: DataFrame, names: tuple[str, str, str, str, str], share: float, most: float, seed: int, size: Column | None, cycle: tuple[int, ...]) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies under the given names."""
    n, total, target, rate, copies = names
    own, source = fresh_names(docs.select(*docs.columns, *[F.lit(None).alias(x) for x in names]), 2)
    docs = docs.withColumn(n, n_words(F.col("text")) if size is None else size)
    sizes = cut(docs.groupBy("source").agg(F.sum(n).alias("source_size")), "source-sizes")
    targets = source_targets(sizes, share, most, cycle).select(F.col("source").alias(source), F.col("source_size").alias(total), F.col("target").alias(target))
    if sizes.count() <= SEND_SOURCES:  # else documents would be dealt by source, a hot one to a single task
        targets = F.broadcast(targets)
    joined = docs.withColumnRenamed("source", own)
    joined = joined.join(targets, F.col(own).eqNullSafe(F.col(source)), "left").drop(source).withColumnRenamed(own, "source")
    joined = joined.withColumn(rate, F.when(F.col(total) > 0, F.least(F.col(target) / F.col(total), F.lit(float(most)))).otherwise(F.lit(0.0)))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    extra = F.when(draw < F.col(rate) - F.floor(rate), 1).otherwise(0)
    return joined.withColumn(copies, F.floor(rate).cast("long") + extra)


def mix(docs: DataFrame, *, share: float = 1.5, most: float = 2.0, seed: int = 17, size: Column | None = None, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies (how often the mix takes the document).

    ``size`` defaults to the number of words of ``text`` (null: 0). A null source is a source of its own. A source of size 0
    has target 0 and its documents no copies. The draw depends on seed and doc_id alone (a null id: the id ''), so reruns agree
    and rows that repeat an id are taken alike. Columns of these five names in the input are replaced; all others stay.
    """
    names = ("size", "source_size", "target", "rate", "copies")
    return _rated(docs.drop(*names), names, share, most, seed, size, cycle)


def repeated(docs: DataFrame, *, share: float = 1.5, most: float = 2.0, seed: int = 17, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with the columns of ``docs`` as they are, whatever their names."""
    names = tuple(fresh_names(docs, 5))
    return _times(_rated(docs, names, share, most, seed, None, cycle), names[4]).select(docs.columns)


def _times(rows: DataFrame, copies: str) -> DataFrame:
    (turn,) = fresh_names(rows, 1)
    return rows.where(F.col(copies) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(turn)


def emit(mixed: DataFrame) -> DataFrame:
    """The rows of a mix, each as often as ``copies`` says, with all their columns."""
    return _times(mixed, "copies")


def oracle(share: float = 1.5, most: float = 2.0, seed: int = 17) -> str:
    """DuckDB SQL of the same mix, by its own route: the level is searched among the sources' caps."""
    return f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
    c AS (SELECT *, source_size * {most}::DOUBLE AS cap FROM w),
    l AS (SELECT a.source, ({share}::DOUBLE * (SELECT sum(source_size) FROM c) - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0))
            / sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS level, any_value(a.cap / a.weight) AS top FROM c a, c b GROUP BY a.source),
    f AS (SELECT arg_min(level, top) AS level FROM l WHERE level <= top),
    t AS (SELECT c.source, source_size, least(cap, coalesce((SELECT level FROM f) * weight, cap)) AS target FROM c),
    r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, {most}::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
            ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
      (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""
