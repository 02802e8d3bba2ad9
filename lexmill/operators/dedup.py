"""Exact duplicates by hash and near duplicates by vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import cut
from . import cells
from .components import connected_components

#: Edges of a component that one task replays at most.
LOG_EDGES = 1_000_000


def _firsts(df: DataFrame, text: Column | str, pos: str, hashed: bool = False) -> DataFrame:
    """The smallest pos of every text, white space aside. Only hashes and positions are grouped, with partial minima."""
    key = X.col(text) if hashed else X.content_hash(text)
    return df.select(key.alias("_hash"), F.col(pos).alias("_first")).groupBy("_hash").agg(F.min("_first").alias("_first")).select("_first")


def exact(df: DataFrame, text: Column | str, pos: str = "pos") -> DataFrame:
    """The rows with the smallest pos of each text, white space aside: a semi-join on pos, so no text is dealt by what it says.

    ``pos`` must tell rows apart; rows that repeat it stay or go together. A null pos goes unless its text has no other.
    """
    kept = _firsts(df, text, pos)
    return df.join(kept, F.col(pos).eqNullSafe(F.col("_first")), "left_semi")


def exact_removed(df: DataFrame, text: Column | str, pos: str = "pos") -> DataFrame:
    """pos of the rows that ``exact`` leaves out."""
    return df.select(pos).join(_firsts(df, text, pos), F.col(pos).eqNullSafe(F.col("_first")), "left_anti")


def semantic_edges(df: DataFrame, id_col: str, vector: str, threshold: float = 0.80, neighbours: int = 19) -> DataFrame:
    """a, b, similarity, slot: every row with its nearest ``neighbours`` others at or above the threshold, in order of ``slot`` from 1
    (both directions may occur)."""
    near = cells.similar(df, id_col, vector, threshold, neighbours).links
    slot = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("score").alias("similarity"), slot.alias("slot"))


def _replayed(edges: pa.Table) -> pa.Table:
    """The unions of one component's edges in scan order, each by the two roots it joins, and the removed row's root in the end."""
    order = np.lexsort((np.asarray(edges.column("slot")), np.asarray(edges.column("row"))))
    ends = list(zip(np.asarray(edges.column("u"))[order].tolist(), np.asarray(edges.column("v"))[order].tolist()))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    at, removed, kept = [], [], []
    for i, (u, v) in enumerate(ends):
        u, v = root(u), root(v)
        if u != v:
            parent[max(u, v)] = min(u, v)
            at.append(order[i])
            removed.append(max(u, v))
            kept.append(min(u, v))
    own = edges.take(pa.array(at, pa.int64()))
    columns = {"removed_id": pa.array(removed, pa.int64()), "kept_id": pa.array(kept, pa.int64()), "root": pa.array([root(x) for x in removed], pa.int64())}
    return pa.table(columns | {c: own.column(c) for c in ("similarity", "row", "slot")})


def _last(edges: DataFrame, most: int) -> DataFrame:
    """component, last: the (row, slot) of the edge at place ``most`` of each component with as many. Edges go by ranges of the order;
    the ranges' sizes are summed up before them and one range numbers its own, so no task gets a whole component."""
    ranged = cut(edges.select("component", "row", "slot").repartitionByRange("component", "row", "slot").withColumn("_range", F.spark_partition_id()), "scan-order")
    sizes = ranged.groupBy("component", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("component").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    hit = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where((F.col("_before") < most) & (F.col("_before") + F.col("_n") >= most)).drop("_n")
    own = F.row_number().over(Window.partitionBy("component", "_range").orderBy("row", "slot"))
    found = ranged.join(F.broadcast(hit), ["component", "_range"]).withColumn("_at", F.col("_before") + own).where(F.col("_at") == most)  # a row a large component
    return found.select("component", F.struct("row", "slot").alias("last"))


def removal_log(edges: DataFrame, most: int = LOG_EDGES) -> DataFrame:
    """removed_id, kept_id, similarity, row, slot of each union of a scan over rows and their neighbours.

    ``edges``: a, b, similarity, slot. A scan takes rows in order and their neighbours by slot, and joins two groups wherever an edge
    meets two: the group's smaller row is kept, the other's removed. Edges of different components never meet, so components
    are replayed side by side. Of a large one the first ``most`` edges are replayed at a time, as no later edge can change what
    they do; the others then go on between the groups' roots, where most are loops and leave. So no task gets more than that.
    Null ends and loops say nothing; an edge given both ways, or several times, counts where the scan meets it first.
    """
    parts = connected_components(edges.select("a", "b")).select(F.col("node").alias("u"), "component")
    first = lambda e: e.where("u <> v").groupBy("component", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct("row", "slot", "similarity")).alias("e")).select("component", "u", "v", "e.*")
    given = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("a").alias("row"), "slot", "similarity")
    rest, log = cut(first(given.join(parts, "u")), "scan-edges"), None
    ddl = "removed_id long, kept_id long, root long, similarity double, row long, slot int"
    while True:
        large = (rest.groupBy("component").count().agg(F.max("count")).first()[0] or 0) > most
        now, later = rest, None
        if large:
            placed = rest.join(F.broadcast(cut(_last(rest, most), "scan-last")), "component", "left").withColumn("_later", F.coalesce(F.struct("row", "slot") > F.col("last"), F.lit(False))).drop("last")
            now, later = placed.where("not _later").drop("_later"), placed.where("_later").drop("_later")
        done = cut(now.groupBy("component").applyInArrow(_replayed, ddl), "scan-log")
        log = done if log is None else log.unionAll(done)
        if not large:
            return log.drop("root")
        roots = done.select("removed_id", "root")
        for end in ("u", "v"):
            later = later.join(roots, F.col(end) == F.col("removed_id"), "left").withColumn(end, F.coalesce("root", end)).drop("removed_id", "root")
        rest = cut(first(later), "scan-edges")


def semantic_kept(df: DataFrame, id_col: str, vector: str, threshold: float = 0.80, neighbours: int = 19) -> DataFrame:
    """The rows that ``semantic`` keeps, without its log: the scan removes all rows of a component but the smallest, so none is replayed."""
    parts = connected_components(semantic_edges(df, id_col, vector, threshold, neighbours).select("a", "b"))
    return df.join(parts.where("node <> component").select(F.col("node").alias(id_col)), id_col, "left_anti")


def semantic(df: DataFrame, id_col: str, vector: str, threshold: float = 0.80, neighbours: int = 19) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, removal log). Of each component of similar rows the smallest id stays; the log is that of ``removal_log``."""
    log = removal_log(cut(semantic_edges(df, id_col, vector, threshold, neighbours), "semantic-edges"))
    return df.join(log.select(F.col("removed_id").alias(id_col)), id_col, "left_anti"), log


def log_head(log: DataFrame, n: int = 100) -> DataFrame:
    """The first removed pairs of the scan, similarity rounded to four places."""
    return log.orderBy("row", "slot").limit(n).select("removed_id", "kept_id", F.round("similarity", 4).alias("similarity"))


def deduplicate(df: DataFrame, text: Column | str, pos: str, vector: str, threshold: float = 0.80, hashed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, removal log, counts): exact first, then by vectors.

    With ``hashed``, ``text`` is each text's ``content_hash`` already, so that rows may come without their texts.
    """
    kept = cut(_firsts(df, text, pos, hashed), "exact-kept")
    unique = df.join(kept, F.col(pos).eqNullSafe(F.col("_first")), "left_semi")
    log = semantic(cut(unique.select(pos, vector), "exact-vectors"), pos, vector, threshold)[1]
    rows = unique.join(log.select(F.col("removed_id").alias(pos)), pos, "left_anti")
    one = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    counts = one(df, "original").crossJoin(one(unique, "after_exact")).crossJoin(one(rows, "deduped"))
    counts = counts.select("original", (F.col("original") - F.col("after_exact")).alias("exact_removed"), (F.col("after_exact") - F.col("deduped")).alias("semantic_removed"), "deduped")
    return rows, log, counts


def duplicate_groups(df: DataFrame, text: Column | str, pos: str = "pos") -> DataFrame:
    """hash, n, first_pos of every text that occurs more than once."""
    return df.select(X.content_hash(text).alias("hash"), pos).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_pos")).where("n > 1")


def rank_within(df: DataFrame, by: list[Column], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
