"""Connected components by star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut


#: Rows of a table of nodes that are sent to all workers at most; a larger one is joined through an exchange.
SEND_NODES = 500_000


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component: the smallest node reachable, for every node of ``edges`` (its first two columns are the ends).

    Large-star and small-star steps in turn until the edges are stars; every round is a written table, so lineage stays short
    and nothing but a count reaches the driver beside a table of SEND_NODES nodes at most. A step sends minima, never neighbour
    lists, through the exchange. Null ends and loops are left out of the contraction; a loop's node is a component of its own.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    pairs = cut(pairs, "edges")
    now = pairs.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    for _ in range(most):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        sent = F.broadcast if low.count() <= SEND_NODES else lambda table: table
        of_u, of_v = (sent(low.select(F.col("u").alias(end), F.col("m").alias(f"low_{end}"))) for end in "uv")
        # in a star the upper end's least is the lower one, which has none below itself
        if not now.join(of_u, "u").join(of_v, "v").where("low_u != v or low_v != v").take(1):
            break
        large = now.join(of_v, "v").select("u", F.col("low_v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sent(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionAll(least.select("u", F.col("m").alias("v")))
        now = cut(small.distinct(), "stars")
    else:
        raise RuntimeError("the contraction did not settle")
    found = low.select(F.col("u").alias("node"), F.col("m").alias("component"))
    loops = pairs.where(F.col("u") == F.col("v"))
    if not loops.take(1):
        return found
    alone = loops.select(F.col("u").alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionAll(alone.select("node", F.col("node").alias("component")))
