"""Citations of a whole corpus linked to a catalogue of laws: names within names, without comparing all names with all.

A citation means an entry if the article numbers are equal and one name stands within the other. Only different names are compared.
A name that stands within another shares all its pieces of two letters with it, so it is looked up by one alone: the one that
the fewest names of the other side hold. What that finds is verified. The pairs of names then join citations and entries by
equal names and numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import cut

PIECE = 2


def _pieces(name: Column) -> Column:
    """All pieces of a name up to PIECE letters, each once; the empty one too, which is in all names."""
    of = lambda k: F.when(F.length(name) >= k, F.transform(F.sequence(F.lit(1), F.length(name) - k + 1), lambda i: F.substr(name, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), *[of(k) for k in range(1, PIECE + 1)]))


def names_within(short: DataFrame, long: DataFrame) -> DataFrame:
    """inner, outer: names of ``short`` that stand within names of ``long`` (equal ones too). Both have a column ``name``, each once."""
    postings = long.select(F.col("name").alias("outer"), F.explode(_pieces(F.col("name"))).alias("piece"))
    held = postings.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    own = short.select("name", F.explode(_pieces(F.col("name"))).alias("piece")).where(F.length("piece") == F.least(F.length("name"), F.lit(PIECE)))
    # a piece that no other name holds settles that there is none
    rarest = own.join(held, "piece", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("best")).where("best.n > 0")
    found = rarest.select(F.col("name").alias("inner"), F.col("best.piece").alias("piece")).join(postings, "piece")
    return found.where(F.contains("outer", F.col("inner"))).select("inner", "outer")


def linked(citations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``citations`` (law_name, article, others) with ``entry_law`` and ``entry_article`` of every entry (law_name, article) that each means.

    Null names and numbers mean nothing; an empty name stands within all, as in ``text.law_match``. Entries that repeat count once,
    citations each. Other columns stay, but for those named like the two new ones. Empty tables link nothing.
    """
    entries = cut(catalogue.select(F.col("law_name").alias("entry_law"), F.col("article").alias("entry_article")).where("entry_law IS NOT NULL AND entry_article IS NOT NULL").distinct(), "entries")
    cited = citations.drop("entry_law", "entry_article")
    a = cut(cited.where("law_name IS NOT NULL").select(F.col("law_name").alias("name")).distinct(), "cited-names")
    b = entries.select(F.col("entry_law").alias("name")).distinct()
    pairs = names_within(a, b).select(F.col("inner").alias("_law"), F.col("outer").alias("entry_law")).unionAll(names_within(b, a).select(F.col("outer").alias("_law"), F.col("inner").alias("entry_law"))).distinct()
    meant = pairs.join(entries, "entry_law")
    return cited.join(meant, (F.col("law_name") == F.col("_law")) & (F.col("article") == F.col("entry_article"))).drop("_law")


def cited_in(docs: DataFrame, text: str, key: str) -> DataFrame:
    """key, law_name, article of the different citations in each text."""
    return docs.select(key, F.explode(X.citations(text)).alias("c")).select(key, "c.law_name", "c.article")
