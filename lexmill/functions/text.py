"""Column functions over strings, with Python's notion of white space, digits and dots."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

#: White space as Python's str sees it: Unicode's, and the four separators that Java's (?U)\s leaves out.
SPACE = r"[\s\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def squeeze_out(c: Column | str) -> Column:
    """The text without any white space (the normal form that duplicates are compared in)."""
    return F.regexp_replace(col(c), rf"(?U){SPACE}+", "")


def or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def first_filled(*cs: Column | str) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs], F.lit(""))


def joined(instruction: Column | str = "instruction", output: Column | str = "output") -> Column:
    return F.concat(or_empty(instruction), F.lit(" "), or_empty(output))


def content_hash(c: Column | str) -> Column:
    return F.md5(squeeze_out(c).cast("binary"))


def any_of(c: Column | str, words: Iterable[str]) -> Column:
    """Whether a text holds one of the words: one alternation, compiled once."""
    words = list(dict.fromkeys(words))
    if not words:
        return F.lit(False)
    return or_empty(c).rlike("|".join(_literal(w) for w in words))


def _literal(word: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", word)


def answer_form(c: Column | str) -> Column:
    """Without white space and marks, lower case: the form in which answers are compared."""
    return strip(F.lower(F.regexp_replace(squeeze_out(c), f"[{V.MARKS}]", "")))


def keywords(c: Column | str) -> Column:
    """Pieces between marks and white space of two letters or more; a text under 100 letters adds its own answer form.

    A text without any gives itself.
    """
    text = or_empty(c)
    pieces = F.split(F.regexp_replace(text, rf"(?U)[{V.MARKS}\s\x1c-\x1f]+", " "), " ")
    kept = F.filter(pieces, lambda w: F.length(w) >= 2)
    kept = F.when(F.length(text) < 100, F.concat(kept, F.array(answer_form(text)))).otherwise(kept)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(text))


def keyword_score(truth: Column | str, answer: Column | str) -> Column:
    words, said = keywords(truth), or_empty(answer)
    return F.size(F.filter(words, lambda w: F.contains(said, w))) / F.size(words)


def citations(c: Column | str, units: str = "条", article_prefix: str = "fixed", distinct: bool = True) -> Column:
    """array<struct<law_name, article>> of the citations in a text, in order.

    ``article_prefix``: 'fixed' keeps the ordinal mark before the number, as chunks and annotations have it; 'compat' leaves it
    out, which never equals theirs. ``units``: the units that may end an article; ``distinct`` keeps the first of each.
    """
    if article_prefix not in ("fixed", "compat"):
        raise ValueError("article_prefix is fixed or compat")
    pattern = F.lit(f"(?U)《([^》]+)》第([{V.NUMERALS}]+[{units}])")
    names, numbers = F.regexp_extract_all(or_empty(c), pattern, F.lit(1)), F.regexp_extract_all(or_empty(c), pattern, F.lit(2))
    lead = F.lit("第" if article_prefix == "fixed" else "")
    found = F.transform(F.arrays_zip(names.alias("n"), numbers.alias("a")), lambda x: F.struct(x["n"].alias("law_name"), F.concat(lead, x["a"]).alias("article")))
    return F.array_distinct(found) if distinct else found


def context(results: Column | str) -> Column:
    """The numbered listing of results (law_name, chapter, article, content) that goes into a prompt."""

    def entry(x: Column, i: Column) -> Column:
        more = lambda f: F.when(or_empty(x[f]) != "", F.concat(F.lit(" "), x[f])).otherwise("")
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(x["law_name"], F.lit(V.UNKNOWN_LAW)), more("chapter"), more("article"), F.lit("\n"), or_empty(x["content"]))

    return F.array_join(F.transform(col(results), entry), "\n\n---\n\n")


def prompt(question: Column | str, ctx: Column | str) -> Column:
    """array<struct<role, content>> with the system's and the user's message."""
    a, b, c = V.USER_PROMPT
    user = F.concat(F.lit(a), or_empty(question), F.lit(b), or_empty(ctx), F.lit(c))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(V.SYSTEM_PROMPT).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def listing(question: Column | str, results: Column | str) -> Column:
    """The answer that only lists what was found."""
    a, b, c = V.LISTING

    def entry(x: Column) -> Column:
        more = lambda f: F.when(or_empty(x[f]) != "", F.concat(F.lit(" "), x[f])).otherwise("")
        return F.concat(F.lit("【《"), F.coalesce(x["law_name"], F.lit(V.UNKNOWN_LAW)), F.lit("》"), more("chapter"), more("article"), F.lit("】\n"), or_empty(x["content"]), F.lit("\n"))

    head = F.array(F.concat(F.lit(a), or_empty(question), F.lit(b)))
    return F.array_join(F.concat(head, F.transform(col(results), entry), F.array(F.lit(c))), "\n")


def law_match(a_law: Column, a_article: Column, b_law: Column, b_article: Column) -> Column:
    """Whether two citations mean one article: equal numbers, and one name within the other (an empty one is in all)."""
    return (a_article == b_article) & (F.contains(a_law, b_law) | F.contains(b_law, a_law))
