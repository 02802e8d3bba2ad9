"""Law texts into chunks: metadata, header sections, articles, length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V

# The form of an article number, the headers' levels, and the separators in their order.
ARTICLE = rf"第[{V.NUMERALS}]+条"
LEVELS = (("# ", "law_name"), ("## ", "chapter"), ("### ", "section"), ("#### ", "subsection"))
SEPARATORS = ("\n\n", "\n", "。", "；", "，", " ", "")


def law_name(text: Column | str) -> Column:
    """What stands behind the first line-opening '#' (of a deeper header the rest of its marks too); null without one."""
    return F.nullif(X.strip(F.regexp_extract(X.col(text), rf"(?m)(?d)(?U)^#{X.SPACE}*(.+)$", 1)), F.lit(""))


def effective_date(text: Column | str) -> Column:
    """The first date like 2020年1月1日 among the first 500 letters, else the first like 2020-01-01; null without one."""
    head = F.substring(X.col(text), 1, 500)
    found = lambda p: F.nullif(F.regexp_extract(head, p, 1), F.lit(""))
    return F.coalesce(found(r"(?U)(\d{4}年\d{1,2}月\d{1,2}日)"), found(r"(?U)(\d{4}-\d{2}-\d{2})"))


def articles(text: Column | str) -> Column:
    """array<struct<content, article>>: the text cut before every article number, wherever it stands; what precedes the first
    has article ''. Pieces are stripped and empty ones left out; a text without numbers is one piece."""
    t = X.or_empty(text)
    pieces = F.transform(F.split(t, f"(?U)(?={ARTICLE})", -1), lambda p: F.struct(X.strip(p).alias("content"), F.regexp_extract(p, f"(?U)^({ARTICLE})", 1).alias("article")))
    return F.when(t.rlike(f"(?U){ARTICLE}"), F.filter(pieces, lambda p: p["content"] != "")).otherwise(F.array(F.struct(X.strip(t).alias("content"), F.lit("").alias("article"))))


def sections(text: str) -> list[dict]:
    """Sections of a Markdown text by its headers of up to four levels, each with the headers above it.

    A header ends the section before and all headers of its level and below; lines are stripped, joined by two spaces and a
    newline, and sections without text are left out. Lines in code fences are text.
    """
    out: list[dict] = []
    heads: dict[int, str] = {}
    lines: list[str] = []
    fence = ""

    def close() -> None:
        body = "  \n".join(x for x in lines if x)
        if body:
            out.append({"content": body, **{name: heads[k] for k, (_, name) in enumerate(LEVELS) if k in heads}})
        lines.clear()

    for line in text.split("\n"):
        s = line.strip()
        mark = s[:3]
        if mark in ("```", "~~~") and (not fence or fence == mark):
            fence = "" if fence or s.count(mark) > 1 else mark
        level = next((k for k, (p, _) in enumerate(LEVELS) if s.startswith(p)), None) if not fence else None
        if level is None:
            lines.append(s)
            continue
        close()
        for k in [k for k in heads if k >= level]:
            del heads[k]
        heads[level] = s[level + 1 :].strip()
    close()
    return out


def pieces(text: str, size: int = 512, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """A text in pieces of at most ``size`` letters: cut at the first separator it holds, pieces too long at the next ones, and
    neighbours joined while they fit, each piece opening with up to ``overlap`` letters of the one before."""
    k = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, rest = separators[k], separators[k + 1 :]
    if mark:
        first, *others = text.split(mark)
        parts = [p for p in [first, *(mark + o for o in others)] if p]
    else:
        parts = list(text)
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        joined, total, window = [], 0, []
        for p in held:
            if total + len(p) > size and window:
                joined.append("".join(window).strip())
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(window.pop(0))
            window.append(p)
            total += len(p)
        if window:
            joined.append("".join(window).strip())
        out.extend(j for j in joined if j)
        held.clear()

    for p in parts:
        if len(p) < size:
            held.append(p)
            continue
        flush()
        out.extend(pieces(p, size, overlap, rest) if rest else [p])
    flush()
    return out


def sections_of(text: Column | str) -> Column:
    """``sections`` as an expression: array<struct<content, law_name, chapter, section, subsection>>.

    A fold over the lines carries the open fence and the headers above, and notes where sections begin; their lines are cut out
    afterwards, so a section isn't copied line by line.
    """
    names = [n for _, n in LEVELS]
    lines = F.transform(F.split(X.or_empty(text), "\n", -1), lambda s: X.strip(s))
    none = F.lit(None).cast("string")
    heads = lambda values: F.struct(*[v.alias(n) for n, v in zip(names, values)])
    begin = F.array(F.struct(F.lit(0).alias("at"), heads([none] * len(names)).alias("heads")))
    start = F.struct(F.lit("").alias("fence"), begin.alias("begun"))

    def step(a: Column, x: Column) -> Column:
        s, mark = x["s"], F.substring(x["s"], 1, 3)
        turns = mark.isin("```", "~~~") & ((a["fence"] == "") | (a["fence"] == mark))
        closed = (a["fence"] != "") | (F.length(s) - F.length(F.replace(s, mark, F.lit(""))) > 3)
        fence = F.when(turns, F.when(closed, "").otherwise(mark)).otherwise(a["fence"])
        level = F.lit(None).cast("int")
        for k, (opening, _) in enumerate(LEVELS):
            level = F.when(F.startswith(s, F.lit(opening)), k).otherwise(level)
        above = F.element_at(a["begun"], -1)["heads"]
        title = X.strip(F.substr(s, F.length(F.regexp_extract(s, "^#+", 0)) + 1))
        found = heads([F.when(level > k, above[n]).when(level == k, title) for k, n in enumerate(names)])
        begun = F.when((fence == "") & level.isNotNull(), F.array_append(a["begun"], F.struct((x["i"] + 1).alias("at"), found.alias("heads")))).otherwise(a["begun"])
        return F.struct(fence.alias("fence"), begun.alias("begun"))

    def cut_out(both: Column) -> Column:
        rows, begun = both["lines"], both["begun"]
        last = lambda j: F.coalesce(F.get(begun, j + 1)["at"] - 1, F.size(rows))
        body = lambda m, j: F.array_join(F.filter(F.slice(rows, m["at"] + 1, F.greatest(last(j) - m["at"], F.lit(0))), lambda s: s != ""), "  \n")
        return F.filter(F.transform(begun, lambda m, j: F.struct(body(m, j).alias("content"), *[m["heads"][n].alias(n) for n in names])), lambda s: s["content"] != "")

    numbered = lambda rows: F.transform(rows, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    folded = lambda rows: F.struct(rows.alias("lines"), F.aggregate(numbered(rows), start, step, lambda a: a["begun"]).alias("begun"))
    return F.transform(F.transform(F.array(lines), folded), cut_out)[0]


def pieces_of(text: Column | str, size: int = 512, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """``pieces`` as an expression: one step a separator. Each step parts the texts that are still too long and hold the separator;
    a fold packs the parts, and a part that is too long itself starts the packing anew and waits for the next step."""
    item = lambda t, done: F.struct(t.alias("text"), done.alias("done"))
    nothing = F.array().cast("array<struct<text:string,done:boolean>>")
    words = F.array().cast("array<string>")

    def flushed(out: Column, window: Column) -> Column:
        joined = X.strip(F.array_join(window, ""))
        return F.when(joined != "", F.array_append(out, item(joined, F.lit(True)))).otherwise(out)

    def tail(window: Column, most: Column) -> Column:
        """The longest end of the window with at most ``most`` letters."""
        start = F.struct(words.alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def grow(a: Column, p: Column) -> Column:
            fits = a["open"] & (a["n"] + F.length(p) <= most)
            return F.struct(F.when(fits, F.array_prepend(a["kept"], p)).otherwise(a["kept"]).alias("kept"), F.when(fits, a["n"] + F.length(p)).otherwise(a["n"]).alias("n"), fits.alias("open"))

        return F.aggregate(F.reverse(window), start, grow, lambda a: F.struct(a["kept"].alias("kept"), a["n"].alias("n")))

    def packed(parts: Column, last: bool) -> Column:
        state = lambda out, window, n: F.struct(out.alias("out"), window.alias("window"), n.cast("int").alias("n"))

        def step(a: Column, p: Column) -> Column:
            n = F.length(p)
            alone = state(F.array_append(flushed(a["out"], a["window"]), item(p, F.lit(last))), words, F.lit(0))
            more = state(a["out"], F.array_append(a["window"], p), a["n"] + n)
            ends = F.transform(F.array(tail(a["window"], F.least(F.lit(overlap), size - n))), lambda t: state(flushed(a["out"], a["window"]), F.array_append(t["kept"], p), t["n"] + n))[0]
            return F.when(n >= size, alone).when((a["n"] + n > size) & (F.size(a["window"]) > 0), ends).otherwise(more)

        return F.aggregate(parts, state(nothing, words, F.lit(0)), step, lambda a: flushed(a["out"], a["window"]))

    def parted(t: Column, mark: str) -> Column:
        if not mark:
            return F.split(t, "")
        own = F.split(t, f"\\Q{mark}\\E", -1)
        return F.filter(F.transform(own, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(mark), p))), lambda p: p != "")

    items = F.array(item(X.or_empty(text), F.lit(False)))
    for k, mark in enumerate(separators):
        last = k == len(separators) - 1
        # the names of the loop are bound now, as the lambdas are called at once
        waits = lambda x: x["done"] | (F.lit(False) if last or not mark else ~F.contains(x["text"], F.lit(mark)))  # noqa: B023, E731
        items = F.flatten(F.transform(items, lambda x: F.when(waits(x), F.array(x)).otherwise(packed(parted(x["text"], mark), last))))  # noqa: B023
    return F.transform(items, lambda x: x["text"])


def split_documents(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks of ``docs`` (doc_id, content; source, law_name and effective_date are read off where they are missing).

    chunk_id counts a document's chunks by section, article and piece; a header's law name goes before the document's. Every step
    is an expression within the row: no exchange and no Python worker.
    """
    for name, made in (("source", F.lit("")), ("law_name", law_name("content")), ("effective_date", effective_date("content"))):
        if name not in docs.columns:
            docs = docs.withColumn(name, made)
    s = docs.select("doc_id", "source", F.col("law_name").alias("_law"), "effective_date", F.posexplode(sections_of("content")).alias("s_pos", "s"))
    a = s.select("doc_id", "source", "_law", "effective_date", "s_pos", "s", F.posexplode(articles(F.col("s.content"))).alias("a_pos", "a"))
    by_length = F.when(F.length("a.content") <= size, F.array("a.content")).otherwise(pieces_of("a.content", size, overlap))
    p = a.select("*", F.posexplode(by_length).alias("p_pos", "content"))
    number = (F.col("s_pos").cast("long") * F.lit(1 << 40)) + (F.col("a_pos").cast("long") * F.lit(1 << 20)) + F.col("p_pos").cast("long")
    return p.select("doc_id", number.alias("chunk_id"), "content", F.coalesce("s.law_name", "_law").alias("law_name"), "s.chapter", "s.section", "s.subsection", F.col("a.article").alias("article"), "effective_date", "source")


def chunks_per_law(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("law_name", F.lit(V.UNKNOWN_CHUNK_LAW)).alias("law_name")).agg(F.count(F.lit(1)).alias("n")).orderBy("law_name")


def laws(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("law_name") != "").select("law_name").distinct().orderBy("law_name")

