"""JSON arrays of any size: read by many tasks, written as one file.

Reading. The text reader cuts a file behind every ``}`` (its line separator) and splits it by byte ranges like any text, so one array
is read by as many tasks as it has splits, from any file system that Spark reads. Where a split begins inside a string or a
nested object is not known there; so a first pass sums up each split for both cases (begun inside a string or not): whether
it ends inside a string, and how deep it goes. Splits are a row each; their sums in order give every split its true state. A
second pass takes records out where they stand at the top level alone; a record that several splits share is put together.

Writing. Records are serialised where they are, go in order through a range exchange, and one task streams them into one
file, which appears under its name only when that task has been committed. A task that is tried again starts a new file.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut, drop_path

#: A JSON string, and the rest of one that has begun before.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_REST = r'^(?:[^"\\]++|\\.)*+"'
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}\[\],]', re.S)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """_file, _split (where its split begins), value: what stands between the braces, in the order of the file within a task."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), "value")


def _sum(value: Column, inside: bool) -> tuple[Column, Column]:
    """(whether a piece ends inside a string, how much deeper) if it begins inside one or not."""
    open_ = F.lit(False)
    if inside:
        open_ = ~value.rlike(f"(?s){_REST}")
        value = F.when(open_, "").otherwise(F.regexp_replace(value, f"(?s){_REST}", ""))
    bare = F.regexp_replace(value, f"(?s){_STRING}", "")
    ends = open_ | F.contains(bare, F.lit('"'))
    bare = F.substring_index(bare, '"', 1)
    count = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
    # the brace behind the piece closes an object, unless it stands in a string
    return ends, (count("{") + count("[") - count("]") - count("}") - F.when(ends, 0).otherwise(1)).cast("long")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a split, and again wherever its rows go on in another batch's turn: the pieces' sums, one behind the other."""
    now = None

    def row() -> pa.RecordBatch:
        (file, split), (inside, outside), head = now
        return pa.RecordBatch.from_pylist([{"_file": file, "_split": split, "i_in": inside[0], "i_deep": inside[1], "o_in": outside[0], "o_deep": outside[1], "head": head}], schema=_SUMS)

    for b in batches:
        for file, split, o_in, o_deep, i_in, i_deep, head in zip(*[c.to_pylist() for c in b.columns]):
            if now is None or now[0] != (file, split):
                if now is not None:
                    yield row()
                now = ((file, split), [(True, 0), (False, 0)], "")
            either = ((o_in, o_deep), (i_in, i_deep))
            now = (now[0], [(either[s][0], d + either[s][1]) for s, d in now[1]], now[2] or head)
    if now is not None:
        yield row()


_SUMS = pa.schema([("_file", pa.string()), ("_split", pa.int64()), ("i_in", pa.bool_()), ("i_deep", pa.int64()), ("o_in", pa.bool_()), ("o_deep", pa.int64()), ("head", pa.string())])
_FRAGMENTS = pa.schema([("_file", pa.string()), ("_split", pa.int64()), ("k", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("array", pa.bool_()), ("value", pa.string()), ("n", pa.int64())])


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and parts of records of each split: ``k`` counts the places at the top level that the split has begun before it; a row
    without a value says how many it has begun (``n``)."""
    now, inside, depth, base, k, held, taking, opens = None, False, 0, 0, 0, [], False, False
    out: list[dict] = []

    def add(closes: bool, array: bool = False) -> None:
        if not (array and opens):  # an array that other splits have begun must be known there
            out.append({"_file": now[0], "_split": now[1], "k": k, "opens": opens, "closes": closes, "array": array, "value": "".join(held), "n": None})
        held.clear()

    def leave() -> None:
        if taking:
            add(False)
        out.append({"_file": now[0], "_split": now[1], "n": k})

    for b in batches:
        for file, split, value, s_in, s_deep, lines in zip(*[c.to_pylist() for c in b.columns]):
            if now != (file, split):
                if now is not None:
                    leave()
                now, inside, depth, base, k, opens = (file, split), s_in, s_deep, 0 if lines else 1, 0, False
                taking = depth > base
            text, at = value + "}", 0
            if inside:
                end = re.match(r'(?:[^"\\]|\\.)*"', value, re.S)
                if end is None:
                    if taking:
                        held.append(text)
                    continue
                at, inside = end.end(), False
            kept = 0
            for t in _TOKEN.finditer(text, at):
                c = t[0]
                if c[0] == '"':
                    # the brace that was added may stand in a string that the piece leaves open
                    inside = not re.fullmatch(_STRING, c, re.S)
                elif c == "{" or c == "[":
                    if depth == base and (c == "{" or not lines):
                        kept, taking, opens = t.start(), True, True
                    depth += 1
                elif c == ",":
                    k += depth == base and not lines
                else:
                    depth -= 1
                    if depth == base and taking:
                        held.append(text[kept : t.end()])
                        add(True, c == "]")
                        taking = opens = False
                        k += bool(lines)
            if taking:
                held.append(text[kept:])
            if len(out) >= 1_000:
                yield pa.RecordBatch.from_pylist(out, schema=_FRAGMENTS)
                out.clear()
    if now is not None:
        leave()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_FRAGMENTS)


def records(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """pos, value: the objects of JSON arrays, or of files of JSON lines, as texts.

    ``path`` is a file, a folder or a glob. Files go by their paths and ``pos`` counts through all of them: an array's places, or a
    file's objects. Elements that aren't objects have a place but no row; an empty file has none. A byte-order mark is skipped.
    ``split_bytes``: how much of a file one task reads (by default what the session says). Whole files never meet in a task.
    """
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        # both passes, which are written here, must see the same splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", before if split_bytes is None else str(split_bytes))
        states, parts = _passes(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return _placed(states, parts)


def _passes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(the state that each split begins in, the written records and parts of records)."""
    pieces = _pieces(spark, path)
    (o_in, o_deep), (i_in, i_deep) = _sum(F.col("value"), False), _sum(F.col("value"), True)
    head = F.regexp_extract("value", r"(?s)^[\s\x{FEFF}]*(\S)", 1)
    small = pieces.select("_file", "_split", o_in.alias("o_in"), o_deep.alias("o_deep"), i_in.alias("i_in"), i_deep.alias("i_deep"), head.alias("head"))
    sums = cut(small.mapInArrow(_summed, "_file string, _split long, i_in boolean, i_deep long, o_in boolean, o_deep long, head string"), "json-splits")
    # a row a split from here on
    step = lambda a, x: F.struct(F.when(a["inside"], x["i_in"]).otherwise(x["o_in"]).alias("inside"), (a["depth"] + F.when(a["inside"], x["i_deep"]).otherwise(x["o_deep"])).alias("depth"), F.array_append(a["states"], F.struct(x["_split"].alias("_split"), a["inside"].alias("inside"), a["depth"].alias("depth"))).alias("states"))
    none = F.array().cast("array<struct<_split:long,inside:boolean,depth:long>>")
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("depth"), none.alias("states"))
    in_order = F.sort_array(F.collect_list(F.struct("_split", "i_in", "i_deep", "o_in", "o_deep", "head")))
    states = sums.groupBy("_file").agg(in_order.alias("splits")).select("_file", (F.coalesce(F.filter("splits", lambda x: x["head"] != "")[0]["head"], F.lit("[")) != "[").alias("lines"), F.aggregate("splits", start, step)["states"].alias("states"))
    states = states.select(F.col("_file").alias("_f"), "lines", F.inline("states")).withColumnRenamed("_split", "_s")
    begun = pieces.join(F.broadcast(states), (F.col("_file") == F.col("_f")) & (F.col("_split") == F.col("_s"))).select("_file", "_split", "value", "inside", "depth", "lines")
    parts = cut(begun.mapInArrow(_taken, "_file string, _split long, k long, opens boolean, closes boolean, array boolean, value string, n long"), "json-records")
    return states, parts


def _placed(states: DataFrame, parts: DataFrame) -> DataFrame:
    """pos and value of all records; those that several splits share are put together."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = parts.where(F.col("n").isNotNull()).groupBy("_file", "_split").agg(F.sum("n").alias("n"))
    # an array of n commas has n + 1 places, if it has any element
    last = states.groupBy("_f").agg(F.max("_s").alias("_s"), F.max(F.when(F.col("lines"), 0).otherwise(1)).alias("more"))
    filled = parts.where(F.col("value").isNotNull()).groupBy(F.col("_file").alias("_f")).agg(F.lit(1).alias("some"))
    more = last.join(filled, "_f", "left").select("_f", "_s", (F.col("more") * F.coalesce("some", F.lit(0))).alias("more"))
    counts = counts.join(more, (F.col("_file") == F.col("_f")) & (F.col("_split") == F.col("_s")), "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0)))
    counts = counts.select(F.col("_file").alias("_f"), F.col("_split").alias("_s"), before.alias("before"))
    placed = parts.where(F.col("value").isNotNull()).join(F.broadcast(counts), (F.col("_file") == F.col("_f")) & (F.col("_split") == F.col("_s"))).withColumn("pos", F.col("before") + F.col("k"))
    whole = placed.where(F.col("opens") & F.col("closes")).select("pos", "value")
    shared = placed.where(~(F.col("opens") & F.col("closes"))).groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("_split", "value"))).alias("parts"), F.max("array").alias("array")).where("NOT array")
    return whole.unionAll(shared.select("pos", F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value")))


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    line = lambda values: pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])
    yield line(["["])
    first = True
    for b in batches:
        if b.num_rows:
            values = b.column(0).to_pylist()
            yield line([values[0] if first else f",{values[0]}", *[f",{v}" for v in values[1:]]])
            first = False
    yield line(["]"])


def write_array(df: DataFrame, path: str, order: str | None = None, keep_order: bool = True) -> None:
    """``df`` as one JSON array in the file ``path``, in order of a column if named (nulls first, then by the records' texts).

    The order's column is written too, unless ``keep_order`` is False. What is there is replaced. Null fields are left out, as
    Spark's JSON writer does; a table without rows is an empty array. An error leaves neither the file nor its parts.
    """
    fields = [F.col(f"`{c}`") for c in df.columns if keep_order or c != order]
    rows = df.select(F.to_json(F.struct(*fields)).alias("value"), *([F.col(order).alias("_order")] if order else []))
    if order:
        rows = rows.repartitionByRange(F.asc_nulls_first("_order"), "value").sortWithinPartitions(F.asc_nulls_first("_order"), "value").select("value")
    # one task takes the sorted parts one after the other
    _one_file(rows.coalesce(1).mapInArrow(_bracketed, "value string"), path, "[]")


def write_file(spark: SparkSession, text: str, path: str) -> None:
    """A text as one file."""
    _one_file(spark.range(1).select(F.lit(text).alias("value")), path, "")


def _one_file(lines: DataFrame, path: str, empty: str) -> None:
    """Lines of one task as a file that appears once that task is committed; ``empty``: what it holds if there was no task."""
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs, made = at(path).getFileSystem(conf), f"{path}.writing-{uuid.uuid4().hex}"

    def part():
        found = [s.getPath() for s in fs.listStatus(at(made)) if s.getPath().getName().startswith("part-") and s.getLen()]
        return found[0] if found else None

    try:
        lines.coalesce(1).write.text(made)
        if part() is None:
            drop_path(spark, made)
            spark.range(1).select(F.lit(empty).alias("value")).coalesce(1).write.text(made)
        fs.delete(at(path), True)
        if not fs.rename(part(), at(path)):
            raise OSError(f"{path} could not be written")
    finally:
        drop_path(spark, made)
