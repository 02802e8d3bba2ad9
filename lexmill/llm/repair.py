"""Repair of conversations by their cheapest edits: a dynamic program as a higher-order fold in Spark SQL.

Roles must read ``(s?(ua)+)?`` by their initials in the end. A row can be kept (0), given the role user or assistant (3) or deleted
(4; blank rows and repeats must be), and rows without text can be inserted anywhere (3); a row that isn't deleted and breaks off costs 3
more. The fold carries the cheapest (cost, edits) that end in each of four states: nothing yet, behind a system row, behind a
user row, behind an assistant row. ``least`` over structs takes the smaller cost, then the edits that come first in ASCII order.
Of two ways to one state at equal cost neither opens with all of the other (what is over would be insertions, which cost), so
the order of what follows never turns.

Windows flag repeats. Turns are collected in blocks of ``BLOCK`` turn numbers, so a conversation of any length is many blocks, and
a block is folded from each of the four states; a second fold, over a conversation's blocks, joins those up. Equal rows of one turn are
merged with their number before anything is exchanged, as all but the first must be deleted. The hash of a repaired text is
read off its blocks in order, one block in memory at a time. Rows of one turn (or of none) with different texts share a
block. What stays in one cell is the list of edits, a letter a row, as the result has it.

Letters of an edit list: D delete, E delete another equal row, I and J insert user and assistant, K keep, R and S give the role user
and assistant. Its order is that of the initials D, I, K and R, since the state tells I from J and R from S.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_names, lean

#: Turn numbers of a block, as a power of two.
BLOCK_BITS = 8
KEEP, ROLE, DELETE, INSERT, BROKEN = 0, 3, 4, 3, 3
STATES = ("nothing", "system", "user", "assistant")
_NEVER = 1 << 40
BLANK = r"[^\x20\x09-\x0D]"
_LAST = r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``turns`` with faults by crc32('conv_id:turn') % 20.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's.
    A null is one space, in the key and as a role or text; a null turn or conversation stays null in the result.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).where("fault != 0")
    changed = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), F.explode(times).alias("_time")).drop("_time")


def flagged(turns: DataFrame) -> DataFrame:
    """conv_id, key, turn, role, text, n, fault of the different rows: n equal ones, and the first fault of the first of them.

    Faults: 1 blank, 2 a repeat of an earlier row's role and text, 3 broken off, 0 none. ``key`` is the conversation's id as text, 'n' for
    a null one, 'c' before others.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("key")
    rows = turns.select("conv_id", key, F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    rows = rows.groupBy("key", "turn", "role", "text").agg(F.first("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    seen = F.row_number().over(Window.partitionBy("key", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(~F.col("text").rlike(BLANK), 1).when(seen, 2).when(~F.regexp_extract("text", _LAST, 1).isin(".", "!", "?"), 3).otherwise(0)
    return rows.select("conv_id", "key", "turn", "role", "text", "n", fault.cast("int").alias("fault"))


def _way(cost: Column, plan: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), plan.alias("plan"))


def _on(way: Column, cost: Column | int, letters: Column | str) -> Column:
    """``way`` with one more edit."""
    return _way(way["cost"] + cost, F.concat(way["plan"], F.lit(letters) if isinstance(letters, str) else letters))


def _with_inserts(nothing: Column, system: Column, user: Column, assistant: Column) -> Column:
    """The four ways, where insertions behind them are cheaper or come first."""
    user = F.least(user, _on(F.least(nothing, system, assistant), INSERT, "I"))
    whole = lambda u: F.struct(nothing.alias("nothing"), system.alias("system"), u.alias("user"), F.least(assistant, _on(u, INSERT, "J")).alias("assistant"))
    return F.transform(F.array(user), whole)[0]


def _edited(ways: Column, row: Column) -> Column:
    """The four ways behind one more (merged) row."""
    must, initial = row["fault"].isin(1, 2), F.substring(row["role"], 1, 1)
    more, others = (row["n"] - 1) * DELETE, F.repeat(F.lit("E"), (row["n"] - 1).cast("int"))
    broken = F.when(row["fault"] == 3, BROKEN).otherwise(0)
    never = F.lit(_NEVER)
    open_ = F.least(ways["nothing"], ways["system"], ways["assistant"])

    def on(way: Column, cost: Column | int, letter: str) -> Column:
        return _on(way, F.lit(cost) + more if isinstance(cost, int) else cost + more, F.concat(F.lit(letter), others))

    kept = lambda way, at: on(way, F.when(must | (initial != at), never).otherwise(F.lit(KEEP) + broken), "K")
    given = lambda way, letter: on(way, F.when(must, never).otherwise(F.lit(ROLE) + broken), letter)
    deleted = {s: on(ways[s], DELETE, "D") for s in STATES}
    return _with_inserts(
        deleted["nothing"],
        F.least(deleted["system"], kept(ways["nothing"], "s")),
        F.least(deleted["user"], kept(open_, "u"), given(open_, "R")),
        F.least(deleted["assistant"], kept(ways["user"], "a"), given(ways["user"], "S")),
    )


def _from(state: str) -> Column:
    """The four ways before any row, from a state."""
    way = lambda s: _way(F.lit(0 if s == state else _NEVER), F.lit(""))
    return _with_inserts(*[way(s) for s in STATES])


def _illegal(a: Column, b: Column) -> Column:
    """1 where the initials of two neighbours aren't system-user, user-assistant or assistant-user."""
    return F.when(F.concat(a, b).isin("su", "ua", "au"), 0).otherwise(1)


def blocks(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """A row a block of ``flagged`` rows: its turns in order, its counts, and ``ways``: for each start, the cheapest way to each end."""
    block = F.coalesce(F.shiftright("turn", bits), F.lit(-(1 << 63)))
    turn = F.struct("turn", "role", "text", "n", "fault")
    n = lambda f: F.sum(F.when(F.col("fault") == f, F.col("n") if f == 1 else F.lit(1)).otherwise(0)).alias(f"n{f}")
    # of equal rows all but the first are repeats, unless blank
    again = F.sum(F.when(F.col("fault") == 1, 0).otherwise(F.col("n") - 1)).alias("again")
    counts = [n(1), n(2), n(3), again, F.sum(F.col("n") - 1).alias("pairs"), F.min("turn").alias("low"), F.max("turn").alias("high")]
    g = rows.withColumn("block", block).groupBy("key", "block").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("turns"), *counts)
    initials = F.transform("turns", lambda t: F.substring(t["role"], 1, 1))
    small = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["n"].alias("n"), t["fault"].alias("fault")))
    g = g.withColumns({"initials": initials, "_small": small})
    inner = F.zip_with(F.slice("initials", F.lit(1), F.size("initials") - 1), F.slice("initials", F.lit(2), F.size("initials")), _illegal)
    illegal = F.aggregate(inner, F.lit(0), lambda a, v: a + v) + F.col("pairs")
    ways = F.transform(F.array(*[_from(s) for s in STATES]), lambda start: F.aggregate("_small", start, _edited))
    return g.select(
        "conv_id", "key", "block", "turns", ways.alias("ways"), F.col("n1").alias("blank"), (F.col("n2") + F.col("again")).alias("duplicate"), F.col("n3").alias("truncated"), illegal.cast("long").alias("illegal"),
        F.element_at("initials", 1).alias("first"), F.element_at("initials", -1).alias("last"), "low", "high", F.size(F.array_distinct(F.filter(F.transform("turns", lambda t: t["turn"]), lambda t: t.isNotNull()))).alias("distinct"),
    )


def _joined(ways: Column, block: Column) -> Column:
    """The four ways through one more block; ``ends``: the length of the edits behind each block."""

    def through(end: str) -> Column:
        added = [block["ways"][k][end] for k in range(len(STATES))]
        each = [F.struct((ways[s]["cost"] + b["cost"]).alias("cost"), F.concat(ways[s]["plan"], b["plan"]).alias("plan"), ways[s]["ends"].alias("ends")) for s, b in zip(STATES, added)]
        return F.transform(F.array(F.least(*each)), lambda w: F.struct(w["cost"].alias("cost"), w["plan"].alias("plan"), F.array_append(w["ends"], F.length(w["plan"])).alias("ends")))[0]

    return F.struct(*[through(s).alias(s) for s in STATES])


def chosen(parts: DataFrame) -> DataFrame:
    """A row a conversation: its counts, cost, audit, and ``pieces``: (block, edits of the block)."""
    of = F.struct("block", "ways", "first", "last")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "distinct")]
    g = parts.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(of)).alias("parts"), *sums, F.min("low").alias("low"), F.max("high").alias("high"))
    between = F.zip_with(F.slice("parts", F.lit(1), F.size("parts") - 1), F.slice("parts", F.lit(2), F.size("parts")), lambda a, b: _illegal(a["last"], b["first"]))
    start = lambda s: F.struct(F.lit(0 if s == "nothing" else _NEVER).cast("long").alias("cost"), F.lit("").alias("plan"), F.array().cast("array<int>").alias("ends"))
    best = F.aggregate("parts", F.struct(*[start(s).alias(s) for s in STATES]), _joined, lambda w: F.least(w["nothing"], w["assistant"]))
    g = g.withColumn("best", best)
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.col("best.ends"), F.greatest(i, F.lit(1))))
    piece = lambda p, i: F.struct(p["block"].alias("block"), F.substring(F.col("best.plan"), begin(i) + 1, F.col("best.ends")[i] - begin(i)).alias("plan"))
    return g.select(
        "conv_id", "key", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        (F.col("illegal") + F.aggregate(between, F.lit(0), lambda a, v: a + v)).alias("illegal"), F.col("best.cost").alias("cost"), F.translate("best.plan", "EJS", "DIR").alias("audit"), F.transform("parts", piece).alias("pieces"),
    )


def _lines(turn: Column, edit: Column) -> Column:
    """What a row's edits make of it, as ``role:text``: rows inserted before it and the row itself, if it isn't deleted."""
    inserted = F.transform(F.regexp_extract_all(edit, F.lit("[IJ]"), F.lit(0)), lambda c: F.when(c == "I", "user:").otherwise("assistant:"))
    letter = F.regexp_extract(edit, "[DKRS]", 0)
    role = F.when(letter == "K", turn["role"]).when(letter == "R", "user").when(letter == "S", "assistant")
    return F.concat(inserted, F.when(role.isNotNull(), F.array(F.concat(role, F.lit(":"), turn["text"]))).otherwise(F.array().cast("array<string>")))


def repaired(parts: DataFrame, found: DataFrame) -> DataFrame:
    """key, block and ``lines`` (role:text of the repaired rows) of every block."""
    plans = found.select("key", F.explode("pieces").alias("p")).select("key", "p.block", "p.plan")
    edits = F.regexp_extract_all("plan", F.lit("[IJ]*[DKRS]E*|[IJ]+$"), F.lit(0))
    joined = parts.select("key", "block", "turns").join(plans, ["key", "block"])
    return joined.select("key", "block", F.flatten(F.zip_with("turns", edits, _lines)).alias("lines"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's lines, joined by newlines; rows come sorted by key, so one hash is open at a time."""
    now, state, begun = None, None, False
    for batch in batches:
        done = []
        for key, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != now:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state, begun = key, hashlib.sha256(), False
            for line in lines:
                state.update((b"\n" if begun else b"") + line.encode())
                begun = True
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done]), pa.array([h for _, h in done])], names=["key", "repaired_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["key", "repaired_sha256"])


def repair(turns: DataFrame, bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows by block) of conversations (conv_id, turn, role, text).

    The report has conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, a row a conversation; the other
    key, block and lines. Rows go by turn, nulls first, then by role and text; equal ones stand together. Null roles and texts are one
    space; a null conv_id is a conversation; an empty table has no conversations. Other columns of ``turns`` play no part.
    """
    lean(turns.sparkSession)
    parts = cut(blocks(flagged(turns), bits), "repair-blocks")
    found = cut(chosen(parts), "repair-plans")
    text = repaired(parts, found)
    hashed = text.repartition("key").sortWithinPartitions("key", "block").select("key", "lines").mapInArrow(_hashes, "key string, repaired_sha256 string")
    return found.drop("pieces").join(hashed, "key").drop("key"), text


def report(turns: DataFrame, ids: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """The report of ``repair`` for every different conv_id of ``ids``: zeros and an empty audit for one without rows in ``turns``."""
    found = repair(turns, bits)[0]
    (own,) = fresh_names(found, 1)
    every = ids.select(F.col("conv_id").alias(own)).distinct().join(found, F.col(own).eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(F.col(own).alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def oracle() -> str:
    """DuckDB SQL of damage and repair: the cheapest edits row by row in a recursive query over tables of moves."""
    return """
    WITH RECURSIVE
    raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    keys AS (SELECT k, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::BIGINT), lambda c, b:
        list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 20 AS m FROM (SELECT DISTINCT k FROM raw)),
    d AS (SELECT conv_id, turn, CASE m WHEN 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM raw JOIN keys USING (k), range(2) AS t(c) WHERE m <> 0 AND (c = 0 OR m = 3)),
    o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
    f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 2
            WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
            coalesce(lag(role[1] ) OVER w || role[1] NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o WINDOW w AS (PARTITION BY g ORDER BY i)),
    ops(was, op, now, price, needs) AS (VALUES ('n', 'D', 'n', 4, ''), ('s', 'D', 's', 4, ''), ('u', 'D', 'u', 4, ''), ('a', 'D', 'a', 4, ''), ('n', 'K', 's', 0, 's'), ('n', 'K', 'u', 0, 'u'), ('s', 'K', 'u', 0, 'u'), ('a', 'K', 'u', 0, 'u'),
        ('u', 'K', 'a', 0, 'a'), ('n', 'R', 'u', 3, ''), ('s', 'R', 'u', 3, ''), ('a', 'R', 'u', 3, ''), ('u', 'R', 'a', 3, '')),
    ins(was, more, now) AS (VALUES ('n', '', 'n'), ('s', '', 's'), ('u', '', 'u'), ('a', '', 'a'), ('n', 'I', 'u'), ('s', 'I', 'u'), ('a', 'I', 'u'), ('u', 'I', 'a'), ('n', 'II', 'a'), ('s', 'II', 'a')),
    dp AS (
        SELECT DISTINCT g, 0::BIGINT AS i, now AS st, 3 * length(more)::BIGINT AS cost, more::VARCHAR AS audit FROM o, ins WHERE was = 'n'
        UNION ALL
        SELECT g, i, st, cost, audit FROM (
            SELECT f.g, f.i, ins.now AS st, dp.cost + ops.price + (CASE WHEN fault = 3 AND op <> 'D' THEN 3 ELSE 0 END) + 3 * length(ins.more) AS cost, dp.audit || ops.op || ins.more AS audit
            FROM dp JOIN f ON f.g = dp.g AND f.i = dp.i + 1 JOIN ops ON ops.was = dp.st JOIN ins ON ins.was = ops.now
            WHERE (op = 'D' OR fault NOT IN (1, 2)) AND (op <> 'K' OR f.role[1] = needs))
        QUALIFY row_number() OVER (PARTITION BY g, i, st ORDER BY cost, audit) = 1),
    best AS (SELECT g, i AS n, cost, audit FROM dp SEMI JOIN (SELECT g, max(i) AS i FROM o GROUP BY g) USING (g, i) WHERE st IN ('n', 'a') QUALIFY row_number() OVER (PARTITION BY g ORDER BY cost, audit) = 1),
    e AS (SELECT g, p, audit[p] AS op, length(replace(audit[1:p], 'I', '')) AS i, length(replace(audit[1:p], 'D', '')) AS place FROM best, range(1, length(audit) + 1) AS t(p)),
    l AS (SELECT e.*, f.role, f.text, max(op = 'K' AND place = 1 AND f.role[1] = 's') OVER (PARTITION BY e.g) AS opens FROM e LEFT JOIN f ON f.g = e.g AND f.i = e.i AND op <> 'I'),
    h AS (SELECT g, string_agg((CASE WHEN op = 'K' THEN role WHEN (place - opens::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN op = 'I' THEN '' ELSE text END), chr(10) ORDER BY p) AS whole FROM l WHERE op <> 'D' GROUP BY g),
    c AS (SELECT g, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
            count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY g)
    SELECT r.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
        coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM raw) r LEFT JOIN c ON r.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.g = c.g LEFT JOIN h ON h.g = c.g"""
