"""Secrets in texts, in DataFrame functions only: fixed formats, and strings whose sliding windows are nearly random.

Base spans follow three fixed formats. Beside them, every run of ``RUN`` letters, digits and ``+/_-`` is walked once: a window of ``WINDOW``
letters slides along it, and the count of the letter that leaves and of the one that comes in change the window's sum of
c * log2(c), from which its Shannon entropy follows. Nothing is counted anew, so a run costs its length, however long it is. Sums
are whole numbers (2^20 to the unit), so a window's entropy doesn't depend on the way there. What a window must reach depends on its
class of characters: hexadecimal digits only, letters and digits, or signs too. Windows that reach it and overlap or touch make one
span. The allow-list then takes out what looks random and isn't secret: unique ids, check sums by name, paths and slugs, addresses,
embedded data, counting sequences and placeholders. Base spans are never taken out, and no added span overlaps one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names
from .pii import _located, _spread

KINDS = ("assign", "access", "hex")
ADDED = "entropy"
_ASSIGN = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Of the last two a run is taken whole or not at all, so their least lengths can stand in the pattern.
BASE = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]{14,}+", "hex": "[0-9a-f]{16,}+"}
_NEEDS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA", "hex": "(?<![0-9a-f])[0-9a-f]{16}"}
#: Letters of the value that an assignment must have.
VALUE = 12
WINDOW = 20
_SET = "A-Za-z0-9+/_-"
RUN = rf"[{_SET}]{{{WINDOW},}}+"
#: The alphabet in groups: digits, other hexadecimal digits, other lower case, the same two of upper case, signs.
_ALPHABET = "0123456789" + "abcdef" + "ghijklmnopqrstuvwxyz" + "ABCDEF" + "GHIJKLMNOPQRSTUVWXYZ" + "+/_-"
_DIGITS, _HEX_LOW, _LOW, _HEX_UP, _UP = 10, 16, 36, 42, 62
#: Bits of entropy that a window of each class must reach: hexadecimal, letters and digits, with signs.
BITS = {"hex": 3.0, "alnum": 3.7, "signs": 4.0}
#: Digits and letters that a window must hold.
LEAST_DIGITS, LEAST_LETTERS = 2, 4
_UNIT = 1 << 20
#: What is no secret, by a pattern of the span's text.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # unique ids
    r"(?i)^(?:sha|md)[0-9]{1,3}[-_]",  # check sums by name
    r"(?:^|[/_-])[a-z]{3,}[/_-](?:.*[/_-])?[a-z]{3,}(?:[/_-]|$)",  # paths and slugs
    r"(?i)0123456|1234567|abcdefg|qwerty|zyxwvu|7654321",  # sequences
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]|xxxx|test[_-]|([a-z0-9])\1{5}",  # placeholders
)
#: What is no secret, by the 32 letters before its run: addresses and embedded data.
ALLOW_BEHIND = (r"[a-z]://[^\s\"'<>]*$", r"base64,$")


def _check(kind: str):
    if kind == "assign":
        return lambda x: F.length(F.regexp_extract(x["m"], _ASSIGN, 1)) >= VALUE
    return lambda x: F.lit(True)


def base_spans(df: DataFrame) -> DataFrame:
    """Adds one array column a kind: (start, end, match) of the base matches that are long enough."""
    for kind in KINDS:
        need = F.contains(F.col("text"), F.lit(_NEEDS[kind])) if kind == "access" else F.col("text").rlike(_NEEDS[kind])
        df = _located(df, f"base_{kind}", BASE[kind], need)
        if kind == "assign":
            df = df.withColumn(f"base_{kind}", F.filter(f"base_{kind}", _check(kind)))
    return df


def _weights() -> Column:
    return F.array(*[F.lit(round(c * math.log2(c) * _UNIT) if c else 0).cast("long") for c in range(WINDOW + 1)])


def limit(bits: float) -> int:
    """The largest sum of c * log2(c), in whole units, of a window with ``bits`` of entropy."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * _UNIT)


def windows(run: Column) -> Column:
    """array<struct<s, e>>: joined windows of a run of the alphabet that reach their class's entropy, as offsets.

    The fold goes over the letters that come in and leave; its state has a count a letter (as a string of one character a letter of
    the alphabet), the window's sum, how many digits, letters, signs and other than hexadecimal digits it holds, and the spans.
    """
    none = F.array().cast("array<struct<s:int,e:int>>")
    number = lambda n: F.lit(n).cast("int")
    state = {"counts": F.lit("0" * len(_ALPHABET)), "total": F.lit(0).cast("long"), "digits": number(0), "signs": number(0), "wide": number(0), "s": number(-1), "e": number(-1), "done": none}

    def moves(codes: Column) -> Column:
        come = lambda c, i: F.struct(c.alias("c"), number(1).alias("d"), (i + 1).alias("p"))
        leave = lambda i: F.struct(F.get(codes, i - WINDOW).alias("c"), number(-1).alias("d"), (i + 1).alias("p"))
        return F.flatten(F.transform(codes, lambda c, i: F.when(i >= WINDOW, F.array(leave(i), come(c, i))).otherwise(F.array(come(c, i)))))

    def move(a: Column, x: Column) -> Column:
        n = F.ascii(F.substr(a["counts"], x["c"], F.lit(1))) - 48
        weights, c, d = _weights(), x["c"], x["d"]
        one = lambda yes: F.when(yes, d).otherwise(0)
        total = a["total"] + F.get(weights, n + d) - F.get(weights, n)
        return F.struct(
            F.overlay(a["counts"], F.char(n + d + 48), c, F.lit(1)).alias("counts"),
            total.alias("total"),
            (a["digits"] + one(c <= _DIGITS)).alias("digits"),
            (a["signs"] + one(c > _UP)).alias("signs"),
            (a["wide"] + one((c > _HEX_LOW) & ((c <= _LOW) | (c > _HEX_UP)))).alias("wide"),
            a["s"].alias("s"), a["e"].alias("e"), a["done"].alias("done"), x["p"].alias("p"), (d > 0).alias("whole"),
        )

    def reached(a: Column) -> Column:
        most = F.when(a["wide"] == 0, limit(BITS["hex"])).when(a["signs"] == 0, limit(BITS["alnum"])).otherwise(limit(BITS["signs"]))
        return a["whole"] & (a["p"] >= WINDOW) & (a["total"] <= most) & (a["digits"] >= LEAST_DIGITS) & (WINDOW - a["digits"] - a["signs"] >= LEAST_LETTERS)

    def noted(a: Column) -> Column:
        """The state with its spans brought up to date."""
        open_ = (a["s"] >= 0) & (a["e"] >= a["p"] - WINDOW)
        closed = F.when((a["s"] >= 0) & ~open_, F.array_append(a["done"], F.struct(a["s"].alias("s"), a["e"].alias("e")))).otherwise(a["done"])
        kept = [a[f].alias(f) for f in ("counts", "total", "digits", "signs", "wide")]
        yes = F.struct(*kept, F.when(open_, a["s"]).otherwise(a["p"] - WINDOW).alias("s"), a["p"].alias("e"), closed.alias("done"))
        return F.when(reached(a), yes).otherwise(F.struct(*kept, *[a[f].alias(f) for f in ("s", "e", "done")]))

    step = lambda a, x: F.transform(F.array(move(a, x)), noted)[0]
    last = lambda a: F.when(a["s"] >= 0, F.array_append(a["done"], F.struct(a["s"].alias("s"), a["e"].alias("e")))).otherwise(a["done"])
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    every = F.transform(F.array(codes), moves)[0]
    return F.aggregate(every, F.struct(*[v.alias(k) for k, v in state.items()]), step, last)


def _allowed(text: Column, behind: Column) -> Column:
    out = F.lit(False)
    for p in ALLOW:
        out = out | text.rlike(p)
    for p in ALLOW_BEHIND:
        out = out | behind.rlike(p)
    return out


def candidates(df: DataFrame) -> DataFrame:
    """Adds ``random``: (k, s, e, p) of the runs' parts that reach their entropy and aren't on the allow-list."""
    columns = df.columns
    df = _located(df, "_runs", RUN, F.col("text").rlike(rf"(?<![{_SET}])[{_SET}]{{{WINDOW}}}"), around=True)
    worth = lambda x: x["m"].rlike("[0-9].*[0-9]") & x["m"].rlike("[A-Za-z].*[A-Za-z].*[A-Za-z].*[A-Za-z]")
    ahead = lambda i, f: F.coalesce(F.right(F.get("_runs", i)[f], F.lit(32)), F.lit(""))
    # a run has 20 letters at least, so two runs and the gaps behind them hold the 32 letters before the next
    behind = lambda x, i: F.right(F.concat(ahead(i - 2, "m"), ahead(i - 1, "b"), ahead(i - 1, "m"), x["b"]), F.lit(32))
    df = df.withColumn("_runs", F.filter(F.transform("_runs", lambda x, i: F.struct(x["s"].alias("s"), x["m"].alias("m"), behind(x, i).alias("b"))), worth))
    df = df.withColumn("_found", F.transform("_runs", lambda x: F.struct(x["s"].alias("s"), x["b"].alias("b"), x["m"].alias("m"), windows(x["m"]).alias("at"))))

    def shown(x: Column) -> Column:
        parts = F.filter(x["at"], lambda w: ~_allowed(F.substr(x["m"], w["s"] + 1, w["e"] - w["s"]), x["b"]))
        return F.transform(parts, lambda w: F.struct(F.lit(len(KINDS)).alias("k"), (x["s"] + w["s"]).alias("s"), (x["s"] + w["e"]).alias("e"), F.lit(0.0).alias("p")))

    return df.select(*columns, F.flatten(F.transform("_found", shown)).alias("random"))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with base_assign, base_access, base_hex (start, end, match) and ``added`` (k, s, e, p: kind number 3, start, end, 0).

    A null text counts as empty and has no spans. Added spans overlap no base span nor each other. One narrow pass without an
    exchange; rows that repeat are each searched; an empty table gives an empty one. Input columns of these four names are
    replaced, all others stay, whatever their names.
    """
    made = [*(f"base_{k}" for k in KINDS), "added"]
    others = [c for c in docs.columns if c.lower() not in {*made, "text"}]
    (packed,) = fresh_names(docs, 1)
    packs = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    df = candidates(base_spans(docs.select(packs.alias(packed), F.coalesce("text", F.lit("")).alias("text"))))
    ends = lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))
    bases = F.concat(*[F.transform(f"base_{k}", ends) for k in KINDS])
    df = df.withColumn("added", F.when(F.size("random") > 0, _spread(F.col("random"), bases)).otherwise(F.col("random")))
    kept = {c.lower(): F.col(f"{packed}.`{c}`").alias(c) for c in others}
    return df.select(*[F.col("text") if c.lower() == "text" else kept[c.lower()] for c in docs.columns if c.lower() not in set(made)], *made)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans (kind:start:end by start, then kind)."""
    of = lambda k, c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    names = F.array(*[F.lit(k) for k in (*KINDS, ADDED)])
    spelled = lambda spans: F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.concat(*[of(i, f"base_{k}") for i, k in enumerate(KINDS)])
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.concat(base, of(len(KINDS), "added"))).alias("spans"))
