"""Personal data in texts, in DataFrame functions only: fixed formats, and candidates judged by boosted trees.

Base spans follow four fixed formats. Beside them, high-recall generators propose spans in other forms, each on its own, so
their spans may overlap: obfuscated mail addresses, IPv6 addresses, cards of 13 to 19 digits, national and international phone
numbers. Boosted trees judge each candidate by its format and the text around it. A candidate is added if it reaches the
calibrated threshold of its kind, overlaps no base span, and no more probable one overlaps it.

The trees are fitted on the driver on sentences that ``examples`` makes from templates, and on a bounded sample of places in the
documents (FIT_DOCS documents, FIT_SPANS places) that the base formats label: a base span's place, written in another form, is
personal data, and a number of a card's length that fails its check isn't. Thresholds are calibrated on such places of
documents that the trees haven't seen. Applying the trees is a CASE expression in SQL.

Positions: the parts of a text between its matches and the matches themselves alternate, so ends are the running sums of
their lengths. Running sums go in blocks of 256, so a text with very many matches costs n * 256, not n * n. Lengths are code
points. The patterns never go back over what they took (possessive), and start a match where the one before ended or no
letter of the run precedes, which gives the leftmost matches of the plain patterns without their quadratic retries.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import cut, fresh_names

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the search to be worth while.
_NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
_MAIL = rf"[{_LOCAL}]{{1,64}}+(?:\x20?(?:\(at\)|\[at\]|\{{at\}})\x20?|\x20at\x20|@)[A-Za-z0-9-]{{1,63}}+(?:(?:\x20?(?:\(dot\)|\[dot\]|\{{dot\}})\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{{1,63}}+){{1,8}}+"
_HEX = "[0-9A-Fa-f]{1,4}"
_IP6 = rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])"
_CARD = r"(?<![0-9A-Za-z])[0-9]{4}[\x20./-]?[0-9]{4,6}[\x20./-]?[0-9]{4,5}(?:[\x20./-]?[0-9]{1,7})?(?![0-9A-Za-z])"
_PHONE = r"(?<![0-9A-Za-z+])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])"
_ABROAD = r"(?<![0-9A-Za-z+])(?:\+|00)[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20./-]?[0-9]{2,4}){2,3}(?![0-9A-Za-z])"
#: Generators: (kind, pattern, what a text must contain for the search to be worth while).
GENERATORS = (
    (0, rf"(?:(?<![{_LOCAL}])|\G){_MAIL}", r"@|[\x20(\[{]at[\x20)\]}]"),
    (1, _IP6, r":[0-9A-Fa-f]{0,4}:"),
    (2, _CARD, r"[0-9]{4}[\x20./-]?[0-9]{4}"),
    (3, _PHONE, r"[0-9]{2}\)?[\x20./-][0-9]{3}"),
    (3, _ABROAD, r"(?:\+|00)[0-9]"),
)
FEATURES = ("kind", "length", "digits", "letters", "groups", "longest", "luhn", "before", "after", "context", "paren", "dots", "dashes", "spaces", "marks", "colons", "opens")
#: Bounds of the fit: documents drawn by a hash of their ids, bytes of one, places taken from them.
FIT_DOCS, FIT_TEXT_BYTES, FIT_SPANS = 4_000, 16_384, 6_000
#: Candidates beside an added one that are compared with it, on either side in order of starts: a span has 600 letters at most and
#: spans of one generator, at least 7 letters long, don't overlap.
_NEAR = 600 // 7 * len(GENERATORS)
_CONTEXT = (
    r"(?i)(?<![a-z])(?:e-?mail|mail|contact|write|reach)[^\n]{0,12}$",
    r"(?i)(?<![a-z])(?:ip|host|server|address|client|from)[^\n]{0,8}$",
    r"(?i)(?<![a-z])(?:card|visa|master|amex|credit|debit|payment|pay)[^\n]{0,12}$",
    r"(?i)(?<![a-z])(?:call|tel|phone|fax|mobile|cell|whatsapp|ring|dial)[^\n]{0,12}$",
    r"(?i)(?<![a-z])(?:order|invoice|ref|isbn|version|token|hash|price|total|serial|page|code|date|build|sku|part|score)[^\n]{0,12}$",
)
_BLOCK = 256


def _running(values: Column, op=lambda a, v: a + v, zero: int = 0) -> Column:
    """Running sums (or what ``op`` and its ``zero`` say) of an array of ints."""
    none = F.array().cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(_BLOCK)).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    inner = F.transform(blocks, lambda x: F.aggregate(x, none, lambda a, v: F.array_append(a, op(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(zero)), v))))
    offsets = lambda i: F.aggregate(F.transform(i, lambda x: F.element_at(x, -1)), F.array(F.lit(zero)), lambda a, v: F.array_append(a, op(F.element_at(a, -1), v)))
    joined = F.transform(F.array(inner), lambda i: F.flatten(F.zip_with(i, F.slice(offsets(i), F.lit(1), F.size(i)), lambda x, o: F.transform(x, lambda v: op(o, v)))))
    return joined[0]


def _located(df: DataFrame, name: str, pattern: str, needs: Column, around: bool = False) -> DataFrame:
    """Adds ``name``: array of (start, end, m) of a pattern's matches, with the text before and after each if asked for."""
    some = F.coalesce(needs, F.lit(False))
    df = df.withColumn("_hits", F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_parts", F.when(F.size("_hits") > 0, F.split("text", pattern, -1)).otherwise(F.array(F.lit(""))))
    lengths = F.zip_with(F.slice("_parts", F.lit(1), F.greatest(F.size("_hits"), F.lit(1))), "_hits", lambda p, h: F.length(p) + F.coalesce(F.length(h), F.lit(0)))
    df = df.withColumn("_ends", F.when(F.size("_hits") > 0, _running(lengths)).otherwise(F.array().cast("array<int>")))
    fields = lambda e, h: [(e - F.length(h)).alias("s"), e.alias("e"), h.alias("m")]
    if not around:
        spans = F.transform(F.arrays_zip(F.col("_ends").alias("e"), F.col("_hits").alias("h")), lambda x: F.struct(*fields(x["e"], x["h"])))
    else:
        zipped = F.arrays_zip(F.col("_ends").alias("e"), F.col("_hits").alias("h"), F.slice("_parts", F.lit(1), F.size("_hits")).alias("b"), F.slice("_parts", F.lit(2), F.size("_hits")).alias("a"))
        spans = F.transform(F.when(F.size("_hits") > 0, zipped).otherwise(F.slice(zipped, 1, 0)), lambda x: F.struct(*fields(x["e"], x["h"]), F.right(x["b"], F.lit(32)).alias("b"), F.substring(x["a"], 1, 2).alias("a")))
    return df.withColumn(name, spans).drop("_hits", "_parts", "_ends")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check; doubled places are every second from the right."""
    doubled = lambda c: F.when(c > 4, c * 2 - 9).otherwise(c * 2)
    each = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(each, lambda c, i: F.when(i % 2 == 1, doubled(F.coalesce(c.try_cast("int"), F.lit(0)))).otherwise(F.coalesce(c.try_cast("int"), F.lit(0)))),
        F.lit(0),
        lambda a, v: a + v,
    )
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    return n.between(8, 15)


def _check(kind: str):
    return lambda x: _valid(kind, x["m"])


def _spelled(kind: str):
    return lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))


def base_spans(df: DataFrame) -> DataFrame:
    """Adds one array column a kind: (start, end, match) of the base matches that pass their check."""
    for kind in KINDS:
        need = F.contains(F.col("text"), F.lit("@")) if kind == "email" else F.col("text").rlike(_NEEDS[kind])
        df = _located(df, f"base_{kind}", BASE[kind], need)
        df = df.withColumn(f"base_{kind}", F.filter(f"base_{kind}", _check(kind)))
    return df


def _is_base(m: Column) -> Column:
    return m.rlike(f"^(?:{BASE['email']})$") | (m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$") & _valid("ip", m)) | (m.rlike("^\\+") & _valid("phone", m)) | (m.rlike(f"^{BASE['card']}$") & _valid("card", m))


def _count(m: Column, pattern: str) -> Column:
    return F.regexp_count(m, F.lit(pattern))


def _features(x: Column) -> dict[str, Column]:
    m, side = x["m"], lambda c: F.when(c == "", 0).when(c.rlike(r"^[\x20\n\t,;:]"), 1).when(c.rlike("^[A-Za-z0-9]"), 2).otherwise(3)
    context = F.lit(0)
    for k in range(len(_CONTEXT) - 1, -1, -1):
        context = F.when(x["b"].rlike(_CONTEXT[k]), k + 1).otherwise(context)
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    return {
        "kind": x["k"],
        "length": F.length(m),
        "digits": F.length(_digits(m)),
        "letters": _count(m, "[A-Za-z]"),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)),
        "luhn": F.when(F.length(_digits(m)).between(13, 19) & _luhn(_digits(m)), 1).otherwise(0),
        "before": side(F.right(x["b"], F.lit(1))),
        "after": side(x["a"]),
        "context": context,
        "paren": _count(m, r"[()]"),
        "dots": _count(m, r"\."),
        "dashes": _count(m, "-"),
        "spaces": _count(m, r"\x20"),
        "colons": _count(m, ":"),
        "opens": F.when(m.rlike(r"^\+"), 1).when(m.rlike("^00"), 2).when(m.rlike(r"^\("), 3).otherwise(0),
        "marks": _count(m, r"\((?:at|dot)\)|\[(?:at|dot)\]|\{(?:at|dot)\}|\x20(?:at|dot)\x20"),
    }


def _judged_as(kind: int):
    def judged(x: Column) -> Column:
        found = _features(x.withField("k", F.lit(kind)))
        return F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.array(*[found[f].cast("int") for f in FEATURES]).alias("f"))

    return judged


def candidates(df: DataFrame) -> DataFrame:
    """Adds ``wide``: the generators' spans in other forms than the base ones, with kind ``k`` and features ``f`` (ints)."""
    columns = df.columns
    for g, (kind, pattern, need) in enumerate(GENERATORS):
        df = _located(df, f"_wide{g}", pattern, F.col("text").rlike(need), around=True)
        df = df.withColumn(f"_wide{g}", F.transform(F.filter(f"_wide{g}", lambda x: ~_is_base(x["m"])), _judged_as(kind)))
    return df.select(*columns, F.concat(*[F.col(f"_wide{g}") for g in range(len(GENERATORS))]).alias("wide"))


def _spread(spans: Column, bases: Column) -> Column:
    """Of ``spans`` (k, s, e, p) those that overlap none of ``bases`` (s, e), in order of starts.

    Both go in one order of starts; running maxima give the furthest end of a base before each span and the next start behind.
    """
    none = F.lit(-(1 << 30)).cast("int")
    shaped = lambda x, base: F.struct(x["s"].alias("s"), F.lit(base).alias("base"), x["e"].alias("e"), (F.lit(-1) if base else x["k"]).alias("k"), (F.lit(0.0) if base else x["p"]).alias("p"))
    every = F.sort_array(F.concat(F.transform(bases, lambda x: shaped(x, 1)), F.transform(spans, lambda x: shaped(x, 0))))
    larger = lambda a, v: F.greatest(a, v)
    ends = lambda c: _running(F.transform(c, lambda x: F.when(x["base"] == 1, x["e"]).otherwise(none)), larger, -(1 << 30))
    starts = lambda c: F.reverse(_running(F.transform(F.reverse(c), lambda x: F.when(x["base"] == 1, -x["s"]).otherwise(none)), larger, -(1 << 30)))
    marked = F.transform(F.array(every), lambda c: F.arrays_zip(c.alias("x"), ends(c).alias("end"), starts(c).alias("start")))[0]
    clear = F.filter(marked, lambda y: (y["x"]["base"] == 0) & (y["end"] <= y["x"]["s"]) & (-y["start"] >= y["x"]["e"]))
    return F.transform(clear, lambda y: F.struct(*[y["x"][f].alias(f) for f in ("k", "s", "e", "p")]))


def _best(spans: Column) -> Column:
    """Of spans in order of starts those that no more probable one overlaps (ties: the earlier, the longer, the kind listed first)."""
    rank = lambda x: F.struct(x["p"].alias("p"), (-x["s"]).alias("s"), x["e"].alias("e"), (-x["k"]).alias("k"))
    of = lambda c: F.filter(c, lambda x, i: ~F.exists(F.slice(c, F.greatest(i - _NEAR, F.lit(0)) + 1, F.lit(2 * _NEAR + 1)), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]) & (rank(y) > rank(x))))
    return F.transform(F.array(F.array_distinct(spans)), of)[0]


def examples(n: int = 1_600, seed: int = 3) -> list[tuple[str, int]]:
    """Sentences with one span each, made from templates, and whether it is personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick("ka", "lo", "mi", "ten", "ra", "vor", "el", "shu", "dan") for _ in range(rng.integers(1, 4)))

    def check(body: str) -> str:
        total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def card() -> str:
        if rng.random() < 0.3:
            d = check(pick("34", "37") + digits(12))
            return pick(d, f"{d[:4]} {d[4:10]} {d[10:]}", f"{d[:4]}-{d[4:10]}-{d[10:]}")
        d, sep = check(pick("4", "51", "55", "60") + digits(14))[-16:].rjust(16, "4"), pick(".", "/")
        d = check(d[:15])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0049 {a} {b} {c}", f"001-{a}-{b}-{c}")

    def mail() -> str:
        at, dot = pick(("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "."))
        return f"{word()}{pick('', '.', '_')}{word()}{at}{word()}{dot}{pick('com', 'org', 'net')}"

    def ip6() -> str:
        group = lambda: f"{rng.integers(0, 65_536):x}"
        return pick(":".join(group() for _ in range(8)), f"2001:db8::{group()}:{group()}", f"fe80::{group()}:{group()}:{group()}", f"{group()}:{group()}:{group()}::{group()}")

    def no() -> str:
        return pick(
            lambda: f"{digits(1)}:{digits(2)}::{digits(2)}",
            lambda: ":".join(digits(1) for _ in range(8)),
            lambda: f"{pick('a', 'b', 'c')}::{pick('add', 'bed', 'face')}",
            lambda: f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}",
            lambda: digits(int(rng.integers(13, 20))),
            lambda: digits(16),
            lambda: f"{digits(4)} {digits(4)} {digits(5)}",
            lambda: f"{rng.integers(100, 999)}.{rng.integers(100, 999)}.{rng.integers(300, 999)}.{rng.integers(1, 999)}",
            lambda: f"{digits(3)} {digits(3)} {digits(3)}",
            lambda: f"{digits(2)}/{digits(4)}-{digits(4)}",
            lambda: f"look at {word()} dot {word()} again",
            lambda: f"20{digits(2)}-{digits(3)}-{digits(3)}",
        )()

    hints = {"card": ("card ", "pay with ", "visa: ", ""), "phone": ("call ", "tel. ", "phone: ", "fax ", "mobile "), "mail": ("mail ", "write to ", "contact: ", ""), "ip": ("host ", "from ", "ip ", "")}
    out = []
    for _ in range(n):
        lead = " ".join(word() for _ in range(rng.integers(1, 6)))
        if rng.random() < 0.5:
            kind, make = pick(("card", card), ("phone", phone), ("mail", mail), ("ip", ip6))
            out.append((f"{lead} {pick(*hints[kind])}{make()}{pick(' ', '. ', ', ', ' - ')}{word()}", 1))
        else:
            out.append((f"{lead} {pick('', '', 'order ', 'ref. ', 'token = ', 'version ', 'total ', 'call ', 'card ', 'pay ', 'mail ', 'phone ')}{no()}{pick(' ', '. ', ', ')}{word()}", 0))
    return out


def places(docs: DataFrame, n_docs: int = FIT_DOCS, text_bytes: int = FIT_TEXT_BYTES, n: int = FIT_SPANS) -> list[tuple[str, str, str, str, int, int]]:
    """(kind, text before, match, text after, 1 for a base span and 0 for a number that fails a card's check, document's hash).

    From at most ``n_docs`` documents of at most ``text_bytes`` bytes, those with the smallest hashes of their ids, and at most
    ``n`` places of them, so what reaches the driver is bounded.
    """
    h = F.xxhash64("doc_id").alias("h")
    drawn = docs.select(h).distinct().orderBy("h").limit(n_docs).agg(F.max("h")).first()[0]
    if drawn is None:
        return []
    df = cut(docs.where((F.octet_length("text") <= text_bytes) & (F.xxhash64("doc_id") <= drawn)).select("text", h), "drawn-documents")
    found = []
    for kind in KINDS:
        at = _located(df, "hit", BASE[kind], F.col("text").rlike(_NEEDS[kind]), around=True).select("h", F.explode("hit").alias("x"))
        valid = _valid(kind, F.col("x.m"))
        fails = F.length(_digits(F.col("x.m"))).between(13, 19) if kind == "card" else F.lit(False)
        found.append(at.where(valid | fails).select(F.lit(kind).alias("kind"), F.col("x.b").alias("b"), F.col("x.m").alias("m"), F.col("x.a").alias("a"), valid.cast("int").alias("y"), "h"))
    every = found[0]
    for other in found[1:]:
        every = every.unionAll(other)
    return [tuple(r) for r in every.distinct().orderBy("h", "kind", "b", "m", "a").limit(n).collect()]


def rewritten(found: list[tuple[str, str, str, str, int, int]], seed: int = 4) -> list[tuple[str, int, int]]:
    """(text, label, document's hash): base spans in another form where they stand; numbers that fail their check as they are."""
    rng, out = np.random.default_rng(seed), []
    pick = lambda *x: x[rng.integers(len(x))]
    for kind, before, m, after, y, h in found:
        d = "".join(c for c in m if c.isdigit())
        if y and kind == "email":
            at, dot = pick((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."))
            m = m.replace("@", at).replace(".", dot) if at != "(at)" else m.replace("@", at)
        elif y and kind == "ip":
            m = ":".join(f"{int(v) * 257:x}" for v in m.split(".") * 2)
        elif y and kind == "card":
            sep = pick(".", "/")
            m = sep.join(d[i : i + 4] for i in range(0, len(d), 4))
        elif y:
            a, b, c = d[-10:-7] or "20", d[-7:-4], d[-4:]
            m = pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{d[:-10] or 1} {a} {b} {c}", f"+{d[:-10] or 1} ({a}) {b}-{c}" if before[-1:].isspace() else f"({a}) {b}-{c}")
        out.append((f"{before}{m}{after}", y, h))
    return out


def _judged(spark: SparkSession, made: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, hash) of the candidates in some texts, in a fixed order."""
    rows = F.from_json(F.lit(json.dumps([{"text": t, "y": y, "h": h} for t, y, h in made])), "array<struct<text:string,y:int,h:long>>")
    got = candidates(spark.range(1).select(F.inline(rows))).select("y", "h", F.explode("wide").alias("c")).select("y", "h", "c.f").collect()
    got = sorted(got, key=lambda r: (r["h"], r["f"], r["y"]))
    return np.array([r["f"] for r in got], np.int64).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], np.float64), np.array([r["h"] for r in got], np.int64)


_JUDGED: list = []


def _templates(spark: SparkSession) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates of ``examples``, which are the same in every fit of this process."""
    if not _JUDGED:
        _JUDGED.append(_judged(spark, [(t, y, k) for k, (t, y) in enumerate(examples())]))
    return _JUDGED[0]


def fit(spark: SparkSession, docs: DataFrame | None = None, made: list[tuple[str, int]] | None = None, precision: float = 0.99) -> tuple[list, list[float]]:
    """(trees, threshold of each kind).

    Two thirds of the templates' candidates and of the documents' places grow the trees, the rest calibrates: a kind's threshold
    is the lowest at which ``precision`` of the calibration candidates at or above it are personal data, never below one half.
    Documents calibrate a kind if they hold 20 places of it, templates otherwise; a kind without such a threshold is never added.
    """
    parts = [_templates(spark) if made is None else _judged(spark, [(t, y, k) for k, (t, y) in enumerate(made)])]
    if docs is not None and (found := places(docs)):
        parts.append(_judged(spark, rewritten(found)))
    held = [h % 3 == 0 for _, _, h in parts]
    trees = boosting.fit(np.concatenate([p[0][~k] for p, k in zip(parts, held)]), np.concatenate([p[1][~k] for p, k in zip(parts, held)]))
    limits = []
    for kind in range(len(KINDS)):
        limit = 2.0
        for (x, y, _), k in list(zip(parts, held))[::-1]:
            own = k & (x[:, 0] == kind)
            p, truth = boosting.probability(trees, x[own]), y[own]
            if truth.sum() < 20 and x is not parts[0][0]:
                continue
            fair = [c for c in np.unique(p) if truth[p >= c].mean() >= precision]
            limit = max(0.5, float(min(fair)) - 1e-9) if fair else 2.0
            break
        limits.append(limit)
    return trees, limits


def find(docs: DataFrame, model: tuple[list, list[float]] | None = None) -> DataFrame:
    """``docs`` with base_email, base_ip, base_card, base_phone (start, end, match) and ``added`` (kind number, start, end, p).

    A null text counts as empty and has no spans. Added spans overlap no base span and no more probable added one (ties: the
    earlier, the longer). One narrow pass, no exchange; rows that repeat are each searched. Input columns of these five names are
    replaced, all others stay, whatever their names. Without a model, one is fitted on ``docs``.
    """
    spark = docs.sparkSession
    trees, limits = fit(spark, docs) if model is None else model
    made = [*(f"base_{k}" for k in KINDS), "added"]
    others = [c for c in docs.columns if c.lower() not in {*made, "text"}]
    (packed,) = fresh_names(docs, 1)
    packs = F.struct(*others) if others else F.lit(None)
    df = candidates(base_spans(docs.select(packs.alias(packed), F.coalesce("text", F.lit("")).alias("text"))))
    limit = " ".join(f"WHEN {k} THEN {v!r}D" for k, v in enumerate(limits))
    judged = f"transform(wide, x -> struct(x.k AS k, x.s AS s, x.e AS e, {boosting.sql(trees, lambda i: f'x.f[{i}]')} AS p))"
    df = df.withColumn("added", F.expr(f"filter({judged}, x -> x.p >= CASE x.k {limit} END)"))
    ends = lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))
    bases = F.concat(*[F.transform(f"base_{k}", ends) for k in KINDS])
    df = df.withColumn("added", F.when(F.size("added") > 0, _spread(F.col("added"), bases)).otherwise(F.col("added")))
    df = df.withColumn("added", F.when(F.size("added") > 1, _best(F.col("added"))).otherwise(F.col("added")))
    kept = {c.lower(): F.col(f"{packed}.`{c}`").alias(c) for c in others}
    return df.select(*[F.col("text") if c.lower() == "text" else kept[c.lower()] for c in docs.columns if c.lower() not in set(made)], *made)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans (kind:start:end in order of kind, then start)."""
    named = {k: F.transform(f"base_{k}", _spelled(k)) for k in KINDS}
    base = F.array_join(F.concat(*[named[k] for k in KINDS]), ",")

    def merged(i: int, k: str) -> Column:
        own = F.transform(F.filter("added", lambda x: x["k"] == i), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        every = F.sort_array(F.concat(F.transform(f"base_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))), own))
        return F.transform(every, _spelled(k))

    every = F.array_join(F.concat(*[merged(i, k) for i, k in enumerate(KINDS)]), ",")
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
