"""Near duplicates by an inverted join over MinHash signature coordinates.

1. Signatures. A document's set is its different 5-word shingles; K MinHash coordinates, a 128-bit digest of the set and its
   size are kept. Documents with one set are one class; its smallest doc_id stands for it from here on.
2. Postings. A class is posted under (coordinate, value) pairs. Pairs that only one class has can't collide and go. Classes
   that agree in T of K coordinates share one of their rarest n - T + 1 pairs (n: those left of the class), so only
   those are posted (prefix), and the long lists of common pairs are skipped.
3. Links. Colliding classes are counted over whole signatures; those with T matches and fitting sizes are confirmed on full
   sets. To spare a group of m near copies its m * m pairs, each list first compares all with one hub: the class with the
   least of its own, as what is closest to a common origin has most links. Members that are linked, directly or by others,
   are never compared.
4. Classes of lists that still hold several components are listed once more under the rarest shingles of their full sets,
   which is exact. There, too, hubs go first (a second round of them only where many pairs would be left), then the pairs of
   different components that may still be linked. No pair that could be linked is left untested.

T follows from the similarity asked for: the largest number for which a link of just that similarity has fewer matches among K
coordinates with probability below OVERLOOKED; more similar links are safer.

Lists of one key may hold a third of all rows. Rows of a key with more than ``_long`` of them get what belongs to the key from
a broadcast of those few keys, so they stay where they are; only rows of other keys go through an exchange by key. The last
step's pairs within a long list are dealt by blocks of LONG members, two blocks a key. Tables of SEND_ROWS rows at most (hubs,
components, pairs) are sent whole, which spares most of the many small steps their exchanges.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import byte_lengths, cut, fresh_names, lean, mix, text_groups, tidy, word_hashes

SHINGLE, K, OVERLOOKED = 5, 32, 1e-5
#: Rows of one key from which it counts as long, and how many long keys there are at most.
LONG, LONG_KEYS = 512, 200_000
#: Ids of classes that are sent to all workers at most, as a filter on the second read of the texts; beyond it is a join.
SEND_IDS = 2_000_000
#: Rows of a few numbers, and classes with their signatures, that are sent at most; a larger table is joined through an exchange.
SEND_ROWS, SEND_SIGNATURES = 500_000, 100_000
_RNG = np.random.default_rng(71)
_MULTIPLY = _RNG.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, K, dtype=np.uint64)
_ORDER = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNED = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.list_(pa.int32()))])
_SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's different shingles; one for a text with fewer words, none without words."""
    offsets, h = word_hashes(texts)
    if not len(h):
        return [np.zeros(0, np.uint64)] * len(texts)
    n = len(h) - SHINGLE + 1
    if n > 0:
        rolled = h[:n] * _ORDER[0]
        for k in range(1, SHINGLE):
            rolled += mix(h[k : k + n]) * _ORDER[k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for k in range(a, b):
                whole = mix(np.array([whole]) * _ORDER[0] + h[k])[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The K coordinates: minima of K multiply-shift permutations, upper halves."""
    low = np.full(K, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 4_096):
        part = shingles[i : i + 4_096]
        for k in range(K):
            m = (part * _MULTIPLY[k] + _ADD[k]).min() >> np.uint64(32)
            if m < low[k]:
                low[k] = m
    return low.astype(np.uint32).view(np.int32)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in text_groups(byte_lengths(texts)):
            sets = shingle_sets(texts.slice(a, b - a))
            d1 = np.array([mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            d2 = np.array([mix(s * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            sigs = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("tie").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1), pa.array(d2), pa.array(sigs, pa.list_(pa.int32()))], schema=_SIGNED)


def _set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in text_groups(byte_lengths(texts)):
            sets = shingle_sets(texts.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=_SETS)


def _fits(na, nb, percent: int):
    """Sizes that a Jaccard index of ``percent`` or more allows."""
    return (F.lit(100) * F.least(na, nb)) >= F.lit(percent) * F.greatest(na, nb)


def _matches(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def least_matches(percent: int) -> int:
    """T: the most matches of K that a link with a Jaccard index of ``percent`` / 100 misses with probability below OVERLOOKED."""
    j, below = percent / 100, 0.0
    for t in range(K):
        below += comb(K, t) * j**t * (1 - j) ** (K - t)
        if below > OVERLOOKED:
            return max(t, 1)
    return K


def _sent(table: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """``table`` with the hint to send it whole, if it has ``most`` (SEND_ROWS) rows at most."""
    return F.broadcast(table) if rows <= (SEND_ROWS if most is None else most) else table


def _long(total: int) -> int:
    return max(LONG, total // LONG_KEYS)


def _keyed(rows: DataFrame, counted: DataFrame, key: str, n: str, send: bool = True) -> DataFrame:
    """``rows`` joined with ``counted`` by ``key``; counted has one row a key, with ``n``, how many rows hold it.

    Keys with more than _long(rows) of them are at most LONG_KEYS, so they are broadcast; all keys are, with ``send``, if few.
    """
    if send and counted.count() <= SEND_ROWS:
        return rows.join(F.broadcast(counted), key)
    least = _long(rows.count())
    long = F.broadcast(counted.where(F.col(n) > least))
    short = rows.join(F.broadcast(counted.where(F.col(n) > least).select(key)), key, "left_anti")
    return rows.join(long, key).unionByName(short.join(counted.where(F.col(n) <= least), key))


def _postings(classes: DataFrame, t: int) -> DataFrame:
    """rep, own, tokens: the prefix postings of each class that can match another; own: coordinates that no other class has."""
    posted = classes.select("rep", F.posexplode("sig").alias("at", "value")).select("rep", (F.col("at").cast("long") * F.lit(1 << 32) + F.col("value").cast("long")).alias("token"))
    common = cut(posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "common")
    own = _keyed(posted, common, "token", "n").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own"))  # K at most
    return own.where(F.size("own") >= t).select("rep", (F.lit(K) - F.size("own")).alias("own"), F.slice("own", F.lit(1), F.size("own") - (t - 1))["token"].alias("tokens"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, few: bool) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard index of ``percent`` or more.

    ``few`` pairs are sent to the sets, and a pair's two sets meet by the pair: neither all sets nor a hub's pairs go to one place.
    """

    def near(x, y):
        inter = F.size(F.array_intersect(x, y))
        return F.lit(100) * inter >= F.lit(percent) * (F.size(x) + F.size(y) - inter)

    if few:
        ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))
        of = lambda end: F.collect_list(F.when(F.col("doc_id") == F.col(end), F.col("shingles"))).alias(f"s{end}")  # noqa: E731  one, or those of a repeated doc_id
        both = sets.join(F.broadcast(ends), "doc_id").groupBy("a", "b").agg(of("a"), of("b"))
        return both.where(F.exists("sa", lambda x: F.exists("sb", lambda y: near(x, y)))).select("a", "b")
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    return both.where(near(F.col("sa"), F.col("sb"))).select("a", "b").distinct()


def _unlike(lists: DataFrame, parts: DataFrame, nodes: int) -> DataFrame:
    """Of lists (token, rep, ...) those with more than one component: with comp, top, the component that most of the list is in,
    and list, how long it is. ``nodes``: rows of parts."""
    now = cut(lists.join(_sent(parts, nodes), "rep"), "placed")
    counts = now.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = counts.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("list")).where("comps > 1")
    mixed = cut(mixed.select("token", F.col("top.comp").alias("top"), "list"), "mixed")
    return cut(_keyed(now, mixed, "token", "list"), "apart")


def _apart_reps(lists: DataFrame, parts: DataFrame, nodes: int) -> DataFrame:
    """rep of the classes in lists with more than one component, maybe repeated."""
    now = cut(lists.select("token", "rep").join(_sent(parts, nodes), "rep"), "placed")
    mixed = now.groupBy("token").agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.count(F.lit(1)).alias("list")).where("first != last")
    return cut(_keyed(now, cut(mixed.select("token", "list"), "mixed"), "token", "list").select("rep"), "apart-reps")


def _rare_lists(reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """token, rep, n, left, own: the prefix of each class's full set, rarest shingles first, for a join that misses no link.

    With J >= percent a class shares ceil(percent * n) of its n shingles at least, so two such have one in common among their
    n - ceil(percent * n) + 1 rarest. Shingles that only one class has (a share ``own``) fill that prefix first, so a class with
    too many of them has no list. ``left``: the class's shingles that others have, from this one on.
    """
    every = cut(sets.join(_sent(reps, reps.count(), SEND_IDS), F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("sh")), "shingles")
    common = cut(every.groupBy("sh").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common")
    kept = _keyed(every, common, "sh", "df", send=False).groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sh"))).alias("rare"))  # no more than the class's set
    need = F.ceil(F.col("n") * F.lit(percent) / F.lit(100.0)).cast("int")
    kept = kept.withColumn("prefix", F.size("rare") - need + 1).where("prefix > 0")
    kept = kept.select(F.col("doc_id").alias("rep"), "n", F.size("rare").alias("size"), F.posexplode(F.slice("rare", F.lit(1), F.col("prefix"))["sh"]).alias("at", "token"))
    return cut(kept.select("token", "rep", "n", (F.col("size") - F.col("at")).alias("left"), ((F.col("n") - F.col("size")) / F.col("n")).alias("own")), "rare")


def _met(apart: DataFrame, percent: int | None, hubs: str | None) -> DataFrame:
    """a, b of the pairs of different components in the lists, maybe repeated: with one hub a list ('any', or 'rest': not of the list's top
    component), or all (None). Where sizes are known (``percent``), pairs whose first common shingle comes too late to be linked
    are left out.
    """
    fields = [c for c in ("rep", "comp", "n", "left", "own") if c in apart.columns]
    y = apart.select("token", *[c for c in ("list", "top") if c in apart.columns], *[F.col(c).alias(f"{c}_y") for c in fields])
    if hubs:
        key = F.struct(F.col("own").alias("o"), F.xxhash64("rep").alias("h"), F.struct(*fields).alias("r"))
        longest = F.count(F.lit(1)) if hubs == "any" else F.max("list")
        x = apart.where("comp != top" if hubs == "rest" else "true").groupBy("token").agg(F.min(key)["r"].alias("r"), longest.alias("list"))
        x = cut(x.select("token", "list", *[F.col(f"r.{c}").alias(f"{c}_x") for c in fields]), "hubs")
        both = _keyed(y.drop("list"), x, "token", "list")
    else:
        rest = apart.where("comp != top")  # two of the top component never make a pair
        x = rest.select("token", "list", *[F.col(c).alias(f"{c}_x") for c in fields])
        if (members := rest.count()) <= SEND_ROWS:
            both = y.join(_sent(x.drop("list"), members), "token")
        else:
            blocks = F.ceil(F.col("list") / F.lit(LONG)).cast("int")
            every = F.explode(F.sequence(F.lit(0), blocks - 1))
            own = lambda c: F.pmod(F.xxhash64(c), blocks).cast("int")
            x = x.select("*", own("rep_x").alias("i"), every.alias("j")).drop("list")
            both = x.join(y.select("*", own("rep_y").alias("j"), every.alias("i")).drop("list"), ["token", "i", "j"])
    fits = F.col("comp_x") != F.col("comp_y")
    if percent:
        most = F.least("left_x", "left_y")  # shared at most, if this is the first shingle shared
        fits = fits & (F.lit(100) * most >= F.lit(percent) * (F.col("n_x") + F.col("n_y") - most))
    if not hubs:
        fits = fits & ((F.col("comp_y") == F.col("top")) | (F.col("rep_x") < F.col("rep_y")))
    return both.where(fits).select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))


def class_links(docs: DataFrame, classes: DataFrame, percent: int = 85) -> DataFrame:
    """rep, comp for the classes (rep, n, sig) that can match another: their component under links."""
    t = least_matches(percent)
    posted = cut(_postings(classes, t), "postings")
    nodes = posted.count()
    postings = posted.select(F.explode("tokens").alias("token"), "rep", "own")
    ids = posted.select("rep")
    signed = cut(classes.join(_sent(ids, nodes, SEND_IDS), "rep", "left_semi"), "posted-classes")
    wanted = docs.select("doc_id", "text").join(_sent(ids, nodes, SEND_IDS), F.col("doc_id") == F.col("rep"), "left_semi")
    sets = cut(wanted.mapInArrow(tidy(_set), "doc_id long, shingles array<long>"), "shingle-sets")
    signatures = signed.count()
    a, b = (_sent(signed.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")), signatures, SEND_SIGNATURES) for c in "ab")
    parts = ids.withColumn("comp", F.col("rep"))
    tested = rare = apart = None
    for hubs in ("signature", "any", "rest", None):
        if hubs == "signature":
            pairs = _met(postings.withColumn("comp", F.col("rep")), None, "any")
        else:
            if rare is None:
                rare = _rare_lists(_apart_reps(postings, parts, nodes), sets, percent)
            if apart is None:
                apart = _unlike(rare, parts, nodes)
            if not (members := apart.count()):
                break
            if hubs == "rest" and _met(apart, percent, None).count() <= members:
                continue  # so few pairs are left that they needn't be spared
            pairs = _met(apart, percent, hubs)
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(_sent(tested, tested.count()), ["a", "b"], "left_anti")
        pairs = cut(pairs, "met")
        met = pairs.count()
        if not met:
            continue
        tested = pairs if tested is None else tested.unionAll(pairs)
        near = pairs.join(a, "a").join(b, "b").where(_fits(F.col("na"), F.col("nb"), percent) & (_matches("sa", "sb") >= t)).select("a", "b")
        new = cut(_confirmed(near, sets, percent, 2 * met <= SEND_ROWS), "new-links")
        if not new.take(1):
            continue
        of = lambda end: _sent(parts.select(F.col("rep").alias(end), F.col("comp").alias(f"comp_{end}")), nodes)  # noqa: B023, E731  used before parts is set anew
        joined = connected_components(new.join(of("a"), "a").join(of("b"), "b").select("comp_a", "comp_b")).withColumnsRenamed({"node": "comp", "component": "now"})
        parts = cut(parts.join(_sent(joined, nodes), "comp", "left").select("rep", F.coalesce("now", "comp").alias("comp")), "parts")
        apart = None
    return parts


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, tie (hash of the text), n, component_id, kept of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    lean(docs.sparkSession)
    signed = cut(docs.mapInArrow(tidy(_sign), "doc_id long, tie long, n long, d1 long, d2 long, sig array<int>"), "signatures")
    named = signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = cut(named.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")), "classes")
    parts = class_links(docs, classes.select("rep", "n", "sig"), percent)
    member = classes.join(_sent(parts, parts.count()), "rep", "left").select("d1", "d2", "n", F.coalesce("comp", "rep").alias("component_id"))
    found = signed.join(member, ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "tie", "n", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the groups of documents linked by 100 * |A and B| >= percent * |A or B|.

    component_id is the smallest doc_id reachable over links, the document's own included, and kept marks that document. A null
    or wordless text has the empty set, links with nothing and is kept. A null doc_id has n_shingles and null for component_id,
    links with nothing and is kept. Rows that repeat a doc_id each go with the group of their own text. Other columns are
    ignored.
    """
    return _grouped(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` but for those of a group's other documents; of rows alike in doc_id and text one stays.

    Rows to leave are few against all, so their keys are sent to the workers if there are SEND_IDS at most and joined through an
    exchange beyond that. Columns of any name are handed on: the keys' names are made up afresh.
    """
    found = cut(_grouped(docs, percent), "groups")
    tie, doc, gone_tie = fresh_names(docs, 3)
    keyed = docs.withColumn(tie, F.xxhash64("text"))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(doc), F.col("tie").alias(gone_tie)).distinct()
    left = keyed.join(F.broadcast(gone) if gone.count() <= SEND_IDS else gone, (F.col("doc_id").cast("long") == F.col(doc)) & (F.col(tie) == F.col(gone_tie)), "left_anti")
    again = found.where("kept").groupBy("doc_id", "tie").count().where("count > 1").select(F.col("doc_id").alias(doc), F.col("tie").alias(gone_tie))
    if not again.take(1):
        return left.select(docs.columns)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(tie) == F.col(gone_tie))
    return left.join(again, same, "left_anti").unionAll(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])).select(docs.columns)


def oracle(percent: int = 85) -> str:
    """DuckDB SQL of the same result: all pairs that share a shingle, counted, and a recursive closure. For small tables."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[k:k + 4] END, ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    reach(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT node, e.b FROM reach JOIN e ON other = e.a),
    c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c ON d.doc_id = node LEFT JOIN n ON n.doc_id = d.doc_id"""
