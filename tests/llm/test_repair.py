"""Conversation repair against a plain dynamic program, and both against all edits of short conversations."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from lexmill.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, key int, block string"
NEXT = {"N": "u", "S": "u", "A": "u", "U": "a"}


def _space(v):
    return " " if v is None else v


def _ordered(rows):
    return sorted(rows, key=lambda z: ((0, 0) if z[0] is None else (1, z[0]), z[1].encode(), z[2].encode()))


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        out.append(1 if not marks else 2 if (role, text) in seen else 3 if marks[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def _cheapest(rows, faults):
    def inserted(best):
        for _ in range(4):
            for s, (c, p, lines) in list(best.items()):
                to, way = NEXT[s].upper(), (c + 3, p + "I", [*lines, "user:" if NEXT[s] == "u" else "assistant:"])
                if to not in best or way[:2] < best[to][:2]:
                    best[to] = way
        return best

    best = inserted({"N": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def put(s, way):
            if s not in new or way[:2] < new[s][:2]:
                new[s] = way

        for s, (c, p, lines) in best.items():
            put(s, (c + 4, p + "D", lines))
            if fault in (1, 2):
                continue
            more, i, to = 3 * (fault == 3), role[:1], NEXT[s]
            if (i == "s" and s == "N") or i == to:
                put(i.upper(), (c + more, p + "K", [*lines, f"{role}:{text}"]))
            put(to.upper(), (c + 3 + more, p + "R", [*lines, f"{'user' if to == 'u' else 'assistant'}:{text}"]))
        best = inserted(new)
    return min((best[s] for s in ("N", "A") if s in best), key=lambda z: z[:2])


def _report(rows):
    faults = _faults(rows)
    cost, audit, lines = _cheapest(rows, faults)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _damaged(table):
    out = collections.defaultdict(list)
    for conv, turn, role, text in table:
        out[conv]
        k = zlib.crc32(f"{_space(conv)}:{_space(turn)}".encode()) % 20
        role, text = _space(role), _space(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        for _ in range(0 if k == 0 else 2 if k == 3 else 1):
            out[conv].append((turn, "user" if k == 4 else role, text))
    return {k: _report(_ordered(v)) for k, v in out.items()}


def _table(seed, n=120):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No", "Why?", "  ", "", "\n\t", None, "Yes.", "a. ", "é! ", "\U0001f600.", "two\nlines."]
    for conv in [*range(n), None]:
        turn = rng.randint(-3, 3)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "umpire", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, rng.choice(texts)))
            turn += rng.choice([1, 1, 1, 0, 2, 300])
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def test_dynamic_program_against_all_edits():
    """Every way to edit up to three rows with up to two insertions at each place."""
    rng = random.Random(2)
    for _ in range(60):
        rows = _ordered([(i, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Yes.", "No", " ", "Why?"])) for i in range(rng.randint(0, 3))])
        faults, found = _faults(rows), []
        gaps = ["", "I", "II"]
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            for ops in itertools.product("DKR", repeat=len(rows)):
                audit = ins[0] + "".join(o + i for o, i in zip(ops, ins[1:]))
                kept = [(o, r, f) for o, r, f in zip(ops, rows, faults)]
                if any(o != "D" and f in (1, 2) for o, _, f in kept):
                    continue
                cost = sum({"D": 4, "K": 0, "R": 3}[o] + 3 * (o != "D" and f == 3) for o, _, f in kept) + 3 * audit.count("I")
                letters = "".join("?" if o in "RI" else "" if o == "D" else next(it)[0] for it in [iter([r[1] for o, r, _ in kept if o == "K"])] for o in audit)
                if any(re.fullmatch("(s?(ua)+)?", "".join(c)) for c in itertools.product(*["ua" if x == "?" else x for x in letters])):
                    found.append((cost, audit))
        assert _cheapest(rows, faults)[:2] == min(found)


@pytest.mark.parametrize("bits", [0, 2, 8])
def test_against_a_plain_program(spark, bits):
    rows = _table(bits)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    got = repair.report(repair.damaged(df), df, bits).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == _damaged(rows) and len(got) == len({r[0] for r in rows})


def test_sql_agrees(spark):
    rows = _table(7)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.sql(repair.oracle()).fetchall()} == _damaged(rows)


def test_long_conversation_is_many_blocks(spark):
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"{rng.random()}.") for i in range(3_000)] + [(8, 5, "user", "Again.")] * 1_000
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    parts = repair.blocks(repair.flagged(df))
    assert max(len(r["turns"]) for r in parts.select("turns").collect()) <= 256
    found, text = repair.repair(df)
    by = {r["conv_id"]: r for r in found.collect()}
    own = collections.defaultdict(list)
    for conv, *r in rows:
        own[conv].append(tuple(r))
    for conv, r in by.items():
        assert tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) == _report(_ordered(own[conv]))
    assert text.columns == ["key", "block", "lines"]


def test_empty_and_dropped(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.report(repair.damaged(none), none).collect() == []
    gone = next(i for i in range(1_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.", 1, "x")], SCHEMA)
    assert [tuple(r) for r in repair.report(repair.damaged(df), df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
