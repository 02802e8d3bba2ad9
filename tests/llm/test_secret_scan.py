"""The secret scan against plain regular expressions and entropies counted anew for every window."""

from __future__ import annotations

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from lexmill.llm import secret_scan

ASSIGN = r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
NAMES = ("assign", "access", "hex", "entropy")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, t, re.I | re.A) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def _entropy(w):
    return math.log2(len(w)) - sum(c * math.log2(c) for c in (w.count(x) for x in set(w))) / len(w)


def _added(t, base):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", t):
        spans = []
        for i in range(len(m[0]) - 19):
            w = m[0][i : i + 20]
            digits, signs = sum(c.isdigit() for c in w), sum(c in "+/_-" for c in w)
            bits = 3.0 if re.fullmatch("[0-9a-fA-F]+", w) else 4.0 if signs else 3.7
            if _entropy(w) >= bits - 1e-7 and digits >= 2 and 20 - digits - signs >= 4:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + 20
                else:
                    spans.append([i, i + 20])
        behind = t[max(0, m.start() - 32) : m.start()]
        for s, e in spans:
            allowed = any(re.search(p, m[0][s:e]) for p in secret_scan.ALLOW) or any(re.search(p, behind) for p in secret_scan.ALLOW_BEHIND)
            if not allowed and not any(b < m.start() + e and m.start() + s < x for b, _, x in base):
                out.append((m.start() + s, 3, m.start() + e))
    return out


def _spelled(spans):
    return ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _expected(t):
    base = _base(t or "")
    return (*(sum(k == x[1] for x in base) for k in range(3)), hashlib.sha256(_spelled(base).encode()).hexdigest(), _spelled(base + _added(t or "", base)))


def _texts():
    rng = random.Random(5)
    parts = ["token", "password: ", "Secret = '", 'api_key="', "APIKEY:", "paſſword=", "passwd=", "AKIA", "é ", "\U0001f600", "\n", " ", "=", '"', "deadbeef", "abc123", "0123456789abcdef", "AAAA", "-", "https://x.y/", "base64,", "see /usr/share/data-2024-01-02/file-name ", "123e4567-e89b-12d3-a456-426614174000 "]
    sets = [LETTERS, LETTERS + "+/_-", "0123456789ABCDEF", "abcdef0123456789"]
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))

    def part():
        if rng.random() < 0.6:
            return rng.choice(parts)
        return some(rng.randint(1, 60), rng.choice(sets)) if rng.random() < 0.5 else some(rng.randint(10, 45), LETTERS) + " "

    made = ["".join(part() for _ in range(rng.randint(0, 25))) for _ in range(500)]
    return [*made, None, "", " \n", some(30_000, LETTERS), "token=" * 3_000, "tOkEn=password\":abcdefghijklmn", "AKIA" * 9, "f" * 15 + " " + "f" * 16]


def test_against_regular_expressions(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: tuple(r)[1:] for r in secret_scan.digest(secret_scan.find(df)).collect()}
    wrong = [(t, got[i], _expected(t)) for i, t in enumerate(texts) if got[i] != _expected(t)]
    assert not wrong
    assert sum("entropy" in v[4] for v in got.values()) > 100


def test_allow_list(spark):
    rng = random.Random(9)
    key = "".join(rng.choice(LETTERS) for _ in range(32))
    texts = [f"key {key} here", f"https://host.example/{key}", f"image/png;base64,{key}", f"sha256-{key}", "123e4567-E89B-12d3-a456-426614174Ab0", "release-notes/2024-01-15/first-steps-v2", "ABCDEFGHabcdefgh0123456789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["added"] for r in secret_scan.find(df).orderBy("doc_id").collect()]
    assert [len(a) for a in got] == [1, 0, 0, 0, 0, 0, 0]
    assert (got[0][0]["s"], got[0][0]["e"]) == (4, 36)


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "AKIA" + "A1" * 8), (2, "")], "doc_id long, text string").withColumns({"random": F.lit(1), "added": F.lit("x"), "base_hex": F.lit(0), "s": F.lit(2), "_runs": F.lit(3)})
    found = secret_scan.find(df)
    assert found.columns == ["doc_id", "text", "random", "s", "_runs", "base_assign", "base_access", "base_hex", "added"]
    rows = found.collect()
    assert len(rows) == 4 and all(r["random"] == 1 and r["s"] == 2 and r["_runs"] == 3 for r in rows)
    got = secret_scan.digest(found).collect()
    assert sorted((r["doc_id"] or 0, r["n_access"], r["spans"]) for r in got) == [(0, 1, "access:0:20"), (1, 0, ""), (1, 0, ""), (2, 0, "")]
    assert secret_scan.digest(secret_scan.find(df.where("false"))).collect() == []
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
