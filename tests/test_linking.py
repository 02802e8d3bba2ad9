"""Citations linked to a catalogue against the plain comparison of all with all."""

from __future__ import annotations

import random

from lexmill.operators import linking


def test_against_all_pairs(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("民刑法典a\U0001f600") for _ in range(rng.randint(0, 5)))
    cited = [(i, name() if rng.random() < 0.95 else None, rng.choice(["第一条", "第二条", None]), "x") for i in range(300)]
    entries = [(name() if rng.random() < 0.95 else None, rng.choice(["第一条", "第二条", "第三条", None])) for _ in range(80)]
    cited += [(300 + i, "民法典", "第一条", "x") for i in range(200)]  # a hot citation
    a = spark.createDataFrame(cited, "i long, law_name string, article string, entry_law string").repartition(4)
    b = spark.createDataFrame(entries, "law_name string, article string")
    found = linking.linked(a, b)
    assert found.columns == ["i", "law_name", "article", "entry_law", "entry_article"]
    want = {(i, x, n, y, n) for i, x, n, _ in cited for y, m in entries if None not in (x, n, y) and n == m and (x in y or y in x)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert linking.linked(a.where("false"), b).collect() == [] and linking.linked(a, b.where("false")).collect() == []
