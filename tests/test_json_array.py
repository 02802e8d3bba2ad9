"""JSON arrays by splits against the json module, and arrays as one file."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lexmill.sources import files, json_array


def _value(rng, depth=0):
    if depth < 3 and rng.random() < 0.25:
        return {f"k{i}{rng.choice(['', chr(34), '}', '{' + chr(92)])}": _value(rng, depth + 1) for i in range(rng.randint(0, 3))}
    if depth < 3 and rng.random() < 0.2:
        return [_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, None, True, "x", "a}b{c[", 'q"}\\', "\\\\", "}\n{", "é,\U0001f600", "", '","', 3.5, "long " * 40])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Arrays and lines with braces, quotes and escapes in strings, other elements, a byte-order mark, and files without records."""
    at, rng, expected, pos = tmp_path_factory.mktemp("json"), random.Random(1), {}, 0
    for f in range(8):
        lines = f in (2, 4)
        rows = [{"i": i, "v": _value(rng)} if lines or rng.random() < 0.85 else rng.choice([7, "s}{", [{"z": 1}], None]) for i in range((0, 40, 30, 60, 25, 1, 0, 3)[f])]
        text = "".join(json.dumps(x) + "\n" for x in rows) if lines else json.dumps(rows, ensure_ascii=f % 2 == 0, indent=None if f % 3 else 2)
        (at / f"{f}.json").write_text(("﻿  " if f == 3 else "") + ("" if f == 6 else text), encoding="utf-8")
        for x in rows:
            if isinstance(x, dict):
                expected[pos] = x
            pos += 1
    return str(at), expected


@pytest.mark.parametrize("split_bytes", [None, 100, 3_000])
def test_records_of_any_split(spark, folder, split_bytes):
    path, expected = folder
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = json_array.records(spark, path, split_bytes).collect()
    assert len(got) == len(expected) and {r["pos"]: json.loads(r["value"]) for r in got} == expected
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    rows = [{"instruction": f"i{k}", "output": "o}" * 50, "input": k} for k in range(3_000)]
    (tmp_path / "in.json").write_text(json.dumps(rows), encoding="utf-8")
    got = files.read_json_array(spark, str(tmp_path / "in.json"), 20_000)
    assert sorted((r["pos"], r["instruction"], r["input_is_text"]) for r in got.collect()) == [(k, f"i{k}", False) for k in range(3_000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert json_array._pieces(spark, str(tmp_path / "in.json")).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("order", [None, "id"])
def test_array_in_one_file(spark, tmp_path, order):
    rows = [(None if i == 7 else i, f"t{i}\n", None if i % 3 else "x") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a string, b string").repartition(7)
    path = tmp_path / "deep" / "one.json"
    for _ in range(2):  # what is there is replaced
        json_array.write_array(df, str(path), order)
    got = json.loads(path.read_text(encoding="utf-8"))
    key = lambda r: (r.get("id") is not None, r.get("id") or 0)
    assert sorted(got, key=key) == (got if order else sorted(got, key=key))
    assert {r["a"] for r in got} == {r[1] for r in rows} and len(got) == 500 and sum("b" in r for r in got) == sum(r[2] is not None for r in rows)
    assert [p.name for p in path.parent.iterdir() if not p.name.startswith(".")] == ["one.json"]
    json_array.write_array(df.where("false"), str(path), order)
    assert json.loads(path.read_text(encoding="utf-8")) == []
    back = json_array.records(spark, str(path))
    assert back.collect() == []


def test_an_error_leaves_nothing(spark, tmp_path):
    bad = spark.range(3).select(F.expr("raise_error('no')").cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        json_array.write_array(bad, str(tmp_path / "x.json"))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == []
