"""Deep merge against a plain recursive fold."""

from __future__ import annotations

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.operators import merge


def _kind(v):
    return "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def _fold(a, b):
    if _kind(a) != _kind(b) or a is None:
        return a
    if _kind(a) == "number":
        return a + b
    if isinstance(a, dict):
        return {k: _fold(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in {**a, **b}}
    if isinstance(a, list):
        return [_fold(x, y) for x, y in zip(a, b, strict=False)] + (a[len(b) :] or b[len(a) :])
    return b


def _value(rng: random.Random, depth: int = 0):
    kind = rng.randrange(9 if depth < 4 else 5)
    if kind < 5:
        return [rng.randrange(-5, 100), rng.randrange(40) / 4, rng.choice(["", "é\"", "#1", "12"]), rng.random() < 0.5, None][kind]
    if kind < 8:
        return {name: _value(rng, depth + 1) for name in rng.sample(["a", "b", "a.b", "0", "ключ", ""], rng.randrange(4))}
    return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]


def test_merge_is_the_fold_in_order(spark):
    rng = random.Random(31)
    rows = [(rng.choice(["x", "y", "z", None]), k, {n: _value(rng, 1) for n in rng.sample("abcd", rng.randrange(5))} if rng.random() < 0.95 else _value(rng)) for k in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(g, k, json.dumps(v)) for g, k, v in rows] + [("x", -1, "{broken"), ("x", -2, None), ("none", 5, "")], "g string, k long, d string").repartition(5)
    wanted = defaultdict(lambda: ...)
    for g, _, v in sorted(rows, key=lambda r: r[1]):
        wanted[g] = v if wanted[g] is ... else _fold(wanted[g], v)
    found = {r["g"]: json.loads(r["d"]) for r in merge.merged(df, ["g"], "d", ["k"]).collect()}
    assert found == dict(wanted)


def test_first_kind_decides_for_all_below(spark):
    docs = ['{"a": {"b": 1}}', '{"a": 7}', '{"a": {"b": "text", "c": [1, {"x": 2}]}}', '{"a": {"b": 2, "c": [1, {"x": 0.5}, true]}}']
    df = spark.createDataFrame([(1, k, d) for k, d in enumerate(docs)], "g int, k int, d string")
    assert json.loads(merge.merged(df, ["g"], "d", ["k"]).first()["d"]) == {"a": {"b": 3, "c": [2, {"x": 2.5}, True]}}


def test_nothing_to_merge_and_too_deep(spark):
    df = spark.createDataFrame([(1, 1, "{"), (2, 2, None)], "g int, k int, d string")
    assert merge.merged(df, ["g"], "d", ["k"]).collect() == []
    deep = spark.createDataFrame([(1, 1, '{"a":' * 70 + "1" + "}" * 70)], "g int, k int, d string")
    with pytest.raises(ValueError, match="nested 70 deep"):
        merge.merged(deep, ["g"], "d", ["k"])


def test_documents_are_read_once(spark):
    """However deep documents are, each is made and read once."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(k):
        read.add(1)
        return json.dumps({"a": {"b": {"c": [k, {"d": str(k)}]}}, "n": 1})

    df = spark.range(0, 300, 1, 3).select((F.col("id") % 7).alias("g"), "id", made("id").alias("d"))
    found = {r["g"]: json.loads(r["d"]) for r in merge.merged(df, ["g"], "d", ["id"]).collect()}
    assert found[6] == {"a": {"b": {"c": [sum(range(6, 300, 7)), {"d": "293"}]}}, "n": 42}
    assert read.value == 300


def test_a_key_may_lie_in_many_batches(spark):
    """What a batch has added up meets again: the first kind, the last text and the sums are those of all batches."""
    rng = random.Random(7)
    rows = [(rng.choice([float("nan"), 0.5, None]), k, {n: _value(rng, 2) for n in rng.sample("abcd", 3)}) for k in range(300)]
    df = spark.createDataFrame([(g, k, json.dumps(v)) for g, k, v in rng.sample(rows, len(rows))], "g double, k long, d string")
    wanted = {}
    for g, _, v in rows:
        wanted[str(g)] = _fold(wanted[str(g)], v) if str(g) in wanted else v
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        found = [(str(r["g"]), json.loads(r["d"])) for r in merge.merged(df, ["g"], "d", ["k"]).collect()]
    finally:
        spark.conf.set(name, before)
    assert len(found) == 3 and dict(found) == wanted
