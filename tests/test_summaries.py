"""Mergeable summaries against exact counts and ranks, however the rows are dealt and the parts merged."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluice.operators import frequent


def _rows(seed: int = 2, n: int = 6000):
    rng = random.Random(seed)
    return [(rng.choice("ab") if rng.random() < 0.9 else None, int(rng.paretovariate(0.7)) if rng.random() < 0.95 else None) for _ in range(n)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_bounded_lists_hold_their_bound(spark, parts):
    rows, size = _rows(), 12
    df = spark.createDataFrame(rows, "k string, v long").repartition(parts)
    found = frequent.misra_gries(df, ["k"], "v", size).collect()
    for k in ("a", "b", None):
        counts, own = Counter(v for x, v in rows if x == k and v is not None), [r for r in found if r["k"] == k]
        total = sum(x == k for x, _ in rows)
        assert len(own) <= size and {r["total"] for r in own} == {total}
        listed = {r["v"]: r for r in own}
        assert all(v in listed for v, n in counts.items() if n * (size + 1) > total)
        for v, r in listed.items():
            assert r["n"] <= counts[v] <= r["n"] + r["error"] and r["error"] * (size + 1) <= total


def test_a_list_with_room_is_exact(spark):
    rows = [("a", v % 5) for v in range(100)]
    found = frequent.misra_gries(spark.createDataFrame(rows, "k string, v long").repartition(4), ["k"], "v", 5).collect()
    assert sorted((r["v"], r["n"], r["error"]) for r in found) == [(v, 20, 0) for v in range(5)]
    assert frequent.misra_gries(spark.createDataFrame([], "k string, v long"), ["k"], "v", 5).collect() == []


def test_frequent_items_are_those_of_exact_counts(spark):
    rows = _rows(5)
    df = spark.createDataFrame(rows, "k string, v long")
    for share in (0.2, 0.03):
        found = {(r["k"], r["v"], r["n"]) for r in frequent.frequent(df, ["k"], "v", share).collect()}
        totals = Counter(k for k, _ in rows)
        assert found == {(k, v, n) for (k, v), n in Counter(rows).items() if v is not None and n > share * totals[k]}


def test_counters_merge_to_those_of_all_rows(spark):
    df = spark.createDataFrame([(h % 4, v) for h, (_, v) in enumerate(_rows(8))], "hour long, v long").filter("v is not null")
    hourly = frequent.count_min(df, ["hour"], "v", 0.01, 0.99)
    merged = frequent.merged_counters(hourly, [F.lit(0).alias("day")])
    whole = frequent.count_min(df.withColumn("day", F.lit(0)), ["day"], "v", 0.01, 0.99)
    assert sorted(map(tuple, merged.select("day", "line", "slot", "n").collect())) == sorted(map(tuple, whole.collect()))
    depth, width = frequent.count_min_size(0.01, 0.99)
    assert whole.count() <= depth * width
    exact = df.groupBy(F.lit(0).alias("day"), "v").agg(F.count("*").alias("n"))
    rows = frequent.estimated(merged, ["day"], exact, "v", 0.01, 0.99).collect()
    total = frequent.totals(merged, ["day"]).first()["total"]
    assert all(r["estimate"] >= r["n"] for r in rows) and total == sum(r["n"] for r in rows)
    assert sum(r["estimate"] > r["n"] + 0.01 * total for r in rows) <= 0.01 * len(rows)
    absent = spark.createDataFrame([(7, 1)], "day int, v long")
    assert frequent.estimated(merged, ["day"], absent, "v", 0.01, 0.99).first()["estimate"] == 0


def test_merged_quantiles_are_close(spark):
    rng = random.Random(4)
    values = [rng.lognormvariate(0, 2) for _ in range(20_000)] + [float("nan"), None]
    df = spark.createDataFrame([(k % 50, v) for k, v in enumerate(values)], "m long, v double")
    merged = frequent.merged_quantiles(frequent.quantile_sketches(df, ["m"], "v"), [(F.col("m") % 1).alias("all")])
    known = sorted(values[:-2])
    for share in (0.01, 0.5, 0.9, 0.999):
        found = merged.select(frequent.quantile("sketch", share)).first()[0]
        assert abs(sum(v <= found for v in known) / len(known) - share) < 0.025
