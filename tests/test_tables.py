"""Writes that change part of a table: twice the same, and untouched files keep their names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sluice.sources import tables


def _files(path) -> dict[str, float]:
    return {str(p): p.stat().st_mtime for p in path.rglob("*.parquet")}


SCHEMA = "id long, v string, day string"


def _rows(spark, path):
    return {(r["id"], r["v"], r["day"]) for r in spark.read.schema(SCHEMA).parquet(str(path)).collect()}


def test_range_is_replaced_and_the_rest_stays(spark, tmp_path):
    path = tmp_path / "t"
    old = spark.createDataFrame([(k, "old", f"2024-01-{k % 6 + 1:02d}") for k in range(60)], SCHEMA)
    tables.replace_range(old, str(path), "day", "2024-01-01", "2024-01-06")
    before = _files(path)
    new = spark.createDataFrame([(100, "new", "2024-01-02"), (101, "new", "2024-01-03")], SCHEMA)
    for _ in range(2):
        tables.replace_range(new, str(path), "day", "2024-01-02", "2024-01-04")
        kept = {(k, "old", d) for k in range(60) for d in [f"2024-01-{k % 6 + 1:02d}"] if d in ("2024-01-01", "2024-01-05", "2024-01-06")}
        assert _rows(spark, path) == kept | {(100, "new", "2024-01-02"), (101, "new", "2024-01-03")}
    after = _files(path)
    same = {f for f in before if "day=2024-01-01" in f or "day=2024-01-05" in f or "day=2024-01-06" in f}
    assert all(after.get(f) == before[f] for f in same)
    assert tables.partitions_of(spark, str(path), "day") == {f"2024-01-{d:02d}" for d in (1, 2, 3, 5, 6)}
    with pytest.raises(ValueError, match="isn't between"):
        tables.replace_range(new, str(path), "day", "2024-01-03", "2024-01-04")


def test_upsert_against_a_plain_merge(spark, tmp_path):
    path, rng = tmp_path / "t", random.Random(3)
    day = lambda: f"d/{rng.randrange(9)}"
    held = {}
    for batch in range(4):
        lot = [(rng.choice([*range(batch * 10, 40), None]), f"b{batch}-{k}", day() if batch < 3 else "d/1", k, rng.random() < 0.2) for k in range(25)]
        df = spark.createDataFrame(lot, "id long, v string, day string, at long, gone boolean")
        before = _files(path)
        moved = set()
        last = {}
        for row in lot:
            last[row[0]] = row
        for k, (_, v, d, _, gone) in last.items():
            if k in held:
                moved.add(held.pop(k)[2])
            if not gone:
                held[k] = (k, v, d)
                moved.add(d)
        changes = df.select("id", "v", "day", "at", "gone")
        for _ in range(2):
            tables.upsert(changes, str(path), ["id"], "day", ["at"], F.col("gone"))
        assert {(r["id"], r["v"], r["day"]) for r in spark.read.schema("id long, v string, at long, gone boolean, day string").parquet(str(path)).collect()} == set(held.values())
        after = _files(path)
        assert all(after.get(f) == t for f, t in before.items() if not any(f"day={m.replace('/', '%2F')}/" in f for m in moved))


def test_an_upsert_may_empty_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], SCHEMA)
    tables.upsert(rows, path, ["id"], "day", ["v"])
    tables.upsert(rows.limit(0), path, ["id"], "day", ["v"])
    assert _rows(spark, path) == {(1, "a", "x"), (2, "b", "y")}
    tables.upsert(rows, path, ["id"], "day", ["v"], F.lit(True))
    assert tables.partitions_of(spark, path, "day") == set()
