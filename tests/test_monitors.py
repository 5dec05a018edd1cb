"""Path sets, days that are off, states of tasks, alerts with diagnostics and header rules against plain Python."""

from __future__ import annotations

import random
import statistics
from collections import Counter, defaultdict

import pytest

from sluice.functions import decoders
from sluice.operators import alerts, paths, timeseries


def test_path_sets_against_a_walk(spark):
    rng = random.Random(8)
    rows = [(rng.choice("xyz"), k, rng.choice("aabbc")) for k in range(400)] + [("only", 1, "a"), (None, 1, "a"), (None, 2, "b")]
    sets = {"ab": ("a", "b"), "aa": ("a", "a"), "abc": ("a", "b", "c")}
    found = {(r["name"], r["who"]): (r["runs"], r["paths"]) for r in paths.repeated_sets(spark.createDataFrame(rows, "who string, t int, p string"), "who", "p", ["t"], sets, 1).collect()}
    wanted = {}
    for who in ("x", "y", "z", "only", None):
        walk = [p for w, _, p in sorted((r for r in rows if r[0] == who), key=lambda r: r[1])]
        for name, steps in sets.items():
            best, m = 0, len(steps)
            for start in range(len(walk)):
                n = 0
                while tuple(walk[start + n * m : start + (n + 1) * m]) == steps:
                    n += 1
                best = max(best, n)
            if best:
                wanted[name, who] = (best, len(set(walk)))
    assert {k: v for k, v in found.items() if k[1] is not None} == {k: v for k, v in wanted.items() if k[1] is not None}
    few = paths.repeated_sets(spark.createDataFrame(rows, "who string, t int, p string"), "who", "p", ["t"], sets, 2, most_paths=3)
    assert {r["who"] for r in few.collect()} == set()


def test_days_that_are_off(spark):
    rng = random.Random(12)
    rows = [(k, d, float(rng.randrange(100) + (5000 if rng.random() < 0.05 else 0))) for k in ("a", None) for d in rng.sample(range(60), 45) for _ in range(2)]
    found = {(r["k"], r["d"]) for r in timeseries.off_days(spark.createDataFrame(rows, "k string, d long, v double"), ["k"], "d", "v", 7, 3.0, 500.0).collect()}
    sums = defaultdict(Counter)
    for k, d, v in rows:
        sums[k][d] += v
    wanted = set()
    for k, days in sums.items():
        for d, v in days.items():
            before = [days[x] for x in range(d - 7, d) if x in days]
            if len(before) >= 2 and abs(v - statistics.mean(before)) >= 3 * statistics.pstdev(before) and abs(v - statistics.mean(before)) > 500:
                wanted.add((k, d))
    assert found == wanted and wanted


def test_states_of_tasks(spark):
    lines = [("w", 1, 0, "pending", 5, False), ("w", 1, 0, "running", 10, True), ("w", 1, 0, "running", 70, True), ("w", 2, 0, "running", 65, True), ("w", 1, 0, "completed", 130, True), ("w", 3, 0, "exception", 140, False), ("w", 2, 0, "failed", 200, True), ("v", 9, 0, "completed", 10, True)]
    df = spark.createDataFrame(lines, "w string, task int, run int, state string, sec long, started boolean")
    found = {(r["w"], r["bucket"]): tuple(r[s] for s in timeseries.STATES) + (r["concurrency"],) for r in timeseries.task_states(df, ["w"], ["task", "run"], "state", "sec", "started", 60).collect()}
    assert found == {("w", 0): (1, 1, 0, 0, 0, 1), ("w", 60): (0, 1, 0, 0, 0, 2), ("w", 120): (0, 0, 1, 0, 1, 1), ("w", 180): (0, 0, 0, 1, 0, 0), ("v", 0): (0, 0, 1, 0, 0, 0)}


def test_alerts_need_rows_and_name_their_errors(spark):
    counts = spark.createDataFrame([("a", 0, 10, 90), ("a", 60, 100, 0), ("a", 240, 1, 2), ("b", 0, 1, 9)], "k string, bucket long, valid long, errors long")
    details = spark.createDataFrame([("a", 0, "x", 50), ("a", 0, "y", 30), ("a", 0, "z", 10), ("a", 240, "q", 2), ("b", 0, "x", 9)], "k string, bucket long, detail string, n long")
    found = {(r["k"], r["bucket"]): (r["valid"], r["errors"], r["percent"], r["diagnostic"]) for r in alerts.error_alerts(counts, details, ["k"], 60, 3, 20, 40.0, top=2).collect()}
    assert found == {("a", 0): (10, 90, 90.0, "50/x, 30/y"), ("a", 60): (110, 90, 45.0, "50/x, 30/y")}
    gone = alerts.silent(counts, ["k"], 60, 3, 300)
    assert [(r["k"], r["last"], r["silence"]) for r in gone.collect()] == [("b", 0, 5)]


def test_headers_by_rules(spark):
    rows = spark.createDataFrame([(1, "ann@x.org", None, "T"), (2, "cn=c,mail=bob.b@x.org,o=z", "h", None), (3, "arn:aws:sts::1:assumed-role/ops/cy", None, "T"), (4, "no name", None, None), (5, None, None, None)], "id int, mail string, host string, kind string")
    made = decoders.set_headers(rows.withColumn("user", decoders.user_name("mail")), {"kind": ("value", "K"), "host": ("first", ["host", "kind"], "none"), "text": ("template", "%{user}/%{kind}!"), "copy": ("field", "id")})
    assert [(r["user"], r["kind"], r["host"], r["text"], r["copy"]) for r in made.orderBy("id").collect()] == [
        ("ann", "K", "T", "ann/T!", 1), ("bob.b", "K", "h", "bob.b/!", 2), ("cy", "K", "T", "cy/T!", 3), (None, "K", "none", "/!", 4), (None, "K", "none", "/!", 5),
    ]
    with pytest.raises(ValueError, match="no such rule"):
        decoders.set_headers(rows, {"x": ("guess",)})
