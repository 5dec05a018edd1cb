"""Operators on small rows: golden facts, edge cases and brute force."""

from __future__ import annotations

import json
import math
import random
from collections import Counter
from urllib.parse import quote, quote_plus, urlencode

import pytest
from pyspark.sql import functions as F

from sluice.functions import grammar, jsonx, net, normalize, programs, stats
from sluice.operators import alerts, blocks, dedup, histogram, intervals, sketches, timeseries
from sluice.sources import readers, sinks


def test_stats_skip_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    row = df.agg(*stats.summary("v")).first()
    assert (row["n"], row["sum"], row["avg"], row["variance"]) == (4, 10.0, 2.5, 1.25)


def test_stats_of_nothing(spark):
    row = spark.createDataFrame([(float("nan"),)], "v double").agg(*stats.summary("v")).first()
    assert (row["n"], row["sum"], row["avg"], row["min"]) == (0, 0.0, 0.0, None)


@pytest.mark.parametrize(("x", "p"), [(1.0, 0.841344746), (2.0, 0.977249868), (3.0, 0.998650102), (-1.0, 0.158655254), (0.0, 0.5)])
def test_normal_distribution(spark, x, p):
    assert spark.range(1).select(stats.ndtr(F.lit(x))).first()[0] == pytest.approx(p, abs=1e-8)


def test_rank_sum_against_plain_python(spark):
    """u counts the pairs that x wins, halves for ties; p is that of the normal distribution with the ties taken off."""
    rng = random.Random(41)
    rows = [(float(rng.randrange(30)), rng.random() < 0.3) for _ in range(170)]
    x, y = [v for v, k in rows if k], [v for v, k in rows if not k]
    u, n = sum((a > b) + (a == b) / 2 for a in x for b in y), len(rows)
    ties = sum(c**3 - c for c in Counter(v for v, _ in rows).values())
    sd = math.sqrt(len(x) * len(y) / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, len(x) * len(y) - u) - len(x) * len(y) / 2 - 0.5) / sd
    row = stats.mann_whitney(spark.createDataFrame(rows, "v double, x boolean"), "v", "x").first()
    assert (row["n1"], row["n2"], row["u"]) == (len(x), len(y), u)
    assert row["z"] == pytest.approx(z) and row["p"] == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, abs=1e-9)


def test_rank_sum_of_equal_values(spark):
    tied = stats.mann_whitney(spark.createDataFrame([(1.0, True), (1.0, False)], "v double, x boolean"), "v", "x").first()
    assert tied["z"] is None and tied["p"] is None


def test_one_deletion_undoes_all_additions(spark):
    steps = [("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 1, False), ("b", 2, True), ("c", 1, True), ("c", 2, False), ("c", 3, True), ("c", 4, True), (None, 1, True)]
    held = dedup.members(spark.createDataFrame(steps, "k string, t long, added boolean"), ["k"], "added", ["t"])
    assert {r["k"]: r["adds"] for r in held.collect()} == {"b": 1, "c": 3, None: 1}


def test_series_keeps_the_newest_rows_and_fills_gaps(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (5, 5.0), (5, float("nan")), (9, 9.0)], "sec long, v double")
    made = timeseries.cells(df, "sec", 1, {"s": ("v", "sum"), "l": ("v", "last")})
    kept = timeseries.retain(made, 5, 1)
    assert [r["bucket"] for r in kept.orderBy("bucket").collect()] == [5, 9]
    full = {r["bucket"]: r["s"] for r in timeseries.spine(kept, 1).collect()}
    assert full == {5: 5.0, 6: None, 7: None, 8: None, 9: 9.0}


def test_series_text_keeps_missing_values(spark):
    df = spark.createDataFrame([(0, 1.5), (60, None)], "bucket long, v double")
    assert timeseries.from_text(timeseries.to_text(df, ["v"]), ["v"]).orderBy("bucket").collect() == df.orderBy("bucket").collect()


def test_ttl_marks(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 60, 2), ("a", 60 * 300, 3)], "k string, sec long, id long")
    rows = {r["id"]: (r["added"], r["delta"]) for r in dedup.ttl_marks(df, ["k"], "sec", "id", 60).collect()}
    assert rows == {1: (True, None), 2: (False, 1), 3: (True, None)}


def test_bloom_filter_has_no_false_negative(spark):
    bits, hashes = sketches.bloom_bits(1000, 0.01)
    inside, outside = spark.range(1000).withColumnRenamed("id", "v"), spark.range(5000, 7000).withColumnRenamed("id", "v")
    made = sketches.bloom_filter(inside, "v", bits, hashes)
    assert sketches.bloom_query(inside, "v", made, bits, hashes).filter("not maybe").count() == 0
    assert sketches.bloom_query(outside, "v", made, bits, hashes).filter("maybe").count() < 60


def test_sketch_error(spark):
    """Merged partial sketches count 30,000 hashed values to two in a hundred; repeats don't count."""
    df = spark.range(90_000).select(F.sha1((F.col("id") % 30_000).cast("string")).alias("v"), F.pmod(F.hash("id"), F.lit(11)).alias("k"))
    n = sketches.merged(sketches.partial_distinct(df, ["k"], "v"), []).select(sketches.estimate()).first()[0]
    assert abs(n - 30_000) < 600


def _throttle(times: list[int], width: int) -> list[int]:
    sent: list[int] = []
    for t in sorted(set(times)):
        if not sent or t - sent[-1] > width:
            sent.append(t)
    return sent


def test_throttle_against_brute_force(spark):
    rng = random.Random(3)
    times = {k: [rng.randrange(20_000) for _ in range(200)] for k in "abc"}
    df = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "k string, sec long")
    found = {k: sorted(r["sec"] for r in alerts.throttled(df, ["k"], "sec", 5).collect() if r["k"] == k) for k in times}
    assert found == {k: _throttle(ts, 300) for k, ts in times.items()}


def test_threshold_falls_back(spark):
    limits = spark.createDataFrame([("a", 1.0), ("*", 5.0)], "k string, l double")
    rows = alerts.with_threshold(spark.createDataFrame([("a",), ("b",)], "k string"), "k", limits, "l", 9.0)
    assert {r["k"]: r["threshold"] for r in rows.collect()} == {"a": 1.0, "b": 5.0}
    none = alerts.with_threshold(spark.createDataFrame([("b",)], "k string"), "k", limits.filter("k = 'a'"), "l", 9.0)
    assert none.first()["threshold"] == 9.0


def test_interval_join_against_brute_force(spark):
    rng = random.Random(5)
    spans = [(k, i, a := rng.randrange(500), a + rng.randrange(0, 120)) for i in range(120) for k in [rng.choice("xy")]]
    df = spark.createDataFrame(spans, "k string, id long, a long, b long")
    found = {(r["id"], r["other"]) for r in intervals.overlaps(df, ["k"], "id", "a", "b", 50).collect()}
    assert found == {(i, j) for k, i, a, b in spans for m, j, s, _ in spans if k == m and a <= s < b}


def test_longest_network_wins(spark):
    nets = spark.createDataFrame([("10.0.0.0/8", 1), ("10.1.0.0/16", 2), ("0.0.0.0/0", 0)], "cidr string, n int")
    ips = spark.createDataFrame([("10.1.2.3",), ("10.2.2.3",), ("8.8.8.8",), ("no address",), (None,)], "ip string")
    assert {r["ip"]: r["n"] for r in net.in_networks(ips, "ip", nets, "cidr").collect()} == {"10.1.2.3": 2, "10.2.2.3": 1, "8.8.8.8": 0, "no address": None, None: None}


def test_addresses(spark):
    row = spark.range(1).select(net.ip_number(F.lit("1.2.3.4")).alias("n"), net.ip_number(F.lit("1.2.3.400")).alias("bad")).first()
    assert row["n"] == 16909060 and row["bad"] is None
    assert spark.range(1).select(net.ip_text(F.lit(16909060))).first()[0] == "1.2.3.4"


def test_logfmt_against_generated_pairs(spark):
    """Lines made from random pairs: quoted where the value needs it, bare where it is true, some names twice."""
    rng = random.Random(13)
    rows = []
    for _ in range(60):
        pairs = [(rng.choice(["level", "x.y", "µ", "id-7", "n/a"]), rng.choice(["true", "17", "", "two words", 'say "hi"', "back\\slash", "tab\tend", "é=ü", "[a]"])) for _ in range(rng.randrange(7))]
        shown = [k if v == "true" and rng.random() < 0.5 else f"{k}={json.dumps(v)}" if not v or set(v) & set(' "\\\t=') else f"{k}={v}" for k, v in pairs]
        rows.append(("  ".join(shown), dict(pairs)))
    found = spark.createDataFrame([(k, line) for k, (line, _) in enumerate(rows)], "k int, line string").select("k", grammar.logfmt(F.col("line")).alias("m"))
    assert {r["k"]: r["m"] for r in found.collect()} == {k: made for k, (_, made) in enumerate(rows)}


def test_access_log_that_does_not_match(spark):
    made = grammar.access_log('$remote_addr "$request" $status')
    rows = spark.createDataFrame([('1.2.3.4 "GET / HTTP/1.1" 200',), ("noise",), (None,)], "l string")
    assert [r["f"]["status"] if r["f"] else None for r in rows.select(grammar.parse(F.col("l"), made).alias("f")).collect()] == [200, None, None]


def test_query_map_against_generated_queries(spark):
    """Queries that the standard library encodes come back; of repeated names the last counts."""
    rng = random.Random(17)
    rows = []
    for _ in range(80):
        pairs = [(rng.choice(["q", "page", "a b", "ñ", "x[1]"]), rng.choice(["", "7", "two words", "50%", "a=b", "c&d", "ü/ß", "#"])) for _ in range(rng.randrange(6))]
        query = urlencode(pairs, quote_via=rng.choice([quote, quote_plus]))
        rows.append((f"https://host.test/some/path?{query}{rng.choice(['', '#part', '#?z=1'])}", dict(pairs)))
    rows += [("https://host.test/no/query", {}), ("https://host.test/?&&lone&=nameless&", {"lone": ""})]
    found = spark.createDataFrame([(k, url) for k, (url, _) in enumerate(rows)], "k int, url string").select("k", grammar.query_map(F.col("url")).alias("m"))
    assert {r["k"]: r["m"] for r in found.collect()} == {k: made for k, (_, made) in enumerate(rows)}


@pytest.mark.parametrize(("name", "made"), [("FooBar?", "foo_bar_"), ("already_fine", "already_fine"), ("nationName", "nation_name")])
def test_hive_names(name, made):
    assert grammar.hive_name(name) == made


def test_normalised_names(spark):
    row = spark.range(1).select(normalize.system(F.lit("Darwin")).alias("s"), normalize.channel(F.lit("beta-x")).alias("c"), normalize.dimension(F.lit(None).cast("string"), ["a"]).alias("u"), normalize.dimension(F.lit("z"), ["a"]).alias("o"), normalize.printable(F.lit("aé")).alias("p")).first()
    assert tuple(row) == ("Mac", "beta", "UNKNOWN", "OTHER", "a?")


def test_json_rules_in_order(spark):
    rows = spark.createDataFrame([('{"a": 5}',), ('{"a": 50}',), ("{",), ("{}",)], "d string")
    found = rows.select(jsonx.checked("d", "a long", {"there": lambda v: v["a"].isNotNull(), "small": lambda v: v["a"] < 9}).alias("c"))
    assert [r["c"]["error"] for r in found.collect()] == [None, "small", "json", "there"]


def test_flatten_stops_at_depth(spark):
    df = spark.sql("select named_struct('a', 1, 'n', named_struct('b', 2, 'm', named_struct('c', 3))) as s")
    assert jsonx.flatten(df, "s").first().asDict() == {"a": 1, "n.b": 2, "n.m.c": 3}
    assert jsonx.flatten(df, "s", max_depth=2).first().asDict() == {"a": 1, "n.b": 2, "n.m": '{"c":3}'}


def test_blocks_unbalanced(spark):
    lines = [(1, k, *x) for k, x in enumerate([("start", "a", 1), ("start", "b", 2), ("end", "zzz", 3), ("end", "a", 4), ("start", "c", 5)])] + [(2, 0, "end", "a", 1)]
    rows = blocks.blocks(spark.createDataFrame(lines, "task long, place long, mark string, name string, sec long")).collect()
    assert {(r["task"], r["name"], r["level"], r["start"], r["finish"], r["closed"]) for r in rows} == {(1, "b", 1, 2, 4, False), (1, "a", 0, 1, 4, True), (1, "c", 0, 5, 5, False)}


def test_partitioned_sink_names_missing_dimensions(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 1), (None, 2)], "d string, v long")
    sinks.write_partitioned(df, str(tmp_path / "out"), ["d"])
    assert {r["d"]: r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a_b": 1, "UNKNOWN": 2}


def test_multi_line_records(spark):
    lines = spark.createDataFrame([("f", 0, "tail"), ("f", 1, "# one"), ("f", 2, "more"), ("f", 3, "# two")], "file string, place long, value string")
    rows = readers.multi_line(lines, "^#", ["file"], "place").orderBy("first").collect()
    assert [r["record"] for r in rows] == ["tail", "# one\nmore", "# two"]


def test_counter_deltas_after_restart(spark):
    df = spark.createDataFrame([("p", 1, 10), ("p", 2, 15), ("p", 3, 4)], "k string, t long, n long")
    assert [r["n"] for r in readers.counter_deltas(df, ["k"], "t", ["n"]).orderBy("t").collect()] == [10, 5, 4]


def test_json_messages_side_output(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"type": "a", "pid": 3, "fields": {"x": "1"}}\n{oops\n')
    rows = readers.json_messages(spark, str(tmp_path / "m.json")).collect()
    assert {(r["type"], r["pid"], r["decode_error"]) for r in rows} == {("a", 3, None), (None, None, "{oops")}


def test_histogram_slots(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (1e9,)], "v double")
    assert [r[0] for r in df.select(histogram.exponential_slot(F.col("v"), 10)).collect()] == [0, 0, 9]
    assert math.isclose(sum(r["share"] for r in histogram.shares(histogram.counts(df, [], histogram.linear_slot(F.col("v"), 1.0, 3)), []).collect()), 1, abs_tol=1e-5)


#: How each browser presents itself on a system, as a pattern of (system's words, version); the agents of the test are made from these.
SHAPES = {
    "Firefox": "Mozilla/5.0 ({0}; rv:{1}.0) Gecko/20100101 Firefox/{1}.0", "Chrome": "Mozilla/5.0 ({0}) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/{1}.0.0.0 Safari/537.36",
    "Edge": "Mozilla/5.0 ({0}) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0.0.0 Safari/537.36 Edg/{1}.0.0.0", "Opera": "Mozilla/5.0 ({0}) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0.0.0 Safari/537.36 OPR/{1}.0.0.0",
    "Safari": "Mozilla/5.0 ({0}) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/18.1 Safari/{1}.1.15", "MSIE": "Mozilla/5.0 ({0}; Trident/7.0; rv:{1}.0) like Gecko",
}
WORDS = {"Windows NT 10.0; Win64; x64": "Windows 10", "Windows NT 6.3; WOW64": "Windows 8.1", "Macintosh; Intel Mac OS X 10_15_7": "Macintosh", "X11; Linux x86_64": "Linux", "Linux; Android 14; Pixel 8": "Android", "iPhone; CPU iPhone OS 18_1 like Mac OS X": "iPhone", "iPad; CPU OS 17_6 like Mac OS X": "iPad"}


def test_user_agents(spark):
    rng = random.Random(19)
    rows = [(shape.format(words, version := rng.randrange(60, 140)), (browser, version, system)) for browser, shape in SHAPES.items() for words, system in WORDS.items()]
    rows += [("sluice-crawler/4 (+https://host.test)", (None, None, None)), ("", (None, None, None)), (None, (None, None, None)), ("Linux only", (None, None, "Linux"))]
    found = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(rows)], "k int, text string").select("k", grammar.user_agent(F.col("text")).alias("u"))
    assert {r["k"]: tuple(r["u"]) for r in found.collect()} == {k: made for k, (_, made) in enumerate(rows)}


def test_only_a_local_session_may_lack_a_shared_folder(spark):
    from types import SimpleNamespace

    from sluice.session import shared_dir

    def session(master, named=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named or default), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))

    assert shared_dir(session("local[4]")) == shared_dir(session("local[4]"))
    assert shared_dir(session("yarn", "s3a://bucket/x")) == "s3a://bucket/x"
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))


def test_starts_within_against_pairs(spark):
    rng = random.Random(5)
    rows = [(k % 3, k, a := rng.randrange(500), a + rng.choice([0, 1, 40, 300])) for k in range(200)]
    made = {r["id"]: r["starts"] for r in intervals.starts_within(spark.createDataFrame(rows, "k long, id long, a long, b long"), ["k"], "a", "b", 50).collect()}
    assert made == {i: sum(k == x and a <= s < b for x, _, s, _ in rows) for k, i, a, b in rows if b > a}


def test_ranks_by_ranges(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(float(rng.randrange(300)), rng.random() < 0.4) for _ in range(900)], "v double, x boolean")
    assert stats.mann_whitney(df, "v", "x", ranges=1).first() == stats.mann_whitney(df, "v", "x", ranges=40).first()


@pytest.mark.parametrize(
    ("message", "rule", "fields"),
    [
        ("Accepted publickey for bob from 2001:db8::7 port 50022 ssh2: RSA SHA256:abc+/", "accepted", {"user": "bob", "ip": "2001:db8::7", "port": "50022", "fingerprint": "SHA256:abc+/"}),
        ("Invalid user bob from 10.0.0.1 port 4000", "invalid_user", {"user": "bob", "ip": "10.0.0.1", "port": "4000"}), ("Invalid user a b from 10.0.0.1", "invalid_user", {"user": "a b", "ip": "10.0.0.1"}),
        ("Connection closed by 10.0.0.1 port 22 [preauth]", "closed", {"ip": "10.0.0.1", "port": "22"}), ("Connection closed by authenticating user root 10.0.0.9 port 7 [preauth]", "closed", {"user": "root", "ip": "10.0.0.9"}),
        ("Received disconnect from 10.0.0.1 port 99:11: bye now", "disconnect", {"ip": "10.0.0.1", "code": "11", "reason": "bye now"}),
    ],
)
def test_sshd_messages(spark, message, rule, fields):
    found = spark.range(1).select(programs.program_fields(F.lit("sshd"), F.lit(message)).alias("p")).first()["p"]
    assert found["rule"] == rule and fields.items() <= found["fields"].items()


def test_padded_numbers_and_exact_times(spark):
    made = spark.range(1).select(
        grammar.parse(F.lit("took   1.20 s,    7 rows"), grammar.printf("took %6.2f s, %4d rows", ["took", "rows"])).alias("a"),
        grammar.parse(F.lit("<34>2024-05-01T10:00:00.123456+02:00 h sshd[7]: x"), grammar.syslog()).alias("b"),
        grammar.parse(F.lit("<34>2024-05-01T10:00:00Z h sshd: x"), grammar.syslog()).alias("c"),
    ).first()
    assert (made["a"]["took"], made["a"]["rows"]) == (1.2, 7)
    assert (made["b"]["time"], made["b"]["pid"], made["c"]["program"]) == ("2024-05-01T10:00:00.123456+02:00", 7, "sshd")
