"""Message catalogues, addresses of both versions, sources of logins, and rules of build logs, against plain Python."""

from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from sluice.functions import catalogue, net, programs
from sluice.operators import logrules
from sluice.operators.logrules import Rule

# --- catalogues

SAMPLES = {"s": "some words", "d": "-7", "u": "12", "x": "ff", "f": "2.50", "g": "1e3", "c": "q", "i": "3"}


def _sample(template: str, names: list[str]) -> str:
    """A message of a template with values of each conversion's kind."""
    import re

    return re.sub(r"%(%|[-+ 0#]*\d*(?:\.\d+)?(?:l|ll|h|z)?([diuxfgcs]))", lambda m: "%" if m[1] == "%" else "10.0.0.9" if m[2] == "s" and names and any(n in ("ip", "src", "dst") for n in names) else SAMPLES[m[2]], template)


def _all_templates() -> list[catalogue.Template]:
    seen, out = set(), []
    for program, rules in programs.TEMPLATES.items():
        for rule, template, names in rules:
            if template not in seen:
                seen.add(template)
                out.append((f"{program}/{rule}", template, names))
    return out


def test_every_template_is_found_by_its_own_sample():
    """The best match has as many captures as the sample's own template or more, and comes first among equals; all are tried by brute force."""
    templates = _all_templates()
    made = catalogue.Catalogue(templates)
    alone = [catalogue.Catalogue([t]) for t in templates]
    assert len(templates) > 70
    for _, template, names in templates:
        message = _sample(template, names)
        fits = [k for k, one in enumerate(alone) if one.match(message)]
        best = min(fits, key=lambda k: (-len(templates[k][2]), k))
        found = made.match(message)
        assert found and found[:2] == (templates[best][0], best)
        assert len(made.candidates(message)) < len(templates) / 3


def test_samples_choose_a_smaller_catalogue():
    made = catalogue.Catalogue([("a", "start %s", ["x"]), ("b", "start %s at %d", ["x", "n"]), ("c", "%s%s", ["x", "y"]), ("d", "stop", [])])
    assert made.match("start it at 5") == ("b", 1, {"x": "it", "n": "5"})
    assert made.match("start it")[0] == "c" and made.match("stop  ")[0] == "c"  # two captures beat one and none
    assert [t[0] for t in made.of_samples(["start it at 5", "start at 9"]).templates] == ["b", "c"]
    with pytest.raises(ValueError, match="no template"):
        catalogue.Catalogue([("d", "stop", [])]).of_samples(["go"])


def test_catalogue_over_rows_with_nulls(spark):
    made = catalogue.Catalogue([("b", "took %d ms", ["ms"]), ("p", "%5.1f%% of %s", ["share", "what"])])
    rows = spark.createDataFrame([(1, "took 5 ms"), (2, None), (3, ""), (4, " 12.5% of all"), (5, "took five ms"), (6, "took 5 ms")], "id int, m string")
    found = {r["id"]: r["template"] and (r["template"]["rule"], r["template"]["fields"]) for r in catalogue.matched(rows, "m", made).collect()}
    assert found == {1: ("b", {"ms": "5"}), 2: None, 3: None, 4: ("p", {"share": "12.5", "what": "all"}), 5: None, 6: ("b", {"ms": "5"})}


# --- networks


def _addresses(rng: random.Random) -> list[str]:
    out = ["::", "::1", "1::", "::ffff:1.2.3.4", "64:ff9b::10.0.0.1", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "FFFF::A", "0.0.0.0", "255.255.255.255"]
    for _ in range(150):
        out.append(str(ipaddress.IPv4Address(rng.randrange(2**32))) if rng.random() < 0.4 else str(ipaddress.IPv6Address(rng.choice([0x2001_0DB8 << 96, 0, 0xFFFF << 32]) + rng.randrange(2 ** rng.choice([8, 40, 96])))))
    return out


BAD = ["", "1.2.3", "1.2.3.256", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "::1.2.3", "no address", ":1", "1:", "1:2:3:4:5:6:7:8::"]


def _whole(text: str) -> int:
    ip = ipaddress.ip_address(text.split("%")[0])
    return int(ip) + (0xFFFF << 32 if ip.version == 4 else 0)


def test_addresses_of_both_versions(spark):
    good = _addresses(random.Random(5))
    df = spark.createDataFrame([(t,) for t in [*good, *BAD, None]], "t string")
    found = {r["t"]: r["h"] for r in df.select("t", net.address_hex(F.col("t")).alias("h")).collect()}
    assert found == {t: f"{_whole(t):032x}" for t in good} | dict.fromkeys([*BAD, None])


def test_longest_network_of_both_versions(spark):
    rng = random.Random(6)
    asked = _addresses(rng)
    nets = {}
    for k, text in enumerate(rng.sample(asked, 60)):
        plain, bits = text.split("%")[0], rng.randrange(33 if "." in text and ":" not in text else 129)
        nets[str(ipaddress.ip_network(f"{plain}/{bits}", strict=False))] = k
    nets |= {"broken/8": 900, "1.2.3.4/40": 901, "::/200": 902}
    table = spark.createDataFrame(list(nets.items()), "cidr string, n int")
    found = {r["ip"]: r["n"] for r in net.in_networks(spark.createDataFrame([(t,) for t in [*asked, *BAD, None]], "ip string"), "ip", table, "cidr").collect()}

    def plain(text):
        best = None
        for cidr, n in nets.items():
            if n < 900:
                own = ipaddress.ip_network(cidr)
                bits = own.prefixlen + (96 if own.version == 4 else 0)
                low = int(own.network_address) + (0xFFFF << 32 if own.version == 4 else 0)
                if _whole(text) >> (128 - bits) == low >> (128 - bits) and (best is None or bits > best[0]):
                    best = (bits, n)
        return best and best[1]

    assert found == {t: plain(t) for t in asked} | dict.fromkeys([*BAD, None])


def test_sources_of_logins(spark):
    specs = spark.createDataFrame([("a", "10.0.0.0/8", None), ("a", None, "X"), ("b", None, "Y"), ("*", "2001:db8::/32", None), ("*", None, "Z")], "user string, cidr string, place string")
    rows = [("a", "10.1.1.1", None), ("a", "11.1.1.1", "X"), ("a", "2001:db8::5", "Y"), ("a", "9.9.9.9", "Z"), ("a", "9.9.9.9", "Q"), ("b", "10.1.1.1", "Q"), ("c", "10.1.1.1", "Q"), ("c", "9.9.9.9", "Z"), (None, "10.1.1.1", "Z"), ("a", None, "X"), ("c", "junk", None)]
    found = {(r["who"], r["ip"], r["place"]): (r["basis"], r["verdict"]) for r in net.source_verdicts(spark.createDataFrame(rows, "who string, ip string, place string"), "who", "ip", "place", specs).collect()}
    wanted = [("network", "expected"), ("place", "expected"), ("any network", "expected"), ("any place", "expected"), (None, "anomaly"), (None, "anomaly"), (None, "no spec"), ("any place", "expected"), (None, None), (None, None), (None, "no spec")]
    assert found == dict(zip(rows, wanted, strict=True))


# --- build logs

RULES = [
    Rule("link", "took", r"^linked (\w+) in (\d+)ms$", 1, 2, 0.001), Rule("get", "until next line", "^get"), Rule("put", "since line before", "^put"), Rule("wait", "until next match", "^wait"),
    Rule("part", "block begins", r"^> (\w+)", 1), Rule("part", "block ends", r"^< (\w+)", 1),
]


def test_rules_look_around(spark):
    lines = ["get it", "nothing", "wait", "nothing", "put it", "linked lib in 500ms", "> a", "> b", "< a", "< a", "> b", "get last"]
    df = spark.createDataFrame([(1, k, k * 10, t) for k, t in enumerate(lines)] + [(2, 0, 5, "put first"), (2, 1, 6, "wait"), (2, 2, 7, "end")], "task int, i int, sec int, m string")
    found = {(r["task"], r["component"], r["part"], r["start"], r["finish"]) for r in logrules.timings(df, ["task"], "i", "sec", "m", RULES).collect()}
    assert found == {(1, "get", None, 0.0, 10.0), (1, "wait", None, 20.0, 40.0), (1, "put", None, 30.0, 40.0), (1, "link", "lib", 49.5, 50.0), (1, "part", "a", 60.0, 80.0), (1, "get", None, 110.0, 110.0), (2, "put", None, 5.0, 5.0)}
    left = logrules.open_blocks(df, ["task"], "i", "m", RULES)
    assert [(r["component"], r["part"], r["i"]) for r in left.collect()] == [("part", "b", 10)]
    for state, n in (("completed", 1), ("failed", 0)):
        tasks = spark.createDataFrame([(1, state), (2, "completed")], "task int, state string")
        assert [r["detail"] for r in logrules.unclosed(left, ["task"], tasks, "state").collect()] == ["Grammar part, b unfinished"] * n
    for bad in (("x", "took", "."), ("x", "sometimes", "."), ("x", "until next line", ".", 0, 1)):
        with pytest.raises(ValueError, match="x"):
            Rule(*bad)


def test_runs_of_a_task(spark):
    document = '{"runId": 2, "status": {"runs": [{"runId": 0, "state": "exception", "resolved": "2024-01-01T00:00:05Z"}, {"runId": 1, "state": "failed", "started": "2024-01-01T00:01:00Z", "resolved": "2024-01-01T00:02:00Z"}, {"runId": 2, "state": "completed", "reasonResolved": "done", "started": "2024-01-01T00:03:00Z", "resolved": "2024-01-01T00:04:00Z"}]}}'
    rows = spark.createDataFrame([(1, document), (2, "{}"), (3, None)], "task int, d string")
    found = logrules.expanded_runs(rows, F.col("d"), ["task"]).orderBy("run").select("task", "run", "state", "reason", F.unix_seconds("started").alias("s"), F.unix_seconds("resolved").alias("r")).collect()
    base = 1704067200
    assert [tuple(r) for r in found] == [(1, 0, "exception", None, base + 5, base + 5), (1, 2, "completed", "done", base + 180, base + 240)]
