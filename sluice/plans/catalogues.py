"""Message catalogues, and sources of logins held against what users may have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events
from sluice.functions import catalogue, net

CASES = Cases()

SUBJECTS, VERBS = 20, 8
#: A catalogue made by rule: three templates for each subject and verb, of which two fit the same messages.
TEMPLATES: list[catalogue.Template] = [
    (f"{form}-{s}-{v}", template.format(s=s, v=v), names)
    for s in range(SUBJECTS)
    for v in range(VERBS)
    for form, template, names in (
        ("short", "unit{s} verb{v} %s", ["what"]), ("long", "unit{s} verb{v} %s after %d ms (%.1f%%)", ["what", "ms", "percent"]), ("prefixed", "%s: unit{s} verb{v} failed with %d errors", ["who", "errors"]),
    )
]


@CASES.add(f"""
    WITH e AS (SELECT event_id, event_type, user_id % {SUBJECTS} AS s, event_id % {VERBS} AS v, json_extract(props, '$.k')::BIGINT AS k, event_id % 5 AS form, user_id FROM {EVENTS})
    SELECT event_id, CASE WHEN form = 4 THEN NULL ELSE (CASE form WHEN 0 THEN 'short' WHEN 1 THEN 'long' WHEN 2 THEN 'prefixed' ELSE 'short' END) || '-' || s || '-' || v END AS rule,
        CASE form WHEN 0 THEN event_type WHEN 1 THEN event_type || ' now' WHEN 3 THEN event_type || ' after all' END AS what, CASE form WHEN 1 THEN k END AS ms, CASE form WHEN 2 THEN 'u' || user_id END AS who, CASE form WHEN 2 THEN k END AS errors FROM e""")
def catalogue_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a catalogue of 480 templates: the one with most captures is found through an index of words; one message in five has none."""
    k, unit = F.get_json_object("props", "$.k").cast("long"), F.format_string("unit%d verb%d", F.col("user_id") % SUBJECTS, F.col("event_id") % VERBS)
    message = F.element_at(F.array(
        F.concat(unit, F.lit(" "), F.col("event_type")), F.concat(unit, F.format_string(" %s now after %d ms (12.5%%)", F.col("event_type"), k)), F.concat(F.format_string("u%d: ", F.col("user_id")), unit, F.format_string(" failed with %d errors  ", k)),
        F.concat(unit, F.format_string(" %s after all", F.col("event_type"))), F.concat(F.lit("another "), unit),
    ), (F.col("event_id") % 5 + 1).cast("int"))
    found = catalogue.matched(events(spark, sf_dir).select("event_id", message.alias("message")), "message", catalogue.Catalogue(TEMPLATES))
    part = lambda name: F.try_element_at("template.fields", F.lit(name))
    return found.select("event_id", "template.rule", part("what").alias("what"), part("ms").cast("long").alias("ms"), part("who").alias("who"), part("errors").cast("long").alias("errors"))


@CASES.add(f"""
    WITH e AS (SELECT event_id, user_id, user_id % 7 AS u, event_id % 6 AS form, json_extract(props, '$.k')::BIGINT AS k, sec FROM {EVENTS}),
    v AS (SELECT *, CASE WHEN form = 5 THEN NULL WHEN u = 0 AND form = 0 AND k < 64 THEN 'network' WHEN u = 1 AND form = 1 AND k % 16 < 8 THEN 'network' WHEN u IN (0, 2) AND k % 10 = 3 THEN 'place' WHEN form = 2 AND k >= 50 THEN 'any network' WHEN form = 3 THEN 'any network' WHEN k % 10 = 9 THEN 'any place' END AS basis FROM e)
    SELECT event_id, basis, CASE WHEN form = 5 THEN NULL WHEN basis IS NOT NULL THEN 'expected' WHEN u IN (0, 1, 2) THEN 'anomaly' ELSE 'no spec' END AS verdict, event_id % 10 = 0 AS drifted FROM v""")
def login_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins from addresses of both versions against the users' own networks and places, then anyone's; messages whose time drifts are marked."""
    k = F.get_json_object("props", "$.k").cast("long")
    ip = F.element_at(F.array(
        F.format_string("10.0.%d.5", k * 4), F.format_string("2001:db8:0:%x::1", k % 16), F.format_string("2001:db8:ffff::%x:1", k + 1000), F.format_string("::ffff:192.168.0.%d", k), F.format_string("fe80::%x%%eth0", k), F.lit(None).cast("string"),
    ), (F.col("event_id") % 6 + 1).cast("int"))
    sent = F.col("sec") + F.when(F.col("event_id") % 10 == 0, F.when(F.col("event_id") % 20 == 0, 700).otherwise(-700)).otherwise(60)
    logins = events(spark, sf_dir).select("event_id", (F.col("user_id") % 7).cast("string").alias("user"), ip.alias("ip"), F.concat(F.lit("town-"), (k % 10).cast("string")).alias("place"), net.drifted(sent, F.col("sec")).alias("drifted"))
    specs = [
        ("0", "10.0.0.0/16", None), ("0", "10.0.255.0/24", None), ("0", None, "town-3"), ("1", "2001:DB8::/61", None), ("1", "not/a/network", None), ("2", None, "town-3"),
        ("*", "2001:db8:ffff::41a:0/112", None), ("*", "192.168.0.0/24", None), ("*", None, "town-9"),
    ] + [("*", f"2001:db8:ffff::{n:x}:0/112", None) for n in range(1050, 1100)]
    table = spark.createDataFrame(specs, "user string, cidr string, place string")
    return net.source_verdicts(logins, "user", "ip", "place", table).select("event_id", "basis", "verdict", "drifted")
