"""Security analytics: authentication anomalies, rates, injections, rules and alerts.

user_id is the subject, event_type the attribute or action, and an address made of both the source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events, floor_to, rounded
from sluice.functions import injection, net, programs
from sluice.operators import alerts, paths
from sluice.session import table

CASES = Cases()


@CASES.add(f"""
    SELECT user_id, sec // 86400 * 86400 AS bucket, count(*) AS n FROM (SELECT *, 300 + (json_extract(props, '$.k')::BIGINT * 3) AS code FROM {EVENTS}) WHERE code >= 400 AND code < 500 GROUP BY 1, 2 HAVING count(*) >= 2""")
def http_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with at least two client errors in a day."""
    code = 300 + F.get_json_object("props", "$.k").cast("long") * 3
    bad = events(spark, sf_dir).filter((code >= 400) & (code < 500))
    return bad.groupBy("user_id", floor_to("sec", 86400).alias("bucket")).agg(F.count("*").alias("n")).filter("n >= 2")


@CASES.add(f"""
    WITH s AS (SELECT *, lag(sec) OVER (PARTITION BY user_id, event_type ORDER BY sec, event_id) AS before FROM {EVENTS})
    SELECT event_id, user_id, event_type FROM s WHERE before IS NULL OR sec - before > 864000""")
def lastx_new_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that are new for their user, or not seen for ten days."""
    before = F.lag("sec").over(W.partitionBy("user_id", "event_type").orderBy("sec", "event_id"))
    return events(spark, sf_dir).withColumn("before", before).filter("before is null or sec - before > 864000").select("event_id", "user_id", "event_type")


def _remember(rows: Iterator[pd.DataFrame], slots: int, expiry: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by user and time; each user's newest `slots` attributes are remembered."""
    user, seen = None, {}
    for part in rows:
        flags = []
        for who, kind, sec in zip(part["user_id"], part["event_type"], part["sec"], strict=True):
            if who != user:
                user, seen = who, {}
            for old in [k for k, t in seen.items() if sec - t > expiry]:
                del seen[old]
            flags.append(kind not in seen)
            seen.pop(kind, None)
            seen[kind] = sec
            if len(seen) > slots:
                del seen[next(iter(seen))]
        yield part[flags][["event_id", "user_id", "event_type"]]


@CASES.add(f"""
    WITH e AS (SELECT event_id, user_id, event_type, sec, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS i FROM {EVENTS}),
    p AS (SELECT *, lag(i) OVER w AS j, lag(sec) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY i))
    SELECT event_id, user_id, event_type FROM p WHERE j IS NULL OR sec - before > 864000 OR (SELECT count(DISTINCT q.event_type) FROM e q WHERE q.user_id = p.user_id AND q.i > p.j AND q.i < p.i) >= 3""")
def lastx_new_attr_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that aren't among a user's three most recent ones: an ordered fold over sorted rows.

    A user's rows stream through one task; what is held is the three attributes, not the rows.
    """
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "sec").repartition("user_id").sortWithinPartitions("user_id", "sec", "event_id")
    return rows.mapInPandas(lambda parts: _remember(parts, 3, 864000), "event_id long, user_id long, event_type string")


@CASES.add(f"""
    WITH s AS (SELECT event_id, user_id, event_type AS track, sec, lag(event_type) OVER w AS t1, lag(event_type, 2) OVER w AS t2, lag(sec, 2) OVER w AS s2 FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id))
    SELECT event_id, user_id, track, t1 AS other, sec - s2 AS width FROM s WHERE track = t2 AND track <> t1 AND sec - s2 <= 43200""")
def simuse_aba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject that goes from one track to another and back within twelve hours."""
    own = W.partitionBy("user_id").orderBy("sec", "event_id")
    rows = events(spark, sf_dir).select("event_id", "user_id", F.col("event_type").alias("track"), "sec", F.lag("event_type").over(own).alias("other"), F.lag("event_type", 2).over(own).alias("first"), (F.col("sec") - F.lag("sec", 2).over(own)).alias("width"))
    return rows.filter("track = first and track <> other and width <= 43200").select("event_id", "user_id", "track", "other", "width")


#: Ordered path sets of the query, by name.
PATH_SETS = {"look": ("click", "view"), "three": ("view", "click", "purchase"), "same": ("view", "view")}
_RUNS = """SELECT '{name}' AS name, user_id, CAST(max(length(run) // {m}) AS BIGINT) AS runs FROM (SELECT user_id, unnest(regexp_extract_all(path, '({text})+')) AS run FROM t) GROUP BY 2"""


@CASES.add(f"""
    WITH t AS (SELECT user_id, string_agg(CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' WHEN 'purchase' THEN 'p' ELSE 'x' END, '' ORDER BY sec, event_id) AS path FROM {EVENTS} GROUP BY 1),
    d AS (SELECT user_id, count(DISTINCT event_type) AS paths FROM {EVENTS} GROUP BY 1),
    r AS ({_RUNS.format(name='look', m=2, text='cv')} UNION ALL {_RUNS.format(name='three', m=3, text='vcp')} UNION ALL {_RUNS.format(name='same', m=2, text='vv')})
    SELECT name, user_id, runs, paths FROM r JOIN d USING (user_id) WHERE runs >= 2 AND paths < 6""")
def pathset_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients that walk an ordered set of paths at least twice in a row, for several sets; clients with six paths or more are left out."""
    return paths.repeated_sets(events(spark, sf_dir), "user_id", "event_type", ["sec", "event_id"], PATH_SETS, least=2, most_paths=6)


@CASES.add("""
    WITH c AS (SELECT c_custkey, c_nationkey, '10.' || (c_custkey % 4) || '.' || (c_custkey % 200) || '.' || c_nationkey AS ip, c_custkey % 4 AS a, c_custkey % 200 AS b FROM customer)
    SELECT c_custkey, ip, CASE WHEN a = 1 AND b < 128 THEN '10.1.0.0/17' WHEN a IN (0, 1) THEN '10.0.0.0/15' WHEN a = 2 THEN '10.2.0.0/16' END AS cidr,
        CASE WHEN a = 3 THEN 'NOSPEC' WHEN (CASE WHEN a = 1 AND b < 128 THEN 1 WHEN a IN (0, 1) THEN 0 ELSE 2 END) <> c_nationkey % 3 THEN 'ANOMALY' ELSE 'OK' END AS verdict FROM c""")
def auth_geo_cidr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses looked up in networks, longest first, and held against the subject's region."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    ip = F.concat(F.lit("10."), (key % 4).cast("string"), F.lit("."), (key % 200).cast("string"), F.lit("."), nation.cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", ip.alias("ip"))
    networks = spark.createDataFrame([("10.0.0.0/15", 0), ("10.1.0.0/17", 1), ("10.2.0.0/16", 2)], "cidr string, region int")
    found = net.in_networks(rows, "ip", networks, "cidr")
    verdict = F.when(F.col("cidr").isNull(), "NOSPEC").when(F.col("region") != F.col("c_nationkey") % 3, "ANOMALY").otherwise("OK")
    return found.select("c_custkey", "ip", "cidr", verdict.alias("verdict"))


@CASES.add(f"""
    SELECT event_id, CASE WHEN event_type = 'error' AND k > 80 THEN 'critical' WHEN event_type = 'signup' AND k < 10 THEN 'enrol' WHEN event_type = 'purchase' THEN 'payment' WHEN k = 50 THEN 'middle' ELSE 'other' END AS rule
    FROM (SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM {EVENTS})""")
def rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rule that fits wins; a rule is a list of path and pattern that must all match."""
    document = F.to_json(F.struct("event_type", F.from_json("props", "k long").alias("props")))
    rules = [
        ("critical", {"$.event_type": "^error$", "$.props.k": "^(8[1-9]|9[0-9])$"}), ("enrol", {"$.event_type": "^signup$", "$.props.k": "^[0-9]$"}),
        ("payment", {"$.event_type": "^purchase$"}), ("middle", {"$.props.k": "^50$"}),
    ]
    chosen = F.lit("other")
    for name, fields in reversed(rules):
        fits = F.lit(True)
        for path, pattern in fields.items():
            fits = fits & F.coalesce(F.get_json_object("d", path).rlike(pattern), F.lit(False))
        chosen = F.when(fits, name).otherwise(chosen)
    return events(spark, sf_dir).select("event_id", document.alias("d")).select("event_id", chosen.alias("rule"))


@CASES.add("""
    SELECT c_custkey, reputation, CASE WHEN reputation <= 25 THEN 'critical' WHEN reputation <= 50 THEN 'high' ELSE 'medium' END AS band
    FROM (SELECT c_custkey, CAST(floor(greatest(c_acctbal, 0) / 100) AS INTEGER) AS reputation FROM customer) WHERE reputation <= 75""")
def reputation_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reputations of 75 at most, by band."""
    value = F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 100).cast("int")
    rows = table(spark, sf_dir, "customer").select("c_custkey", value.alias("reputation")).filter("reputation <= 75")
    return rows.withColumn("band", F.when(F.col("reputation") <= 25, "critical").when(F.col("reputation") <= 50, "high").otherwise("medium"))


@CASES.add(f"""
    WITH RECURSIVE r AS (SELECT user_id, sec, row_number() OVER (PARTITION BY user_id ORDER BY sec) AS i FROM (SELECT DISTINCT user_id, sec FROM {EVENTS} WHERE event_type = 'error')),
    s AS (SELECT user_id, i, sec, sec AS sent FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, r.sec, CASE WHEN r.sec - s.sent > 172800 THEN r.sec ELSE s.sent END FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
    SELECT user_id, sec FROM s WHERE sec = sent""")
def alert_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that raise an alert when a user is silent for two days after each one sent."""
    return alerts.throttled(events(spark, sf_dir).filter("event_type = 'error'"), ["user_id"], "sec", 2880)


@CASES.add(f"""
    WITH c AS (SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM {EVENTS} GROUP BY 1)
    SELECT event_type, n, mean, CASE event_type WHEN 'error' THEN 45.0 WHEN 'click' THEN 55.0 ELSE 50.0 END AS threshold FROM c WHERE mean > CASE event_type WHEN 'error' THEN 45.0 WHEN 'click' THEN 55.0 ELSE 50.0 END""")
def threshold_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean values above the type's own limit, or that for all types."""
    means = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), rounded(F.avg("value"), "mean"))
    limits = spark.createDataFrame([("error", 45.0), ("click", 55.0), ("*", 50.0)], "event_type string, limit double")
    return alerts.with_threshold(means, "event_type", limits, "limit", 99.0).filter("mean > threshold").select("event_type", "n", "mean", "threshold")


@CASES.add("""
    WITH u AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, CASE page_id % 7 WHEN 0 THEN 'xss' WHEN 1 THEN 'sqli' WHEN 2 THEN 'sqli' WHEN 3 THEN 'xss' END AS kind FROM pages WHERE url IS NOT NULL)
    SELECT host, kind, count(*) AS n, max(page_id) AS last FROM u WHERE kind IS NOT NULL GROUP BY 1, 2""")
def webinj_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query parameters that look like script or SQL injection, counted by host with the last example; others only hold their words."""
    sent = F.array(*map(F.lit, ("<script>x</script>", "1%27 OR 1=1", "7 union all select name, key from users", "%22 onfocus%3D%22x()", "union of select committees or clubs", "d'Artagnan and 2 others", "tea")))
    query = F.concat(F.lit("q="), F.element_at(sent, (F.col("page_id") % 7 + 1).cast("int")), F.lit("&lang=en"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.explode(F.str_to_map(query, F.lit("&"), F.lit("="))).alias("name", "value"))
    return rows.withColumn("kind", injection.kind(F.col("value"))).filter("kind is not null").groupBy("host", "kind").agg(F.count("*").alias("n"), F.max("page_id").alias("last"))


@CASES.add(f"SELECT event_id, 'user ' || user_id || ' ' || event_type || ' at ' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM {EVENTS} WHERE event_type IN ('signup', 'purchase')")
def auth_any_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert text for every login of two kinds."""
    rows = events(spark, sf_dir).filter("event_type in ('signup', 'purchase')")
    return rows.select("event_id", F.format_string("user %d %s at %s", F.col("user_id"), F.col("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("text"))


@CASES.add(f"""
    SELECT event_id, 'u' || user_id AS user, CASE WHEN sec % 1300 > 600 THEN 'drift' WHEN event_id % 2 = 0 THEN 'owner' ELSE 'global' END AS route FROM {EVENTS} WHERE event_type = 'signup'""")
def login_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins parsed from their line and routed: too old ones apart, known hosts to their owner, others to all."""
    line = F.format_string("Accepted publickey for u%d from 10.0.0.%d port 22 ssh2", F.col("user_id"), F.col("user_id") % 250)
    rows = events(spark, sf_dir).filter("event_type = 'signup'").select("event_id", (F.col("sec") % 1300).alias("age"), (F.col("event_id") % 2 == 0).alias("known"), programs.program_fields(F.lit("sshd"), line).alias("p"))
    route = F.when(F.col("age") > 600, "drift").when(F.col("known"), "owner").otherwise("global")
    return rows.filter("p.rule = 'accepted'").select("event_id", F.try_element_at("p.fields", F.lit("user")).alias("user"), route.alias("route"))


@CASES.add(f"""
    SELECT e.event_id, coalesce('team' || c_nationkey, CASE WHEN event_type = 'error' THEN 'errors' ELSE 'everyone' END) AS channel
    FROM {EVENTS} e LEFT JOIN customer ON c_custkey = e.user_id AND c_acctbal > 0 WHERE event_type IN ('error', 'purchase')""")
def alert_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert goes to its subject's channel, else errors to one channel and the rest to another."""
    channels = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("team"), F.col("c_nationkey").cast("string")).alias("own"))
    rows = events(spark, sf_dir).filter("event_type in ('error', 'purchase')")
    fallback = F.when(F.col("event_type") == "error", "errors").otherwise("everyone")
    return rows.join(channels, "user_id", "left").select("event_id", F.coalesce("own", fallback).alias("channel"))
