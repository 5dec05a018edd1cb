"""Ingestion: dimensions of addresses, validation with a side output, duplicates, hierarchies and loader lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events, floor_to
from sluice.functions import decoders, jsonx, net, normalize
from sluice.operators import dedup
from sluice.sources import readers, sinks
from sluice.session import table

CASES = Cases()


@CASES.add(f"""
    SELECT event_id, 'ns' || (user_id % 3) AS namespace, event_type AS doc_type, CAST(event_id % 5 AS INTEGER) AS version, '10.0.' || (user_id % 200) || '.9' AS address,
        CASE WHEN event_id % 13 = 0 THEN 'uri' WHEN event_id % 5 = 0 THEN 'version' END AS error FROM {EVENTS} WHERE event_id % 13 > 0
    UNION ALL SELECT event_id, NULL, NULL, NULL, '10.0.' || (user_id % 200) || '.9', 'uri' FROM {EVENTS} WHERE event_id % 13 = 0""")
def ingest_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespace, type and version of a submission's address, the last forwarded address, and what is wrong."""
    path = F.when(F.col("event_id") % 13 == 0, "/other").otherwise(F.format_string("/submit/ns%d/%s/%d/id-%d", F.col("user_id") % 3, F.col("event_type"), F.col("event_id") % 5, F.col("event_id")))
    forwarded = F.format_string("8.8.8.8, 9.9.9.9,10.0.%d.9", F.col("user_id") % 200)
    rows = events(spark, sf_dir).select("event_id", path.alias("uri"), forwarded.alias("xff"))
    shape = r"^/submit/([\w-]+)/([\w-]+)/(\d+)/([\w-]+)$"
    part = lambda k: F.nullif(F.regexp_extract("uri", shape, k), F.lit(""))
    error = F.when(~F.col("uri").rlike(shape), "uri").when(part(3).try_cast("int") == 0, "version")
    return rows.select("event_id", part(1).alias("namespace"), part(2).alias("doc_type"), part(3).try_cast("int").alias("version"), F.regexp_extract("xff", r",? *([^,]+)$", 1).alias("address"), error.alias("error"))


@CASES.add(f"""
    WITH s AS (SELECT event_id, user_id, sec, sec - lag(sec) OVER (PARTITION BY user_id, event_type ORDER BY sec, event_id) AS gap, event_type FROM {EVENTS})
    SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN gap < 86400 THEN 'duplicate' ELSE 'accepted' END AS route, count(*) AS n, min(event_id) AS first FROM s GROUP BY 1""")
def ingest_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and duplicates within a day go to tables of their own."""
    marks = dedup.ttl_marks(events(spark, sf_dir), ["user_id", "event_type"], "sec", "event_id", 1, 86400)
    route = F.when(F.col("event_type") == "error", "error").when(~F.col("added"), "duplicate").otherwise("accepted")
    return marks.groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@CASES.add(f"""
    SELECT event_id, CASE WHEN event_id % 9 > 0 THEN 'w' || user_id END AS worker, CASE WHEN event_id % 9 > 0 THEN event_type END AS kind, CASE WHEN event_id % 9 > 0 THEN sec END AS sec,
        CASE WHEN event_id % 9 = 0 THEN 'eventType' END AS error FROM {EVENTS}""")
def worker_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON after a token in a text line, with required names checked; every ninth lacks one."""
    kind = F.when(F.col("event_id") % 9 > 0, F.concat(F.lit(',"eventType":"'), F.col("event_type"), F.lit('"'))).otherwise("")
    line = F.concat(F.lit("2024 host WORKER_METRICS "), F.lit('{"workerId":"w'), F.col("user_id").cast("string"), F.lit('","timestamp":'), F.col("sec").cast("string"), kind, F.lit("}"))
    document = F.regexp_extract(line, r"WORKER_METRICS[^{]*(\{.*)$", 1)
    rules = {name: (lambda v, n=name: v[n].isNotNull()) for name in ("workerId", "timestamp", "eventType")}
    c = events(spark, sf_dir).select("event_id", jsonx.checked(document, "workerId string, timestamp long, eventType string", rules).alias("c"))
    good = F.col("c.error").isNull()
    return c.select("event_id", F.when(good, F.col("c.value.workerId")).alias("worker"), F.when(good, F.col("c.value.eventType")).alias("kind"), F.when(good, F.col("c.value.timestamp")).alias("sec"), "c.error")


@CASES.add(f"""
    SELECT event_type, CASE user_id % 5 WHEN 0 THEN 'modern' WHEN 1 THEN 'v4' WHEN 2 THEN 'v2' ELSE 'unknown' END AS shape, count(*) AS n, CAST(sum(json_extract(props, '$.k')::BIGINT) AS BIGINT) AS total FROM {EVENTS} GROUP BY 1, 2""")
def version_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read by the rules of their version."""
    k = jsonx.find("props", "k")
    v = F.col("user_id") % 5
    document = (
        F.when(v == 0, F.concat(F.lit('{"version":4,"payload":{"k":'), k, F.lit("}}"))).when(v == 1, F.concat(F.lit('{"version":4,"k":'), k, F.lit("}"))).when(v == 2, F.concat(F.lit('{"ver":2,"info":{"k":'), k, F.lit("}}"))).otherwise(F.concat(F.lit('{"k":'), k, F.lit("}")))
    )
    rows = events(spark, sf_dir).select("event_type", document.alias("d"))
    modern, four, two = jsonx.find("d", "payload", "k"), jsonx.find("d", "version") == "4", jsonx.find("d", "ver") == "2"
    shape = F.when(modern.isNotNull(), "modern").when(four, "v4").when(two, "v2").otherwise("unknown")
    total = F.coalesce(modern, jsonx.find("d", "info", "k"), jsonx.find("d", "k")).cast("long")
    return rows.groupBy("event_type", shape.alias("shape")).agg(F.count("*").alias("n"), F.sum(total).alias("total"))


@CASES.add(f"""
    SELECT event_type, CASE WHEN grouping(user_id % 3) = 0 THEN user_id % 3 END AS channel, count(*) AS n, count(*) FILTER (json_extract(props, '$.k')::BIGINT > 90) AS errors FROM {EVENTS} GROUP BY ROLLUP (event_type, user_id % 3)""")
def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts at every level of a hierarchy of keys."""
    rows = events(spark, sf_dir).withColumn("channel", F.col("user_id") % 3)
    return rows.rollup("event_type", "channel").agg(F.count("*").alias("n"), F.count_if(jsonx.find("props", "k").cast("long") > 90).alias("errors"))


@CASES.add(f"""
    WITH e AS (SELECT event_id, json_extract(props, '$.k')::BIGINT * 3 - 150 AS skew FROM {EVENTS})
    SELECT event_id, skew, CASE WHEN abs(skew) <= 60 THEN 'ok' WHEN skew > 0 THEN 'ahead' ELSE 'behind' END AS verdict FROM e""")
def clock_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's clock, as the date header of its report writes it, against the server's."""
    off = F.get_json_object("props", "$.k").cast("long") * 3 - 150
    header = F.concat(F.date_format(F.timestamp_seconds(F.col("sec") + off), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    skew = F.unix_seconds(decoders.any_time(F.col("header"))) - F.col("sec")
    rows = events(spark, sf_dir).select("event_id", "sec", header.alias("header")).withColumn("skew", skew)
    return rows.select("event_id", "skew", F.when(F.abs("skew") <= 60, "ok").when(F.col("skew") > 0, "ahead").otherwise("behind").alias("verdict"))


@CASES.add(f"""
    SELECT '{{"index":{{"_index":"ev-' || strftime(ts, '%Y.%m.%d') || '"}}}}' || chr(10) || '{{"event_id":' || event_id || ',"event_type":"' || event_type || '"}}' AS value FROM {EVENTS}""")
def bulk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action and document lines of a search engine's bulk interface."""
    return sinks.bulk_json(events(spark, sf_dir), F.concat(F.lit("ev-"), F.date_format("ts", "yyyy.MM.dd")), ["event_id", "event_type"])


@CASES.add("""
    SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey || '|' || o_orderstatus || '|' || CASE WHEN o_custkey <= 127 THEN o_custkey ELSE -1 END AS line FROM orders""")
def loader_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with bars for a bulk loader, by day; what doesn't fit its type has a default."""
    custkey = normalize.bounded(F.col("o_custkey").cast("string"), "tinyint", -1)
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), normalize.printable(F.col("o_orderstatus")), custkey.cast("string"))
    return table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), line.alias("line"))


@CASES.add("SELECT c_custkey, 167772160 + c_custkey * 7 AS number, '10.' || ((c_custkey * 7) // 65536 % 256) || '.' || ((c_custkey * 7) // 256 % 256) || '.' || (c_custkey * 7 % 256) AS address FROM customer")
def address_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as dotted addresses and back."""
    address = net.ip_text(F.lit(167772160) + F.col("c_custkey") * 7)
    return table(spark, sf_dir, "customer").select("c_custkey", net.ip_number(address).alias("number"), address.alias("address"))


@CASES.add(f"SELECT user_id, sec // 86400 * 86400 AS bucket, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY user_id ORDER BY sec // 86400 * 86400) AS BIGINT) AS total FROM {EVENTS} GROUP BY 1, 2")
def cumulative_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of each user, whose differences are the daily counts again."""
    daily = events(spark, sf_dir).groupBy("user_id", floor_to("sec", 86400).alias("bucket")).agg(F.count("*").alias("c"))
    totals = daily.withColumn("total", F.sum("c").over(W.partitionBy("user_id").orderBy("bucket")))
    return readers.counter_deltas(totals.withColumn("n", F.col("total")), ["user_id"], "bucket", ["n"]).join(totals.select("user_id", "bucket", "total"), ["user_id", "bucket"])
