"""Messages as framed bytes and partitioned objects: what is read is written from the event table first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events
from sluice.session import scratch
from sluice.sources import frames, partitions
from sluice.sources.partitions import Dimension

CASES = Cases()


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as messages: a header and fields of four kinds."""
    k = F.get_json_object("props", "$.k").cast("long")
    fields = F.array(
        frames.field("event", F.col("event_id"), "integers"), frames.field("value", F.col("value"), "doubles"), frames.field("odd", F.col("event_id") % 2 == 1, "booleans"),
        frames.field("key", F.concat(F.lit("ключ "), k.cast("string")), "strings"), frames.field("debt", -k, "integers"),
    )
    return events(spark, sf_dir).select(
        "event_id", F.unhex(F.md5(F.col("event_id").cast("string").cast("binary"))).alias("uuid"), (F.unix_micros("ts") * 1000).alias("nanos"), F.col("event_type").alias("type"),
        F.when(F.col("event_id") % 3 > 0, F.col("props")).alias("payload"), (F.col("user_id") % 8).cast("int").alias("severity"), F.col("user_id").cast("int").alias("pid"), F.lit("host-1").alias("hostname"), fields.alias("fields"),
    )


def _read_back(rows: DataFrame, *others: str) -> DataFrame:
    own = lambda name, kind: frames.value_of("fields", name, kind).alias(name)
    return rows.select(
        own("event", "integers"), F.hex("uuid").alias("uuid"), F.expr("nanos div 1000").alias("micros"), "type", "payload", "severity", "pid", "hostname",
        own("value", "doubles"), own("odd", "booleans"), own("key", "strings"), own("debt", "integers"), *others,
    )


#: DuckDB: an event as it comes back from a message.
_MESSAGE = """event_id AS event, upper(md5(CAST(event_id AS VARCHAR))) AS uuid, CAST(epoch_us(ts) AS BIGINT) AS micros, event_type AS type, CASE WHEN event_id % 3 > 0 THEN props END AS payload, CAST(user_id % 8 AS INTEGER) AS severity,
    CAST(user_id AS INTEGER) AS pid, 'host-1' AS hostname, value, event_id % 2 = 1 AS odd, 'ключ ' || json_extract(props, '$.k') AS key, -json_extract(props, '$.k')::BIGINT AS debt"""


@CASES.add(f"SELECT {_MESSAGE}, CAST(NULL AS VARCHAR) AS error FROM {EVENTS}")
def framed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written to files of framed messages, and read by ranges of bytes that know nothing of the writer."""
    path = scratch(spark, "frames")
    frames.write_frames(_messages(spark, sf_dir), path)
    return _read_back(frames.read_frames(spark, path, split=1 << 18, search=True), "error")  # what can't be read has an error and no members


@CASES.add(f"SELECT type, count(*) AS n, count(*) FILTER (event % 7 <> 0) AS whole, count(*) FILTER (event % 7 = 0) AS cut, CAST(sum(debt) FILTER (event % 7 <> 0) AS BIGINT) AS debt FROM (SELECT {_MESSAGE} FROM {EVENTS}) GROUP BY 1")
def message_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as a column of bytes, one in seven cut short: those go to the side with what is wrong with them."""
    made = frames.encoded(_messages(spark, sf_dir).withColumn("kind", F.col("type")), "bytes")
    sent = made.withColumn("bytes", F.when(F.col("event_id") % 7 == 0, F.substring("bytes", F.lit(1), F.octet_length("bytes") - 1)).otherwise(F.col("bytes")))
    back = frames.decoded(sent, "bytes")
    whole = F.col("decode_error").isNull()
    return back.groupBy(F.col("kind").alias("type")).agg(F.count("*").alias("n"), F.count_if(whole).alias("whole"), F.count_if(~whole).alias("cut"), F.sum(frames.value_of("fields", "debt", "integers")).alias("debt"))


_FILED = "CASE WHEN part IS NULL THEN 'UNKNOWN' ELSE part END"
_ALL = f"(SELECT *, event_type AS kind, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN user_id % 4 > 0 THEN 'p_' || user_id % 4 END AS part FROM {EVENTS})"


def _filed(spark: SparkSession, sf_dir: str, rules: list[Dimension]) -> str:
    path = scratch(spark, "filed")
    part = F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("p/"), (F.col("user_id") % 4).cast("string")))
    rows = events(spark, sf_dir).select("event_id", "value", F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day"), part.alias("part"))
    partitions.write_by_rules(rows, path, rules, {"day": F.regexp_replace("day", "-", "_"), "part": F.col("part")})
    return path


_RULES = [Dimension.of("kind", ["view", "purchase", "refund"]), Dimension.of("day", {"min": "2024_01_05", "max": "2024_01_20"}), Dimension.of("part", "*")]


@CASES.add(f"SELECT kind, replace(day, '-', '_') AS day, {_FILED} AS part, count(*) AS n, round(sum(value), 4) AS total FROM {_ALL} WHERE kind IN ('view', 'purchase') AND day BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY ALL")
def dimension_rules_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events filed by rules, read through the same rules: what they don't allow lies in folders that aren't opened."""
    path = _filed(spark, sf_dir, _RULES)
    rows = partitions.read_matching(spark, path, _RULES, "event_id long, value double, kind string, day string, part string")
    return rows.groupBy("kind", "day", "part").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@CASES.add(f"""
    WITH f AS (SELECT CASE WHEN kind IN ('view', 'purchase') THEN kind ELSE 'OTHER' END AS kind, CASE WHEN day BETWEEN '2024-01-05' AND '2024-01-20' THEN replace(day, '-', '_') ELSE 'OTHER' END AS day, {_FILED} AS part FROM {_ALL})
    SELECT kind, day, part, count(*) AS n FROM f WHERE kind = 'OTHER' AND day >= '2024_01_10' AND part IN ('p_1', 'UNKNOWN') GROUP BY ALL""")
def object_keys_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects chosen by their keys alone, with other rules than those they were filed by, then read."""
    path = _filed(spark, sf_dir, _RULES)
    rules = [Dimension.of("kind", "OTHER"), Dimension.of("day", {"min": "2024_01_10"}), Dimension.of("part", ["p/1", "UNKNOWN"])]
    objects = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select(F.regexp_extract("path", r"(kind=.*)$", 1).alias("key"), "length")
    chosen = partitions.matching_keys(objects, "key", rules)
    names = [f"{path}/{r['key']}" for r in chosen.select("key").toLocalIterator()]
    rows = spark.read.schema("event_id long, kind string, day string, part string").option("basePath", path).parquet(*names) if names else spark.createDataFrame([], "event_id long, kind string, day string, part string")
    return rows.groupBy("kind", "day", "part").agg(F.count("*").alias("n"))
