"""Where messages come from: text, framed records, JSON documents, cumulative counters and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: One message: fixed headers and a map of fields.
MESSAGE = "uuid string, ts timestamp, logger string, hostname string, type string, payload string, env_version string, pid int, severity int, fields map<string,string>"


def text_records(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """(value): one row per record; any codec that Spark reads."""
    return spark.read.option("lineSep", separator).text(path)


def multi_line(lines: DataFrame, start: str | None, keys: list[str], place: str, end: str | None = None) -> DataFrame:
    """(keys, first, record): lines that belong to one record, which begins where `start` matches or after a line that matches `end`.

    Lines before the first start are a record of their own. Records are gathered one by one, not
    files whole.
    """
    own = W.partitionBy(*keys).orderBy(place)
    begins = F.col("value").rlike(start).cast("int") if start else F.lit(0)
    ended = F.coalesce(F.lag(F.col("value").rlike(end)).over(own), F.lit(False)).cast("int") if end else F.lit(0)
    numbered = lines.withColumn("__b", F.greatest(begins, ended)).withColumn("__n", F.sum("__b").over(own))
    made = numbered.groupBy(*keys, "__n").agg(F.min(place).alias("first"), F.sort_array(F.collect_list(F.struct(place, "value"))).alias("l"))
    return made.select(*keys, "first", F.array_join("l.value", "\n").alias("record"))


def counters(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cumulative counters of tab-separated files, packed or not."""
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def json_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON lines; lines that don't parse have a `decode_error`."""
    raw = spark.read.text(path)
    parsed = raw.withColumn("m", F.from_json("value", MESSAGE))
    bad = F.try_parse_json("value").isNull()
    return parsed.select("m.*", F.when(bad, F.col("value")).alias("decode_error"))


def counter_deltas(rows: DataFrame, keys: list[str], order: str, counters: list[str]) -> DataFrame:
    """What cumulative counters gained since the row before; after a restart the counter itself."""
    own = W.partitionBy(*keys).orderBy(order)
    gained = {c: F.when(F.col(c) >= F.lag(c).over(own), F.col(c) - F.lag(c).over(own)).otherwise(F.col(c)) for c in counters}
    return rows.select(*keys, order, *[v.alias(c) for c, v in gained.items()])


def follow(spark: SparkSession, path: str, schema: str, kind: str = "parquet", per_batch: int = 100) -> DataFrame:
    """A stream of the files that arrive below a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(kind).load(path)


def from_broker(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A stream of a message broker's topic, for clusters that have the connector; type defaults to the topic."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.col("value").cast("string").alias("payload"), F.col("topic").alias("type"), F.col("timestamp").alias("ts"))
