"""Nested documents: schemas by namespace, type and version, deep merges, packed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events
from sluice.functions import jsonx, schemas
from sluice.operators import merge

CASES = Cases()

_ITEMS = {"type": "array", "maxItems": 2, "items": {"type": "object", "required": ["sku"], "properties": {"sku": {"type": "string", "pattern": "^[a-z]+$"}}}}
SCHEMAS = {
    ("store", "purchase", 1): {"type": "object", "required": ["k", "value"], "properties": {"k": {"type": "integer", "maximum": 60}, "value": {"type": "number", "minimum": 5}, "items": _ITEMS}, "additionalProperties": False},
    ("store", "purchase", 2): {"type": "object", "properties": {"k": {"type": ["string", "null"]}}},
    ("account", "signup", 1): {"oneOf": [{"properties": {"k": {"maximum": 30}}}, {"properties": {"value": {"maximum": 50}}}]},
}


@CASES.add(f"""
    WITH e AS (SELECT *, json_extract(props, '$.k')::BIGINT AS k, CASE WHEN event_type IN ('purchase', 'view') THEN 'store' ELSE 'account' END AS namespace, CAST(user_id % 2 + 1 AS INTEGER) AS version FROM {EVENTS}),
    c AS (SELECT namespace, event_type, version, CASE
        WHEN event_type = 'purchase' AND version = 1 THEN CASE WHEN event_id % 11 = 0 THEN '$: required value' WHEN k > 60 THEN '$.k: maximum' WHEN value < 5 THEN '$.value: minimum' WHEN event_id % 5 = 0 THEN '$.items[0].sku: pattern' WHEN event_id % 7 = 0 THEN '$.items[1]: required sku' WHEN event_id % 13 = 0 THEN '$.more: false' END
        WHEN event_type = 'purchase' THEN '$.k: type' WHEN event_type = 'signup' AND version = 1 THEN CASE WHEN (k <= 30) = (event_id % 11 = 0 OR value <= 50) THEN '$: oneOf' END ELSE 'no schema' END AS error FROM e)
    SELECT namespace, event_type, version, error, count(*) AS n FROM c GROUP BY ALL""")
def schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents checked by the schema of their namespace, type and version: how many break which rule first."""
    k = F.get_json_object("props", "$.k").cast("long")
    sku = F.when(F.col("event_id") % 5 == 0, "A1").otherwise("abc")
    item = lambda name, value: F.create_map(F.lit(name), value)
    document = F.to_json(F.struct(
        k.alias("k"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"), F.array(item("sku", sku), F.when(F.col("event_id") % 7 == 0, item("other", F.lit("x"))).otherwise(item("sku", F.lit("z")))).alias("items"),
        F.when(F.col("event_id") % 13 == 0, 1).alias("more"),
    ))
    rows = events(spark, sf_dir).select("event_type", F.when(F.col("event_type").isin("purchase", "view"), "store").otherwise("account").alias("namespace"), (F.col("user_id") % 2 + 1).cast("int").alias("version"), document.alias("d"))
    error = schemas.checked_by(F.col("d"), [F.col("namespace"), F.col("event_type"), F.col("version")], SCHEMAS)
    return rows.withColumn("error", error).groupBy("namespace", "event_type", "version", "error").agg(F.count("*").alias("n"))


@CASES.add(f"""
    WITH e AS (SELECT *, json_extract(props, '$.k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS i FROM {EVENTS})
    SELECT user_id, count(*) AS n, nullif(count(*) FILTER (event_type = 'view'), 0) AS views, arg_max(event_id, (sec, event_id)) FILTER (event_type = 'view') AS last_view, CAST(sum(k) AS BIGINT) AS pair_sum, arg_max(event_type, (sec, event_id)) AS pair_last,
        CASE WHEN count(*) FILTER (i = 1 AND event_id % 2 = 0) = 1 THEN CAST(CAST(sum(k) FILTER (event_id % 2 = 0) AS BIGINT) AS VARCHAR) ELSE 'text' END AS odd FROM e GROUP BY 1""")
def deep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's nested documents merged in the order of time: counts add up, texts are the last, the first kind of a member holds."""
    k = F.get_json_object("props", "$.k").cast("long")
    by = F.create_map(F.col("event_type"), F.struct(F.lit(1).alias("count"), F.col("event_id").cast("string").alias("last")))
    odd = F.when(F.col("event_id") % 2 == 0, k.cast("string")).otherwise('"text"')
    head = F.to_json(F.struct(F.lit(1).alias("n"), by.alias("by")))
    document = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(', "pair": ['), k.cast("string"), F.lit(', "'), F.col("event_type"), F.lit('"], "odd": '), odd, F.lit("}"))
    made = merge.merged(events(spark, sf_dir).select("user_id", "sec", "event_id", document.alias("d")), ["user_id"], "d", ["sec", "event_id"])
    part = lambda *path: jsonx.find("d", *path)
    return made.select(
        "user_id", part("n").cast("long").alias("n"), part("by", "view", "count").cast("long").alias("views"), part("by", "view", "last").cast("long").alias("last_view"),
        part("pair", 0).cast("long").alias("pair_sum"), part("pair", 1).alias("pair_last"), part("odd").alias("odd"),
    )


@CASES.add(f"SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 9 = 0) AS broken, CAST(sum(json_extract(props, '$.k')::BIGINT) FILTER (event_id % 9 > 0) AS BIGINT) AS k FROM {EVENTS} GROUP BY 1")
def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed with gzip and unpacked again; one in nine is cut and counts as broken, others came unpacked."""
    packed = jsonx.packed(events(spark, sf_dir).select("event_type", "event_id", F.encode("props", "UTF-8").alias("body")), "body")
    sent = packed.withColumn("body", F.when(F.col("event_id") % 9 == 0, F.substring("body", F.lit(1), F.octet_length("body") - 6)).otherwise(F.col("body")))
    back = jsonx.unpacked(sent, "body")
    text = F.when(F.col("unpack_error").isNull(), F.col("body").cast("string"))
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.count("unpack_error").alias("broken"), F.sum(F.get_json_object(text, "$.k").cast("long")).alias("k"))
