"""Interval joins by time buckets: equality instead of a range, exact after a check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlaps(spans: DataFrame, keys: list[str], identity: str, start: str, end: str, width: int) -> DataFrame:
    """(keys, identity, other): spans of one key in which the other starts, itself included.

    A span is cut into buckets of `width` seconds; the other's start lies in exactly one bucket, so
    no pair is made twice. Spans that touch only at their end don't overlap.
    """
    b = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end) - 1) / width)))
    spread = spans.select(*keys, F.col(identity), F.col(start).alias("__a"), F.col(end).alias("__b"), b.alias("__bucket"))
    starts = spans.select(*keys, F.col(identity).alias("other"), F.col(start).alias("__s"), F.floor(F.col(start) / width).alias("__bucket"))
    return spread.join(starts, [*keys, "__bucket"]).filter("__s >= __a and __s < __b").select(*keys, identity, "other")


def starts_within(spans: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """spans with column starts: how many spans of the key start in [start, end), itself included. Empty spans start, but have no row.

    Starts are counted by time and then ranked, so no pair of spans is made: a span holds the starts before its end less those
    before its start. Ranks are running sums inside buckets of `width` seconds on top of the buckets before.
    """
    real = spans.filter(F.col(end) > F.col(start))
    times = spans.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("n")), F.struct(F.col(end).alias("t"), F.lit(0).alias("n")))).alias("p")).select(*keys, "p.*")
    counts = times.groupBy(*keys, "t").agg(F.sum("n").alias("n")).withColumn("bucket", F.floor(F.col("t") / width))
    buckets = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(W.partitionBy(*keys, "bucket").orderBy("t").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("inside", inside).join(buckets.withColumn("before", before), [*keys, "bucket"]).select(*keys, "t", (F.col("before") + F.col("inside")).alias("rank"))
    low, high = ranks.withColumnsRenamed({"t": start, "rank": "__low"}), ranks.withColumnsRenamed({"t": end, "rank": "__high"})
    return real.join(low, [*keys, start]).join(high, [*keys, end]).withColumn("starts", F.col("__high") - F.col("__low")).drop("__low", "__high")
