"""Alert thresholds with fallbacks, and throttling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_threshold(df: DataFrame, key: str, limits: DataFrame, value: str, default: float) -> DataFrame:
    """Rows with their key's limit, else that of `*`, else the default."""
    star = limits.filter(F.col(key) == "*").agg(F.max(value)).scalar()
    own = limits.filter(F.col(key) != "*").select(key, F.col(value).alias("__own"))
    return df.join(own, key, "left").withColumn("__star", star).withColumn("threshold", F.coalesce("__own", "__star", F.lit(default))).drop("__own", "__star")


def throttled(df: DataFrame, keys: list[str], sec: str, minutes: int) -> DataFrame:
    """The alerts that are sent: a key is silent for so many minutes after each alert that it sent.

    Each decision needs the last one, so a key's alerts stream in order through one task, which holds the time of the last
    alert sent and never a key's rows. Null keys are one key.
    """
    width = minutes * 60

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            *names, times = (c.to_pylist() for c in batch.columns)
            sent = []
            for who, t in zip(zip(*names, strict=True), times, strict=True):
                if who != held:
                    held, last = who, None
                sent.append(last is None or t - last > width)
                last = t if sent[-1] else last
            yield batch.filter(pa.array(sent, pa.bool_()))

    rows = df.select(*keys, sec).filter(F.col(sec).isNotNull())
    return rows.repartition(*keys).sortWithinPartitions(*keys, sec).mapInArrow(fold, rows.schema)


def error_alerts(counts: DataFrame, details: DataFrame, keys: list[str], width: int, span: int, guard: int, percent: float, top: int = 3) -> DataFrame:
    """(keys, bucket, valid, errors, percent, diagnostic): buckets at which errors of the last `span` buckets exceed a percentage.

    counts (keys, bucket, valid, errors) and details (keys, bucket, detail, n) are sums by buckets of `width` seconds. Neither valid rows nor errors
    of a span need exceed `guard` both, but one of them must. diagnostic lists the span's most frequent details as `count/detail`; spans meet
    the details by equality of buckets.
    """
    own = W.partitionBy(*keys).orderBy("bucket").rangeBetween(-(span - 1) * width, 0)
    rolled = counts.withColumns({"valid": F.sum("valid").over(own), "errors": F.sum("errors").over(own)})
    share = F.col("errors") * 100.0 / (F.col("valid") + F.col("errors"))
    alerts = rolled.filter(((F.col("valid") > guard) | (F.col("errors") > guard)) & (share > percent)).withColumn("percent", F.round(share, 6))
    asked = alerts.select(*keys, "bucket", F.explode(F.sequence(F.col("bucket") - (span - 1) * width, F.col("bucket"), F.lit(width))).alias("__b"))
    met = asked.join(details.withColumnRenamed("bucket", "__b"), [*keys, "__b"]).groupBy(*keys, "bucket", "detail").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy(*keys, "bucket").orderBy(F.desc("n"), "detail"))
    listed = met.withColumn("__p", place).filter(F.col("__p") <= top).groupBy(*keys, "bucket").agg(F.sort_array(F.collect_list(F.struct("__p", F.concat(F.col("n").cast("string"), F.lit("/"), F.col("detail").cast("string")).alias("t")))).alias("__l"))
    return alerts.join(listed, [*keys, "bucket"], "left").select(*keys, "bucket", "valid", "errors", "percent", F.array_join("__l.t", ", ").alias("diagnostic"))


def silent(counts: DataFrame, keys: list[str], width: int, limit: int, until: int) -> DataFrame:
    """(keys, last, silence): keys whose last bucket with valid rows ended more than `limit` buckets before `until`; a key that never had any isn't told of."""
    last = counts.filter("valid > 0").groupBy(*keys).agg(F.max("bucket").alias("last"))
    gone = F.floor((F.lit(until) - F.col("last")) / width).cast("long")
    return last.withColumn("silence", gone).filter(F.col("silence") > limit)
