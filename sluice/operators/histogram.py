"""Histograms: linear and exponential slots, shares, and the closest histogram by correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def linear_slot(value: Column, width: float, slots: int) -> Column:
    """The slot of a value; the last one is open."""
    return F.least(F.floor(value / width), F.lit(slots - 1)).cast("int")


def exponential_slot(value: Column, slots: int) -> Column:
    """The power of two below a value; what is below one counts as one, the last slot is open."""
    return F.least(F.floor(F.log2(F.greatest(value, F.lit(1.0)))), F.lit(slots - 1)).cast("int")


def counts(df: DataFrame, keys: list[str], slot: Column) -> DataFrame:
    return df.groupBy(*keys, slot.alias("slot")).agg(F.count("*").alias("n"))


def shares(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Counts with their share of the key's rows, rounded to six digits."""
    return histogram.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(*keys)), 6))


def dense(histogram: DataFrame, key: str, slots: int) -> DataFrame:
    """A row for every slot of every key."""
    full = histogram.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    return full.join(histogram, [key, "slot"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def closest(histogram: DataFrame, key: str) -> DataFrame:
    """The best correlated other key of each key; keys are few (builds, types), their rows are slots."""
    full = histogram.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(key))).select(key, "slot", "p")
    other = full.select(F.col(key).alias("closest"), "slot", F.col("p").alias("q"))
    pairs = full.join(other, "slot").filter(F.col(key) != F.col("closest")).groupBy(key, "closest").agg(F.corr("p", "q").alias("r"))
    best = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.round("r", 9)), "closest"))
    return pairs.withColumn("place", best).filter("place = 1").drop("place")
