"""Duplicate removal: exact, first seen, and by a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; an aggregate with map-side combine, not a window."""
    others = [c for c in df.columns if c not in keys]
    place = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in others if c not in order])
    best = df.groupBy(*keys).agg(F.min(place).alias("row"))
    return best.select(*keys, *[F.col(f"row.{c}").alias(c) for c in others])


def ttl_marks(df: DataFrame, keys: list[str], sec: str, order: str, interval: int, intervals: int = 256) -> DataFrame:
    """Each row with `added` and `delta`: a key counts as new if its last sighting is more than
    `intervals` intervals ago; delta is the number of intervals since then, else null."""
    slot = F.floor(F.col(sec) / interval).cast("long")
    before = F.lag(slot).over(W.partitionBy(*keys).orderBy(sec, order))
    delta = slot - before
    fresh = before.isNull() | (delta >= intervals)
    return df.withColumn("added", fresh).withColumn("delta", F.when(~fresh, delta))


def members(df: DataFrame, keys: list[str], added: str, order: list[str]) -> DataFrame:
    """(keys, adds): what a set holds once rows have added (true) or deleted (false) their keys in the given order.

    As in a set, a second addition changes nothing and one deletion takes the key out, so the last operation
    of a key decides; adds counts the additions. An aggregate with map-side combine.
    """
    last = F.max_by(added, F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(last.alias("__last"), F.count_if(added).alias("adds")).filter("__last").drop("__last")
