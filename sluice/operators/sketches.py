"""Mergeable distinct counts and frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers are 2 to this power; the relative error is about 1.04 / sqrt(2**14), below one percent.
PRECISION = 14


def partial_distinct(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A sketch of the distinct values of each key, to be merged or estimated later."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, PRECISION).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimate(sketch: str = "sketch") -> Column:
    return F.hll_sketch_estimate(sketch)


def bloom_bits(items: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter for so many items at a false positive rate."""
    import math

    bits = math.ceil(items * math.log(rate) / math.log(1 / 2 ** math.log(2)))
    return bits, max(1, round(math.log(2) * bits / items))


def bloom_positions(value: Column, bits: int, hashes: int) -> Column:
    """The bit positions of a value."""
    return F.array(*[F.pmod(F.xxhash64(value, F.lit(k)), F.lit(bits)) for k in range(hashes)])


def bloom_filter(df: DataFrame, value: str, bits: int, hashes: int) -> DataFrame:
    """The set bits as rows (position); merges by union and distinct."""
    return df.select(F.explode(bloom_positions(F.col(value), bits, hashes)).alias("position")).distinct()


def bloom_query(df: DataFrame, value: str, filter_bits: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Distinct values with `maybe`: true if all their bits are set."""
    spread = df.select(value).distinct().select(value, F.explode(bloom_positions(F.col(value), bits, hashes)).alias("position"))
    hit = spread.join(filter_bits.withColumn("set", F.lit(True)), "position", "left")
    return hit.groupBy(value).agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("maybe"))
