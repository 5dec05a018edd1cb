"""Symbolic aggregate approximation of per-key series, with the published lower-bound distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Quartiles of the standard normal distribution: fixed values for an alphabet of four letters.
CUTS = (-0.6744897501960817, 0.0, 0.6744897501960817)
LETTERS = "abcd"


def words(series: DataFrame, key: str, order: str, value: str, pieces: int) -> DataFrame:
    """(key, word, rows): z-normalised values averaged over `pieces` equal runs of rows, a letter for each.

    A constant series is all `b`-or-above letters of the middle; a series shorter than `pieces` has fewer letters.
    """
    own = W.partitionBy(key)
    sd = F.stddev_pop(value).over(own)
    z = F.when(sd > 0, (F.col(value) - F.avg(value).over(own)) / sd).otherwise(0.0)
    placed = series.withColumn("z", z).withColumn("piece", F.ntile(pieces).over(own.orderBy(order)))
    means = placed.groupBy(key, "piece").agg(F.round(F.avg("z"), 9).alias("m"), F.count("*").alias("rows"))
    index = F.lit(1)
    for cut in CUTS:
        index = index + (F.col("m") >= cut).cast("int")
    letters = means.withColumn("letter", F.substring(F.lit(LETTERS), index, F.lit(1)))
    made = letters.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("piece", "letter"))).alias("p"), F.sum("rows").alias("rows"))
    return made.select(key, F.array_join("p.letter", "").alias("word"), "rows")


def mindist(a: Column, b: Column, rows: Column) -> Column:
    """The distance of two words of one length that their series have at least."""
    cuts = F.array(*[F.lit(c) for c in CUTS])

    def cell(pair: Column) -> Column:
        x, y = F.instr(F.lit(LETTERS), pair["a"]), F.instr(F.lit(LETTERS), pair["b"])
        gap = F.get(cuts, F.greatest(x, y) - 2) - F.get(cuts, F.least(x, y) - 1)
        return F.when(F.abs(x - y) <= 1, 0.0).otherwise(gap * gap)

    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    total = F.aggregate(F.transform(pairs, cell), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(rows / F.char_length(a)) * F.sqrt(total)


def shape_changes(counts: DataFrame, keys: list[str], value: str, width: int, period: int, apart: int, pieces: int, most: float) -> DataFrame:
    """(keys, start, word, before, distance): periods whose shape is further than `most` from that of the period `apart` seconds before.

    counts (keys, bucket, value) are sums by buckets of `width` seconds; buckets of a period that has any are zero where they are missing. A
    shape is the word of a period's buckets, so what counts is when things come and not how many.
    """
    start = F.col("bucket") - F.pmod("bucket", F.lit(period))
    held = counts.withColumn("start", start)
    whole = held.select(*keys, "start").distinct().withColumn("bucket", F.explode(F.sequence("start", F.col("start") + period - width, F.lit(width))))
    dense = whole.join(held, [*keys, "start", "bucket"], "left").select(F.struct(*keys, "start").alias("__k"), "bucket", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(value))
    made = words(dense, "__k", "bucket", value, pieces).select("__k.*", "word", "rows")
    past = made.select(*keys, (F.col("start") + apart).alias("start"), F.col("word").alias("before"))
    far = made.join(past, [*keys, "start"]).withColumn("distance", F.round(mindist(F.col("word"), F.col("before"), F.col("rows")), 6))
    return far.filter(F.col("distance") > most).drop("rows")
