"""Statistics that skip NaN, the normal distribution, and the rank-sum test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def real(value: Column | str) -> Column:
    """NaN becomes null, which aggregates skip."""
    return F.nullif(F.col(value) if isinstance(value, str) else value, F.lit(float("nan")))


def summary(value: str) -> list[Column]:
    """count, sum, avg, min, max, population variance and deviation; an empty sum and average are 0, extremes null."""
    x = real(value)
    return [
        F.count(x).alias("n"), F.round(F.coalesce(F.sum(x), F.lit(0.0)), 6).alias("sum"), F.round(F.coalesce(F.avg(x), F.lit(0.0)), 6).alias("avg"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.coalesce(F.var_pop(x), F.lit(0.0)), 6).alias("variance"), F.round(F.coalesce(F.stddev_pop(x), F.lit(0.0)), 6).alias("sd"),
    ]


def array_summary(values: Column, start: int, end: int) -> Column:
    """(n, sum, avg) of the elements from start to end, 1-based and inclusive, without NaN."""
    part = F.filter(F.slice(values, start, end - start + 1), lambda x: ~F.isnan(x) & x.isNotNull())
    total = F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    return F.struct(F.size(part).cast("long").alias("n"), F.round(total, 6).alias("sum"), F.when(F.size(part) > 0, F.round(total / F.size(part), 6)).otherwise(0.0).alias("avg"))


def ndtr(x: Column) -> Column:
    """The normal distribution function by its power series, exact to twelve digits; 0 and 1 beyond eight."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(120)),
        F.struct(x.cast("double").alias("term"), x.cast("double").alias("sum")),
        lambda s, k: F.struct((s["term"] * x * x / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * x * x / (2 * k + 1)).alias("sum")),
        lambda s: s["sum"],
    )
    inside = F.lit(0.5) + terms * F.exp(-x * x / 2) / F.lit(2.5066282746310002)
    return F.when(x < -8, 0.0).when(x > 8, 1.0).otherwise(inside)


def mann_whitney(df: DataFrame, value: str, is_x: str, continuity: bool = True, ranges: int = 64) -> DataFrame:
    """One row (n1, n2, u, z, p): u of the rows where is_x, one-sided p with tie correction.

    Values are counted, then ranked inside ranges of about as many distinct values each; the counts of the ranges before
    are added, so no task ranks all values. All values tied gives null z and p.
    """
    counts = df.select(real(value).alias("v"), is_x).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.count_if(is_x).alias("x"))
    cuts = sorted(set(counts.agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 20 * ranges).alias("q")).first()["q"] or [])) if ranges > 1 else []
    placed = counts.withColumn("range", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("v"))) if cuts else F.lit(0))
    sizes = placed.groupBy("range").agg(F.sum("n").alias("held"))
    before = sizes.select("range", F.coalesce(F.sum("held").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    inside = F.coalesce(F.sum("n").over(W.partitionBy("range").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("inside", inside).join(before, "range").withColumn("rank", F.col("before") + F.col("inside") + (F.col("n") + 1) / 2)
    n = F.col("n1") + F.col("n2")
    sums = ranked.agg(
        F.sum("x").alias("n1"), F.sum(F.col("n") - F.col("x")).alias("n2"), F.sum(F.col("x") * F.col("rank")).alias("r1"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("ties"),
    )
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    mean = F.col("n1") * F.col("n2") / 2
    corrected = 1 - F.col("ties") / (F.pow(n.cast("double"), F.lit(3.0)) - n)
    sd = F.sqrt(corrected * F.col("n1") * F.col("n2") * (n + 1) / 12)
    larger = F.greatest(u, F.col("n1") * F.col("n2") - u)
    z = F.when(sd > 0, (larger - mean - (0.5 if continuity else 0.0)) / sd)
    return sums.select("n1", "n2", u.alias("u"), z.alias("z")).withColumn("p", 1 - ndtr(F.col("z")))
