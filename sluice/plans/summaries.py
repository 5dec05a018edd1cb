"""Frequencies and quantiles from mergeable summaries, held against exact figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events, floor_to
from sluice.operators import frequent

CASES = Cases()
ERROR, CONFIDENCE, SHARE = 0.002, 0.999, 0.015
#: DuckDB and Spark: an item whose values are uneven.
_ITEM = "CAST(json_extract(props, '$.k')::BIGINT * json_extract(props, '$.k')::BIGINT // 97 AS BIGINT)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf_dir).select("event_type", "sec", "value", F.floor(k * k / 97).cast("long").alias("item"))


@CASES.add(f"""
    WITH c AS (SELECT event_type, {_ITEM} AS item, count(*) AS n FROM {EVENTS} GROUP BY ALL), t AS (SELECT event_type, sum(n) AS total FROM c GROUP BY 1)
    SELECT event_type, item, n, CAST(total AS BIGINT) AS total, true AS never_less, true AS close FROM c JOIN t USING (event_type) WHERE n > total * {SHARE}""")
def count_min_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items above a share of each type's rows, out of hourly counters merged to one sketch; a bounded list names those to ask for.

    n is exact; never_less and close say how the estimates stand to it.
    """
    rows = _items(spark, sf_dir).withColumn("hour", floor_to("sec", 3600))
    hourly = frequent.count_min(rows, ["event_type", "hour"], "item", ERROR, CONFIDENCE)
    sketch = frequent.merged_counters(hourly, ["event_type"])
    asked = frequent.misra_gries(rows, ["event_type"], "item", int(1 / SHARE)).select("event_type", "item")
    found = frequent.estimated(sketch, ["event_type"], asked, "item", ERROR, CONFIDENCE).join(frequent.totals(sketch, ["event_type"]), "event_type")
    exact = rows.groupBy("event_type", "item").agg(F.count("*").alias("n"))
    both = found.filter(F.col("estimate") > F.col("total") * SHARE).join(exact, ["event_type", "item"]).filter(F.col("n") > F.col("total") * SHARE)
    return both.select("event_type", "item", "n", "total", (F.col("estimate") >= F.col("n")).alias("never_less"), (F.col("estimate") - F.col("n") <= F.col("total") * ERROR).alias("close"))


@CASES.add(f"""
    WITH c AS (SELECT event_type, {_ITEM} AS item, count(*) AS n FROM {EVENTS} GROUP BY ALL), t AS (SELECT event_type, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1)
    SELECT event_type, item, n, total, true AS bounded FROM c JOIN t USING (event_type) WHERE n * 41 > total""")
def frequent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of more than one row in 41 of each type, from lists of 40 counters, counted exactly in a second pass.

    bounded: the list's count lies below the exact one by no more than its error, and the error by no more than its bound.
    """
    rows = _items(spark, sf_dir)
    listed = frequent.misra_gries(rows, ["event_type"], "item", 40).withColumnsRenamed({"n": "low"}).drop("total")
    exact = frequent.frequent(rows, ["event_type"], "item", 1 / 41)
    gap = F.col("n") - F.col("low")
    return exact.join(listed, ["event_type", "item"], "left").select("event_type", "item", "n", "total", F.coalesce((gap >= 0) & (gap <= F.col("error")) & (F.col("error") * 41 <= F.col("total")), F.lit(False)).alias("bounded"))


@CASES.add(f"""
    SELECT event_type, sec // 864000 * 864000 AS bucket, count(*) AS n, q AS share, true AS close FROM {EVENTS}, (SELECT unnest([0.5::DOUBLE, 0.9, 0.99]) AS q) GROUP BY ALL""")
def day_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of ten days from sketches of an hour each; close: the quantile's rank in all values is within two per cent of the wanted one."""
    rows = _items(spark, sf_dir)
    hourly = frequent.quantile_sketches(rows, ["event_type", floor_to("sec", 3600).alias("hour")], "value")
    merged = frequent.merged_quantiles(hourly, ["event_type", floor_to("hour", 864_000).alias("bucket")])
    wanted = merged.select("event_type", "bucket", F.explode(F.array(*[F.struct(F.lit(q).alias("share"), frequent.quantile("sketch", q).alias("estimate")) for q in (0.5, 0.9, 0.99)])).alias("q")).select("event_type", "bucket", "q.*")
    # The estimates are few: three for each type and ten days.
    met = rows.withColumn("bucket", floor_to("sec", 864_000)).join(wanted, ["event_type", "bucket"])
    ranks = met.groupBy("event_type", "bucket", "share").agg(F.count("*").alias("n"), F.count_if(F.col("value") < F.col("estimate")).alias("below"), F.count_if(F.col("value") <= F.col("estimate")).alias("upto"))
    inside = (F.col("below") <= (F.col("share") + 0.02) * F.col("n")) & (F.col("upto") >= (F.col("share") - 0.02) * F.col("n"))
    return ranks.select("event_type", "bucket", "n", "share", inside.alias("close"))
