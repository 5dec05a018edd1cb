"""Tables that are changed in part, and read back: merges by key and ranges deleted and inserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.cases import Cases
from sluice.session import scratch, table
from sluice.sources import tables

CASES = Cases()

_MONTH = "strftime(o_orderdate, '%Y-%m')"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("cost"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.lit(0).alias("version"))


@CASES.add(f"""
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'closed' ELSE o_orderstatus END AS state, CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS cost,
        CASE WHEN o_orderkey % 21 = 0 THEN 'moved' ELSE {_MONTH} END AS month FROM orders WHERE o_orderkey % 15 <> 5),
    n AS (SELECT -o_orderkey - 1 AS o_orderkey, 'new' AS state, CAST(1 AS DECIMAL(18,2)) AS cost, 'later' AS month FROM orders WHERE o_orderkey % 50 = 0),
    a AS (SELECT * FROM o UNION ALL SELECT * FROM n)
    SELECT month, state, count(*) AS n, round(sum(cost)::DOUBLE, 2) AS cost, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM a GROUP BY ALL""")
def upsert_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task table by month into which changes are merged twice over: new states and costs, moves, deletions and new tasks; an older change of a key loses."""
    path = scratch(spark, "tasks")
    tasks = _tasks(spark, sf_dir).withColumnRenamed("o_orderstatus", "state").drop("o_custkey")
    kind = tasks.withColumn("gone", F.lit(False))
    tables.upsert(kind, path, ["o_orderkey"], "month", ["version"])
    key = F.col("o_orderkey")
    changed = kind.filter(key % 3 == 0).withColumns({"state": F.lit("closed"), "cost": (F.col("cost") * 2).cast("decimal(18,2)"), "month": F.when(key % 21 == 0, "moved").otherwise(F.col("month")), "version": F.lit(2)})
    older = kind.filter(key % 3 == 0).withColumns({"state": F.lit("stale"), "version": F.lit(1)})
    dropped = kind.filter(key % 15 == 5).withColumns({"gone": F.lit(True), "version": F.lit(3)})
    added = kind.filter(key % 50 == 0).withColumns({"o_orderkey": -key - 1, "state": F.lit("new"), "cost": F.lit(1).cast("decimal(18,2)"), "month": F.lit("later"), "version": F.lit(1)})
    changes = changed.unionByName(older).unionByName(dropped).unionByName(added)
    for _ in range(2):
        tables.upsert(changes, path, ["o_orderkey"], "month", ["version"], F.col("gone"))
    back = spark.read.schema("o_orderkey long, state string, cost decimal(18,2), version int, gone boolean, month string").parquet(path)
    return back.groupBy("month", "state").agg(F.count("*").alias("n"), F.round(F.sum("cost").cast("double"), 2).alias("cost"), F.sum("o_orderkey").alias("keys"))


@CASES.add(f"""
    WITH o AS (SELECT {_MONTH} AS month, CAST(o_totalprice AS DECIMAL(18,2)) AS cost, o_orderstatus FROM orders), m AS (SELECT list_sort(list(DISTINCT month)) AS l FROM o),
    r AS (SELECT l[len(l) // 3 + 1] AS low, l[2 * len(l) // 3 + 1] AS high FROM m)
    SELECT month, CASE WHEN month BETWEEN low AND high THEN 'new' ELSE 'old' END AS origin, count(*) AS n, round(sum(cost * CASE WHEN month BETWEEN low AND high THEN 3 ELSE 1 END)::DOUBLE, 2) AS cost
    FROM o, r WHERE NOT (month BETWEEN low AND high AND o_orderstatus = 'F') GROUP BY ALL""")
def replace_month_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly costs of which a range of months is deleted and inserted at another rate, twice over; months without new rows would be empty."""
    path = scratch(spark, "costs")
    tasks = _tasks(spark, sf_dir)
    monthly = lambda rows, rate, origin: rows.groupBy("month").agg(F.count("*").alias("n"), F.sum(F.col("cost") * rate).cast("decimal(18,2)").alias("cost")).withColumn("origin", F.lit(origin))
    months = sorted(r[0] for r in tasks.select("month").distinct().collect())
    low, high = months[len(months) // 3], months[2 * len(months) // 3]
    tables.replace_range(monthly(tasks, 1, "old"), path, "month", months[0], months[-1])
    new = monthly(tasks.filter(F.col("month").between(low, high) & (F.col("o_orderstatus") != "F")), 3, "new")
    for _ in range(2):
        tables.replace_range(new, path, "month", low, high)
    back = spark.read.schema("n long, cost decimal(18,2), origin string, month string").parquet(path)
    return back.select("month", "origin", "n", F.round(F.col("cost").cast("double"), 2).alias("cost"))
