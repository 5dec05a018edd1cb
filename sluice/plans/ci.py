"""Cost and task analytics of a build farm; orders stand in for tasks, their lines for runs, customers for workers.

o_orderdate is when a task started, its price the cost in cents, c_mktsegment the worker type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events, rounded
from sluice.operators import intervals
from sluice.session import table

CASES = Cases()


def _money(name: str):
    return F.col(name).cast("decimal(18,2)")


@CASES.add("""
    SELECT DISTINCT l_orderkey, CASE WHEN regexp_matches(l_returnflag, '^[AR]$') THEN 'resolved' ELSE 'open' END AS state, l_linestatus AS result, CAST(date_diff('millisecond', o_orderdate, l_shipdate) AS BIGINT) AS lag_ms,
        l_returnflag || '/' || l_linestatus AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def task_summary_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct runs with state by pattern, the lag in milliseconds and a joined label."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lag = ((F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 1000).cast("long")
    state = F.when(F.col("l_returnflag").rlike("^[AR]$"), "resolved").otherwise("open")
    return rows.select("l_orderkey", state.alias("state"), F.col("l_linestatus").alias("result"), lag.alias("lag_ms"), F.array_join(F.array("l_returnflag", "l_linestatus"), "/").alias("label")).distinct()


@CASES.add("""
    WITH t AS (SELECT o_orderkey, o_orderstatus AS kind, CASE WHEN o_custkey % 10 > 0 THEN o_orderpriority END AS tier, o_totalprice FROM orders),
    c AS (SELECT kind, tier, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, count(*) AS n FROM t GROUP BY ALL)
    SELECT o_orderkey, kind, tier, round(o_totalprice / (SELECT c.total::DOUBLE FROM c WHERE c.kind = t.kind AND c.tier IS NOT DISTINCT FROM t.tier), 9) AS share FROM t WHERE kind LIKE '_'""")
def kind_costs_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task's share of its group's cost: the correlated sum as a null-safe join with group totals."""
    tasks = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("kind"), F.when(F.col("o_custkey") % 10 > 0, F.col("o_orderpriority")).alias("tier"), "o_totalprice")
    totals = tasks.groupBy(F.col("kind").alias("k"), F.col("tier").alias("t")).agg(F.sum(_money("o_totalprice")).cast("double").alias("total"))
    wanted = tasks.filter(F.col("kind").like("_"))
    joined = wanted.join(totals, F.col("kind").eqNullSafe(F.col("k")) & F.col("tier").eqNullSafe(F.col("t")), "left")
    return joined.select("o_orderkey", "kind", "tier", rounded(F.col("o_totalprice") / F.col("total"), "share", 9))


@CASES.add("""
    WITH n AS (SELECT o_custkey AS g, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS cost, list_sort(list(DISTINCT o_orderstatus)) AS states, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
    o AS (SELECT o_custkey AS g, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS cost, list_sort(list(DISTINCT o_orderstatus)) AS states, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
    SELECT coalesce(n.g, o.g) AS g, CAST(coalesce(o.cost, 0) + coalesce(n.cost, 0) AS DOUBLE) AS cost, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.states, []), coalesce(n.states, [])))), ',') AS states,
        least(n.lo, o.lo) AS first, greatest(n.hi, o.hi) AS last FROM n FULL JOIN o ON n.g = o.g""")
def taskgroup_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New group totals merged into old ones: matched groups add up, new ones are inserted, old ones stay."""
    orders = table(spark, sf_dir, "orders")

    def totals(parity: int) -> DataFrame:
        made = orders.filter(F.col("o_orderkey") % 2 == parity).groupBy(F.col("o_custkey").alias("g"))
        return made.agg(F.sum(_money("o_totalprice")).alias("cost"), F.collect_set("o_orderstatus").alias("states"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))

    new, old = totals(0).alias("n"), totals(1).alias("o")
    none = F.array().cast("array<string>")
    states = F.sort_array(F.array_distinct(F.flatten(F.array(F.coalesce("o.states", none), F.coalesce("n.states", none)))))
    cost = F.coalesce("o.cost", F.lit(0)) + F.coalesce("n.cost", F.lit(0))
    return new.join(old, "g", "full").select("g", cost.cast("double").alias("cost"), F.array_join(states, ",").alias("states"), F.least("n.lo", "o.lo").alias("first"), F.greatest("n.hi", "o.hi").alias("last"))


@CASES.add(f"""
    WITH s AS (SELECT event_type, event_id, sec AS a, sec + CAST(floor(value * 60) AS BIGINT) AS b FROM {EVENTS}), p AS (SELECT x.event_type, x.event_id, count(DISTINCT y.event_id) AS n FROM s x JOIN s y ON x.event_type = y.event_type AND y.a >= x.a AND y.a < greatest(x.b, x.a + 0) GROUP BY 1, 2)
    SELECT event_type, max(n) AS most, round(avg(n), 6) AS mean, count(*) AS spans FROM p GROUP BY 1""")
def interval_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tasks start within each task of the same type: the most and the mean."""
    spans = events(spark, sf_dir).select("event_type", "event_id", F.col("sec").alias("a"), (F.col("sec") + F.floor(F.col("value") * 60)).cast("long").alias("b"))
    counts = intervals.starts_within(spans, ["event_type"], "a", "b", 86400).withColumnRenamed("starts", "n")
    return counts.groupBy("event_type").agg(F.max("n").alias("most"), rounded(F.avg("n"), "mean"), F.count("*").alias("spans"))


@CASES.add(f"""
    WITH s AS (SELECT user_id, event_type, sec, lead(sec) OVER w AS after, lag(sec) OVER w AS before FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id))
    SELECT user_id, CAST(coalesce(sum(after - sec) FILTER (event_type = 'signup'), 0) AS BIGINT) AS boot, CAST(coalesce(sum(after - sec) FILTER (event_type = 'view'), 0) AS BIGINT) AS idle,
        CAST(coalesce(sum(after - sec) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS task, CAST(coalesce(sum(sec - before) FILTER (event_type = 'signup'), 0) AS BIGINT) AS reboot, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds,
        count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY 1""")
def worker_state_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that each worker spent booting, idle, in tasks and before a reboot, from the next and last event."""
    own = W.partitionBy("user_id").orderBy("sec", "event_id")
    rows = events(spark, sf_dir).select("user_id", "event_type", "sec", F.lead("sec").over(own).alias("after"), F.lag("sec").over(own).alias("before"))

    def spent(kind: str, value, name: str):
        return F.coalesce(F.sum(F.when(F.col("event_type") == kind, value)), F.lit(0)).cast("long").alias(name)

    ahead = F.col("after") - F.col("sec")
    return rows.groupBy("user_id").agg(
        spent("signup", ahead, "boot"), spent("view", ahead, "idle"), spent("purchase", ahead, "task"), spent("signup", F.col("sec") - F.col("before"), "reboot"),
        F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"), F.count_if(F.col("event_type") == "error").alias("errors"),
    )


@CASES.add("""
    WITH w AS (SELECT c_mktsegment AS worker, c_nationkey AS zone, count(*) AS hours FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2),
    c AS (SELECT c_mktsegment AS worker, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS cost FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING sum(o_totalprice) > 0)
    SELECT c.worker, w.zone, 'allocated' AS origin, round(c.cost::DOUBLE * w.hours / sum(w.hours) OVER (PARTITION BY c.worker), 4) AS cost FROM w RIGHT JOIN c ON w.worker = c.worker
    UNION ALL SELECT c_mktsegment, c_nationkey, 'idle', round(-sum(c_acctbal), 4) FROM customer WHERE c_acctbal < 0 GROUP BY 1, 2
    UNION ALL SELECT 'storage', NULL, 'fixed', round(sum(CAST(s_acctbal AS DECIMAL(18,2)))::DOUBLE, 4) FROM supplier""")
def cost_allocation_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs spread over zones by hours, costs of idle workers, and fixed costs, in one table."""
    customers = table(spark, sf_dir, "customer")
    hours = customers.filter("c_acctbal > 0").groupBy(F.col("c_mktsegment").alias("worker"), F.col("c_nationkey").alias("zone")).agg(F.count("*").alias("hours"))
    cost = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("worker")).agg(F.sum(_money("o_totalprice")).alias("total")).filter("total > 0")
    share = F.col("total").cast("double") * F.col("hours") / F.sum("hours").over(W.partitionBy("worker"))
    allocated = hours.join(cost, "worker", "right").select("worker", "zone", F.lit("allocated").alias("origin"), rounded(share, "cost", 4))
    idle = customers.filter("c_acctbal < 0").groupBy(F.col("c_mktsegment").alias("worker"), F.col("c_nationkey").alias("zone")).agg(F.round(-F.sum("c_acctbal"), 4).alias("cost")).select("worker", "zone", F.lit("idle").alias("origin"), "cost")
    fixed = table(spark, sf_dir, "supplier").agg(F.round(F.sum(_money("s_acctbal")).cast("double"), 4).alias("cost")).select(F.lit("storage").alias("worker"), F.lit(None).cast("int").alias("zone"), F.lit("fixed").alias("origin"), "cost")
    return allocated.unionByName(idle).unionByName(fixed)


@CASES.add("""
    WITH p AS (SELECT p_partkey, p_retailprice, [{'key': 'brand', 'value': p_brand}, {'key': 'size', 'value': p_size::VARCHAR}, {'key': 'type', 'value': p_type}] AS labels FROM part),
    u AS (SELECT p_partkey, p_retailprice, unnest(labels) AS l FROM p)
    SELECT l.key AS label, l.value AS value, count(*) AS n, round(sum(CAST(p_retailprice AS DECIMAL(18,2)))::DOUBLE, 4) AS cost FROM u WHERE l.key <> 'size' GROUP BY 1, 2 HAVING count(*) >= 2""")
def label_unnest_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by label, from arrays of key and value."""
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    labels = F.filter(F.array(pair("brand", F.col("p_brand")), pair("size", F.col("p_size")), pair("type", F.col("p_type"))), lambda l: l["key"] != "size")
    rows = table(spark, sf_dir, "part").select("p_retailprice", F.explode(labels).alias("l"))
    made = rows.groupBy(F.col("l.key").alias("label"), F.col("l.value").alias("value")).agg(F.count("*").alias("n"), F.round(F.sum(_money("p_retailprice")).cast("double"), 4).alias("cost"))
    return made.filter("n >= 2")


@CASES.add("""
    WITH q AS (SELECT o_orderpriority AS kind, unnest(generate_series(0, 100, 10)) AS percent, unnest(quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS value FROM orders WHERE o_orderstatus NOT IN ('P') GROUP BY 1)
    SELECT kind, CAST(percent AS INTEGER) AS percent, round(value, 4) AS value FROM q""")
def quantile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deciles of the cost of each kind, a row for each."""
    steps = [k / 10 for k in range(11)]
    made = table(spark, sf_dir, "orders").filter(~F.array_contains(F.array(F.lit("P")), F.col("o_orderstatus"))).groupBy(F.col("o_orderpriority").alias("kind"), "o_totalprice").agg(F.count("*").alias("n"))
    made = made.groupBy("kind").agg(F.percentile("o_totalprice", F.array(*[F.lit(s) for s in steps]), F.col("n")).alias("q"))
    return made.select("kind", F.posexplode("q").alias("place", "value")).select("kind", (F.col("place") * 10).alias("percent"), rounded(F.col("value"), "value", 4))


@CASES.add("""
    SELECT p_type AS name, count(l_quantity) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY 1""")
def duration_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean duration by name since a date."""
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_type").alias("name")).agg(F.count("l_quantity").alias("n"), rounded(F.avg("l_quantity"), "mean", 4))


@CASES.add("SELECT c_mktsegment, count(*) AS n FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000) ON o_custkey = c_custkey WHERE o_custkey IS NULL GROUP BY 1")
def missing_costs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers without a cost row, by type."""
    costly = table(spark, sf_dir, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(costly, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@CASES.add("""
    WITH r AS (SELECT c_mktsegment AS worker, c_nationkey AS zone, count(*) AS workers FROM customer GROUP BY 1, 2),
    d AS (SELECT *, unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS day FROM r)
    SELECT worker, zone, CAST(day AS DATE) AS day, round(1.5 * workers, 4) AS cost FROM d WHERE extract(dow FROM day) BETWEEN 1 AND 5""")
def cost_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate for each worker, spread over the working days of a month."""
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))).alias("day")
    rates = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("worker"), F.col("c_nationkey").alias("zone")).agg(F.count("*").alias("workers"))
    return rates.select("worker", "zone", "workers", days).filter(F.dayofweek("day").between(2, 6)).select("worker", "zone", "day", rounded(1.5 * F.col("workers"), "cost", 4))


@CASES.add("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def backfill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected tasks that have no run yet."""
    expected = table(spark, sf_dir, "orders").select("o_orderkey")
    return expected.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
