"""Account, request and sign-up metrics over service logs; events stand in for the log messages.

user_id is the account, event_type the kind of request, value its latency, `k` of props its status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events, floor_to, rounded
from sluice.session import table

CASES = Cases()

#: DuckDB: events with an HTTP-like status from 100 to 599.
STATUS = f"(SELECT *, 100 + (json_extract(props, '$.k')::BIGINT * 5) AS status FROM {EVENTS})"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with a status from 100 to 599."""
    return events(spark, sf_dir).withColumn("status", 100 + F.get_json_object("props", "$.k").cast("long") * 5)


@CASES.add(f"""
    WITH g AS (SELECT user_id, sec // 86400 AS day, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id, sec // 86400 ORDER BY ts, event_id) AS gap FROM {EVENTS})
    SELECT user_id, day, count(gap) AS n, round(avg(gap), 3) AS mean, round(stddev_samp(gap), 3) AS sd FROM g WHERE gap IS NOT NULL GROUP BY 1, 2 HAVING count(gap) >= 3 AND avg(gap) <= 14400""")
def inter_arrival_abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose requests of a day follow each other within four hours on average."""
    rows = events(spark, sf_dir).select("user_id", F.floor(F.col("sec") / 86400).cast("long").alias("day"), (F.unix_micros("ts") / 1e6).alias("t"), "event_id")
    gap = F.col("t") - F.lag("t").over(W.partitionBy("user_id", "day").orderBy("t", "event_id"))
    sums = rows.withColumn("gap", gap).filter("gap is not null").groupBy("user_id", "day").agg(F.count("gap").alias("n"), F.avg("gap").alias("m"), F.stddev_samp("gap").alias("s"))
    return sums.filter("n >= 3 and m <= 14400").select("user_id", "day", "n", rounded(F.col("m"), "mean", 3), rounded(F.col("s"), "sd", 3))


@CASES.add(f"""
    SELECT sec // 3600 * 3600 AS bucket, count(*) FILTER (event_type = 'purchase') AS success, count(*) FILTER (event_type = 'error') AS failure,
        round(100.0 * count(*) FILTER (event_type = 'error') / nullif(count(*) FILTER (event_type IN ('error', 'purchase')), 0), 6) AS percent FROM {EVENTS} GROUP BY 1""")
def success_failure_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes, failures and the failures' share of both by hour."""
    sums = events(spark, sf_dir).groupBy(floor_to("sec", 3600).alias("bucket")).agg(F.count_if(F.col("event_type") == "purchase").alias("success"), F.count_if(F.col("event_type") == "error").alias("failure"))
    return sums.withColumn("percent", F.round(F.try_divide(100.0 * F.col("failure"), F.col("success") + F.col("failure")), 6))


@CASES.add(f"""
    WITH g AS (SELECT event_type, user_id % 10 AS pid, sec // 60 * 60 AS bucket, max(value) AS heap, max(json_extract(props, '$.k')::BIGINT) AS rss, max(sec) AS seen FROM {EVENTS} GROUP BY 1, 2, 3)
    SELECT event_type, pid, bucket, heap, rss FROM g JOIN (SELECT event_type, pid FROM g GROUP BY 1, 2 HAVING max(seen) > (SELECT max(seen) FROM g) - 6000) USING (event_type, pid)""")
def gauge_max_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest gauges by process and minute, for processes seen in the last 100 minutes."""
    rows = events(spark, sf_dir)
    made = rows.groupBy("event_type", (F.col("user_id") % 10).alias("pid"), floor_to("sec", 60).alias("bucket"))
    gauges = made.agg(F.max("value").alias("heap"), F.max(F.get_json_object("props", "$.k").cast("long")).alias("rss"), F.max("sec").alias("seen"))
    last = rows.agg(F.max("sec")).scalar()
    alive = gauges.groupBy("event_type", "pid").agg(F.max("seen").alias("seen")).withColumn("last", last).filter("seen > last - 6000").select("event_type", "pid")
    return gauges.join(alive, ["event_type", "pid"]).select("event_type", "pid", "bucket", "heap", "rss")


@CASES.add(f"SELECT sec // 3600 * 3600 AS bucket, count(*) AS n FROM {STATUS} WHERE status = 430 GROUP BY 1")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one status by hour."""
    return requests(spark, sf_dir).filter("status = 430").groupBy(floor_to("sec", 3600).alias("bucket")).agg(F.count("*").alias("n"))


@CASES.add(f"SELECT event_type, sec // 3600 * 3600 AS bucket, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM {EVENTS} GROUP BY 1, 2")
def avg_latency_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, sum and mean latency by path and hour."""
    return events(spark, sf_dir).groupBy("event_type", floor_to("sec", 3600).alias("bucket")).agg(F.count("*").alias("n"), rounded(F.sum("value"), "total"), rounded(F.avg("value"), "mean"))


@CASES.add(f"SELECT sec // 86400 AS day, count(*) FILTER (status < 400) AS success, count(*) FILTER (status >= 400) AS failure FROM {STATUS} GROUP BY 1")
def resend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes and failures by day."""
    return requests(spark, sf_dir).groupBy(F.floor(F.col("sec") / 86400).cast("long").alias("day")).agg(F.count_if(F.col("status") < 400).alias("success"), F.count_if(F.col("status") >= 400).alias("failure"))


@CASES.add(f"""
    SELECT sec // 3600 * 3600 AS bucket, CASE WHEN status BETWEEN 100 AND 599 THEN (status // 100) || 'xx' ELSE 'unknown' END AS class, count(*) AS n FROM {STATUS} GROUP BY 1, 2""")
def status_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by status class and hour."""
    kind = F.when(F.col("status").between(100, 599), F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx"))).otherwise("unknown")
    return requests(spark, sf_dir).groupBy(floor_to("sec", 3600).alias("bucket"), kind.alias("class")).agg(F.count("*").alias("n"))


@CASES.add(f"""
    WITH a AS (SELECT user_id, sec // 86400 AS day, list(event_type ORDER BY sec, event_id) AS kinds FROM {EVENTS} GROUP BY 1, 2)
    SELECT user_id, day, CAST(len(kinds) AS BIGINT) AS n, list_contains(kinds, 'view') AS intent, list_contains(kinds, 'click') AS engaged, list_contains(kinds, 'purchase') AS success,
        CASE WHEN list_contains(kinds, 'error') THEN array_to_string(kinds, ',') END AS failed FROM a""")
def signup_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel of each user and day from the array of events; the whole array where one failed."""
    order = F.sort_array(F.collect_list(F.struct("sec", "event_id", "event_type")))
    made = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("sec") / 86400).cast("long").alias("day")).agg(order.alias("e")).withColumn("kinds", F.col("e.event_type"))

    def has(kind: str):
        return F.exists("kinds", lambda e: e == kind)

    return made.select("user_id", "day", F.size("kinds").cast("long").alias("n"), has("view").alias("intent"), has("click").alias("engaged"), has("purchase").alias("success"), F.when(has("error"), F.array_join("kinds", ",")).alias("failed"))


@CASES.add(f"""
    SELECT CAST(w AS BIGINT) * 86400 AS start, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'purchase') AS purchase
    FROM (SELECT event_type, unnest(generate_series((sec // 86400 - 6) + (3 - (sec // 86400 - 6) % 3) % 3, sec // 86400, 3)) AS w FROM {EVENTS}) GROUP BY 1""")
def creates_by_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two kinds over seven days, a window every three days."""
    rows = events(spark, sf_dir).groupBy(F.window("ts", "7 days", "3 days").alias("w"))
    made = rows.agg(F.count_if(F.col("event_type") == "signup").alias("signup"), F.count_if(F.col("event_type") == "purchase").alias("purchase"))
    return made.select(F.unix_seconds("w.start").alias("start"), "signup", "purchase")


@CASES.add("""
    WITH d AS (SELECT CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS day, count(*) FILTER (o_orderstatus <> 'F') AS success, count(*) FILTER (o_orderstatus = 'F') AS failure FROM orders GROUP BY 1)
    SELECT day, success, failure, CAST(sum(success) OVER w AS BIGINT) AS total_success, CAST(sum(failure) OVER w AS BIGINT) AS total_failure FROM d WINDOW w AS (ORDER BY day)""")
def migrations_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily and running counts of successes and failures; a row a day reaches the window."""
    day = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000).cast("long")
    daily = table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(F.count_if(F.col("o_orderstatus") != "F").alias("success"), F.count_if(F.col("o_orderstatus") == "F").alias("failure"))
    over = W.orderBy("day")
    return daily.select("day", "success", "failure", F.sum("success").over(over).alias("total_success"), F.sum("failure").over(over).alias("total_failure"))


@CASES.add(f"""
    WITH r AS (SELECT sec // 3600 * 3600 AS bucket, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, quantile_cont(value, 0.5) AS latency FROM {EVENTS} GROUP BY 1)
    SELECT bucket, n, errors, round(latency, 6) AS latency, CASE WHEN errors * 100.0 / n > 30 THEN 'errors' WHEN latency > 60 THEN 'latency' WHEN n < 8 THEN 'inactivity' END AS alert FROM r""")
def ingestion_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, errors and median latency by hour with the first alert that applies."""
    sums = events(spark, sf_dir).groupBy(floor_to("sec", 3600).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.percentile("value", 0.5).alias("m"))
    alert = F.when(F.col("errors") * 100.0 / F.col("n") > 30, "errors").when(F.col("m") > 60, "latency").when(F.col("n") < 8, "inactivity")
    return sums.select("bucket", "n", "errors", rounded(F.col("m"), "latency"), alert.alias("alert"))
