"""Traffic monitors: heavy hitters, rolling errors, volume, inactivity, latency and concurrency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events, floor_to, rounded
from sluice.operators import alerts
from sluice.operators import timeseries as series
from sluice.session import table

CASES = Cases()


@CASES.add(f"""
    WITH c AS (SELECT sec // 3600 * 3600 AS bucket, user_id, count(*) AS n FROM {EVENTS} GROUP BY 1, 2),
    t AS (SELECT bucket, sum(n) / count(*) * 1.5 AS threshold FROM c GROUP BY 1)
    SELECT bucket, user_id, n, round(threshold, 6) AS threshold FROM c JOIN t USING (bucket) WHERE n > threshold""")
def heavy_hitters(spark: SparkSession, sf_dir: str, cap: float = 0.5) -> DataFrame:
    """Ids whose count in an hour exceeds the hour's mean count by the cap."""
    counts = events(spark, sf_dir).groupBy(floor_to("sec", 3600).alias("bucket"), "user_id").agg(F.count("*").alias("n"))
    mean = counts.groupBy("bucket").agg((F.sum("n") / F.count("*") * (1 + cap)).alias("threshold"))
    return counts.join(mean, "bucket").filter("n > threshold").select("bucket", "user_id", "n", rounded(F.col("threshold"), "threshold"))


@CASES.add(f"""
    WITH m AS (SELECT event_type, sec // 86400 * 86400 AS bucket, count(*) AS n FROM {EVENTS} GROUP BY 1, 2)
    SELECT a.event_type, a.bucket, a.n, b.n AS week_ago, round((a.n - b.n) * 100.0 / b.n, 6) AS change
    FROM m a JOIN m b ON a.event_type = b.event_type AND a.bucket = b.bucket + 604800""")
def week_over_week_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily volume of each type against the same day a week before, in percent."""
    daily = events(spark, sf_dir).groupBy("event_type", floor_to("sec", 86400).alias("bucket")).agg(F.count("*").alias("n"))
    past = daily.select("event_type", (F.col("bucket") + 7 * 86400).alias("bucket"), F.col("n").alias("week_ago"))
    change = (F.col("n") - F.col("week_ago")) * 100.0 / F.col("week_ago")
    return daily.join(past, ["event_type", "bucket"]).select("event_type", "bucket", "n", "week_ago", rounded(change, "change"))


@CASES.add(f"""
    WITH m AS (SELECT user_id, sec // 3600 * 3600 AS bucket, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM {EVENTS} GROUP BY 1, 2),
    r AS (SELECT user_id, bucket, CAST(sum(errors) OVER w AS BIGINT) AS errors, CAST(sum(n) OVER w AS BIGINT) AS n FROM m
          WINDOW w AS (PARTITION BY user_id ORDER BY bucket RANGE BETWEEN 82800 PRECEDING AND CURRENT ROW))
    SELECT *, round(errors * 100.0 / n, 6) AS percent FROM r WHERE n >= 2 AND errors * 100.0 / n > 40""")
def error_monitor_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose errors of the last 24 hourly rows exceed 40 percent, if there are rows enough."""
    hourly = events(spark, sf_dir).groupBy("user_id", floor_to("sec", 3600).alias("bucket")).agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count("*").alias("c"))
    sums = series.rolling(series.rolling(hourly, "e", 3600, 24, "errors", ["user_id"]), "c", 3600, 24, "n", ["user_id"])
    percent = F.col("errors") * 100.0 / F.col("n")
    return sums.filter((F.col("n") >= 2) & (percent > 40)).select("user_id", "bucket", "errors", "n", rounded(percent, "percent"))


@CASES.add(f"""
    WITH m AS (SELECT DISTINCT user_id, sec // 60 AS minute FROM {EVENTS}),
    g AS (SELECT user_id, minute, minute - lag(minute) OVER (PARTITION BY user_id ORDER BY minute) - 1 AS gap FROM m),
    q AS (SELECT user_id, CAST(ceil(round((quantile_cont(gap, 0.99) + 1) * 5, 9)) AS BIGINT) AS threshold FROM g WHERE gap IS NOT NULL GROUP BY 1)
    SELECT user_id, threshold, count(*) AS gaps, max(gap) AS longest, count(*) FILTER (gap >= threshold) AS timeouts FROM g JOIN q USING (user_id) WHERE gap IS NOT NULL GROUP BY 1, 2""")
def inactivity_gaps(spark: SparkSession, sf_dir: str, factor: float = 5) -> DataFrame:
    """Gaps between active minutes of each key, and how many reach its time-out: its 99th percentile of gaps, plus one, by the factor."""
    minutes = events(spark, sf_dir).select("user_id", F.floor(F.col("sec") / 60).cast("long").alias("minute")).distinct()
    gap = F.col("minute") - F.lag("minute").over(W.partitionBy("user_id").orderBy("minute")) - 1
    gaps = minutes.withColumn("gap", gap).filter("gap is not null").groupBy("user_id", "gap").agg(F.count("*").alias("n"))
    limit = gaps.groupBy("user_id").agg(F.ceil(F.round((F.percentile("gap", 0.99, F.col("n")) + 1) * factor, 9)).cast("long").alias("threshold"))
    return gaps.join(limit, "user_id").groupBy("user_id", "threshold").agg(F.sum("n").alias("gaps"), F.max("gap").alias("longest"), F.coalesce(F.sum(F.when(F.col("gap") >= F.col("threshold"), F.col("n"))), F.lit(0)).alias("timeouts"))


@CASES.add(f"""
    WITH c AS (SELECT event_type, json_extract(props, '$.k')::BIGINT AS detail, count(*) AS n FROM {EVENTS} GROUP BY 1, 2)
    SELECT event_type, detail, n, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, detail) AS place FROM c) WHERE place <= 5""")
def topn_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent details of each type; counted before they are ranked."""
    counts = events(spark, sf_dir).groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("detail")).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("n"), "detail")).cast("long")
    return counts.withColumn("place", place).filter("place <= 5")


@CASES.add(f"""
    SELECT event_type, bucket, event_id, value FROM (SELECT event_type, sec // 86400 * 86400 AS bucket, event_id, value,
        row_number() OVER (PARTITION BY event_type, sec // 86400 ORDER BY sec DESC, event_id DESC) AS place FROM {EVENTS}) WHERE place <= 3""")
def sample_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest rows of each type and day."""
    rows = events(spark, sf_dir).select("event_type", floor_to("sec", 86400).alias("bucket"), "event_id", "value", "sec")
    place = F.row_number().over(W.partitionBy("event_type", "bucket").orderBy(F.desc("sec"), F.desc("event_id")))
    return rows.withColumn("place", place).filter("place <= 3").select("event_type", "bucket", "event_id", "value")


@CASES.add(f"""
    WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) AS place FROM {EVENTS})
    SELECT user_id, count(*) FILTER (place <= 20) AS recent, round(quantile_cont(value, 0.9) FILTER (place <= 20), 6) AS p90_recent, round(quantile_cont(value, 0.9), 6) AS p90_all FROM r GROUP BY 1""")
def latest_n_vs_history_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 90th percentile of each key's last 20 values against that of its history."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("sec"), F.desc("event_id")))
    ranked = events(spark, sf_dir).withColumn("recent", F.when(place <= 20, F.col("value")))
    return ranked.groupBy("user_id").agg(F.count("recent").alias("recent"), rounded(F.percentile("recent", 0.9), "p90_recent"), rounded(F.percentile("value", 0.9), "p90_all"))


@CASES.add(f"""
    WITH s AS (SELECT event_id, sec // 60 AS a, (sec + CAST(floor(value * 60) AS BIGINT)) // 60 AS b FROM {EVENTS}),
    d AS (SELECT a AS minute, 1 AS step FROM s UNION ALL SELECT b, -1 FROM s),
    m AS (SELECT minute, sum(step) AS step FROM d GROUP BY 1)
    SELECT minute, CAST(sum(step) OVER (ORDER BY minute) AS BIGINT) AS running FROM m""")
def running_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks in flight at each minute in which one starts or ends."""
    spans = events(spark, sf_dir).select(F.floor(F.col("sec") / 60).cast("long").alias("a"), F.floor((F.col("sec") + F.floor(F.col("value") * 60)) / 60).cast("long").alias("b"))
    steps = spans.select(F.explode(F.array(F.struct(F.col("a").alias("minute"), F.lit(1).alias("step")), F.struct(F.col("b").alias("minute"), F.lit(-1).alias("step")))).alias("s")).select("s.*")
    by_minute = steps.groupBy("minute").agg(F.sum("step").alias("step"), F.floor(F.min("minute") / 1440).alias("day"))
    # Days are summed first, so that the running sum inside a day needs no task for all minutes.
    days = by_minute.groupBy("day").agg(F.sum("step").alias("total"))
    carried = days.withColumn("before", F.coalesce(F.sum("total").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("step").over(W.partitionBy("day").orderBy("minute"))
    return by_minute.join(carried.select("day", "before"), "day").select("minute", (F.col("before") + inside).cast("long").alias("running"))


@CASES.add(f"""
    SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, round(count(*) FILTER (event_type = 'error') * 100.0 / count(*), 6) AS percent
    FROM {EVENTS} GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (event_type = 'error') * 100.0 / count(*) > 20""")
def plugin_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose failures exceed a percentage of a large enough sample."""
    percent = F.col("failures") * 100.0 / F.col("n")
    counts = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return counts.filter((F.col("n") >= 5) & (percent > 20)).select("user_id", "n", "failures", rounded(percent, "percent"))


#: DuckDB: days whose use is off, by a set of keys of `o`.
_ANOMALY = """SELECT '{label}' AS keys, {shown}, day, hours::DOUBLE AS hours, round(mean, 4) AS mean, round(sd, 4) AS sd FROM (SELECT *, avg(hours::DOUBLE) OVER w AS mean, stddev_pop(hours::DOUBLE) OVER w AS sd, count(*) OVER w AS n
    FROM (SELECT {keys}, day, sum(hours) AS hours FROM o GROUP BY ALL) WINDOW w AS (PARTITION BY {keys} ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)) WHERE n >= 2 AND abs(hours::DOUBLE - mean) - 3 * sd >= 0.005 AND abs(hours::DOUBLE - mean) > 1000"""


@CASES.add(f"""
    WITH o AS (SELECT o_orderpriority AS kind, CASE WHEN o_custkey % 10 > 0 THEN o_orderstatus END AS status, o_custkey % 3 AS zone, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS hours FROM orders)
    {_ANOMALY.format(label='kind,status,zone', shown='kind, status, zone', keys='kind, status, zone')} UNION ALL {_ANOMALY.format(label='kind,status', shown='kind, status, NULL AS zone', keys='kind, status')}""")
def usage_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose use is three standard deviations and 1,000 off the mean of the seven days before, by two sets of keys; keys may be null."""
    orders = table(spark, sf_dir, "orders")
    day = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000).cast("long")
    rows = orders.select(F.col("o_orderpriority").alias("kind"), F.when(F.col("o_custkey") % 10 > 0, F.col("o_orderstatus")).alias("status"), (F.col("o_custkey") % 3).alias("zone"), day.alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("hours"))
    made = [series.off_days(rows, list(keys), "day", "hours", 7, 3.0, 1000.0, 0.005).withColumn("keys", F.lit(",".join(keys))) for keys in (("kind", "status", "zone"), ("kind", "status"))]
    both = made[0].unionByName(made[1], allowMissingColumns=True)
    return both.select("keys", "kind", "status", "zone", "day", F.col("hours").cast("double").alias("hours"), rounded(F.col("mean"), "mean", 4), rounded(F.col("sd"), "sd", 4))


@CASES.add(f"""
    WITH e AS (SELECT user_id % 6 AS logger, sec // 3600 * 3600 AS bucket, event_type IN ('error', 'purchase') AND user_id % 6 < 3 AS bad, json_extract(props, '$.k')::BIGINT // 20 AS detail FROM {EVENTS}),
    c AS (SELECT logger, bucket, count(*) FILTER (NOT bad) AS valid, count(*) FILTER (bad) AS errors FROM e GROUP BY 1, 2),
    r AS (SELECT logger, bucket, CAST(sum(valid) OVER w AS BIGINT) AS valid, CAST(sum(errors) OVER w AS BIGINT) AS errors FROM c WINDOW w AS (PARTITION BY logger ORDER BY bucket RANGE BETWEEN 82800 PRECEDING AND CURRENT ROW)),
    a AS (SELECT *, round(errors * 100.0 / (valid + errors), 6) AS percent FROM r WHERE (valid > 30 OR errors > 30) AND errors * 100.0 / (valid + errors) > 40),
    d AS (SELECT logger, bucket, detail, count(*) AS n FROM e WHERE bad GROUP BY ALL),
    m AS (SELECT a.logger, a.bucket, d.detail, sum(d.n) AS n FROM a JOIN d ON d.logger = a.logger AND d.bucket BETWEEN a.bucket - 82800 AND a.bucket GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY logger, bucket ORDER BY n DESC, detail) AS i FROM m),
    l AS (SELECT logger, bucket, string_agg(n || '/' || detail, ', ' ORDER BY i) AS diagnostic FROM p WHERE i <= 3 GROUP BY 1, 2)
    SELECT a.*, diagnostic FROM a LEFT JOIN l USING (logger, bucket)""")
def ingestion_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loggers whose errors of the last 24 hours exceed 40 per cent, where there are rows enough, with the most frequent errors of that time."""
    bad = F.col("event_type").isin("error", "purchase") & (F.col("user_id") % 6 < 3)
    rows = events(spark, sf_dir).select((F.col("user_id") % 6).alias("logger"), floor_to("sec", 3600).alias("bucket"), bad.alias("bad"), F.floor(F.get_json_object("props", "$.k").cast("long") / 20).alias("detail"))
    counts = rows.groupBy("logger", "bucket").agg(F.count_if(~F.col("bad")).alias("valid"), F.count_if("bad").alias("errors"))
    details = rows.filter("bad").groupBy("logger", "bucket", "detail").agg(F.count("*").alias("n"))
    return alerts.error_alerts(counts, details, ["logger"], 3600, 24, 30, 40.0)


@CASES.add(f"""
    WITH e AS (SELECT DISTINCT user_id % 5 AS worker, event_id, sec // 3600 * 3600 AS bucket, event_type AS state FROM {EVENTS}),
    m AS (SELECT worker, bucket, count(*) FILTER (state = 'signup') AS pending, count(*) FILTER (state = 'view') AS running, count(*) FILTER (state = 'click') AS completed, count(*) FILTER (state = 'purchase') AS failed, count(*) FILTER (state = 'error') AS exception FROM e GROUP BY 1, 2)
    SELECT *, CAST(greatest(sum(running - completed - CASE WHEN bucket % 7200 = 0 THEN failed ELSE 0 END) OVER (PARTITION BY worker ORDER BY bucket), 0) AS BIGINT) AS concurrency FROM m""")
def worker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of tasks' states, some of them sent again, by worker type and hour, with the tasks that run: those that never started don't end."""
    rows = events(spark, sf_dir)
    started = (F.col("event_type") != "error") & ((F.col("event_type") != "purchase") | (F.pmod(floor_to("sec", 3600), F.lit(7200)) == 0))
    sent = rows.select((F.col("user_id") % 5).alias("worker"), F.col("event_id").alias("task"), F.lit(0).alias("run"), F.col("event_type").alias("state"), "sec", started.alias("started"))
    again = sent.filter(F.col("task") % 10 == 0)
    names = {"signup": "pending", "view": "running", "click": "completed", "purchase": "failed", "error": "exception"}
    told = sent.unionByName(again).withColumn("state", F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("state")))
    return series.task_states(told, ["worker"], ["task", "run"], "state", "sec", "started", 3600)
