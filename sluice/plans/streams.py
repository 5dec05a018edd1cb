"""Streaming twins of batch queries: the event table is replayed through a stream that ends with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases
from sluice.session import scratch
from sluice.streaming import queries as streams
from sluice.streaming import state

CASES = Cases()


def _replay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The event table as a stream, and a fresh folder for checkpoint and output."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may name a file as well as a folder
    return raw.withColumn("ts", F.col("ts").cast("timestamp")), scratch(spark, "stream")


@CASES.add(f"""
    SELECT sec // 3600 * 3600 AS bucket, event_type, count(*) AS n, round(sum(value), 6) AS total FROM {EVENTS} WHERE sec // 3600 * 3600 + 7200 <= (SELECT max(epoch_us(ts)) / 1e6 FROM events) GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows that the watermark has closed."""
    rows, at = _replay(spark, sf_dir)
    streams.run_to_parquet(streams.tumbling_counts(rows), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("bucket long, event_type string, n long, total double").parquet(f"{at}/out")


@CASES.add("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each user and type, with a time to live beyond the table's span."""
    rows, at = _replay(spark, sf_dir)
    streams.run_to_parquet(streams.deduplicated(rows, ["user_id", "event_type"], "60 days").select("user_id", "event_type"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("user_id long, event_type string").parquet(f"{at}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@CASES.add(f"""
    WITH RECURSIVE r AS (SELECT user_id, sec, row_number() OVER (PARTITION BY user_id ORDER BY sec) AS i FROM (SELECT DISTINCT user_id, sec FROM {EVENTS} WHERE event_type = 'error')),
    s AS (SELECT user_id, i, sec, sec AS sent FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, r.sec, CASE WHEN r.sec - s.sent > 172800 THEN r.sec ELSE s.sent END FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
    SELECT user_id, sec FROM s WHERE sec = sent""")
def stream_stateful_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The throttled alerts of alert_throttle, by keyed state."""
    rows, at = _replay(spark, sf_dir)
    streams.run_to_parquet(streams.throttled_alerts(rows.filter("event_type = 'error'"), 2880), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("user_id long, sec long").parquet(f"{at}/out")


@CASES.add(f"""
    WITH s AS (SELECT user_id, sec, CASE WHEN sec - lag(sec) OVER w < 14400 THEN 0 ELSE 1 END AS opens FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY sec)), g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY sec) AS i FROM s),
    n AS (SELECT user_id, min(sec) AS start, max(sec) AS last, count(*) AS n FROM g GROUP BY user_id, i)
    SELECT user_id, start, n FROM n WHERE last + 14400 + 3600 <= (SELECT max(epoch_us(ts)) / 1e6 FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a gap of four hours ends and the watermark has closed."""
    rows, at = _replay(spark, sf_dir)
    whole = rows.withColumn("ts", F.date_trunc("second", "ts"))
    streams.run_to_parquet(streams.sessions(whole, "4 hours", "1 hour"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("user_id long, start long, n long").parquet(f"{at}/out")


@CASES.add(f"SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM {EVENTS} GROUP BY 1")
def stream_update_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in update mode: batches carry what changed, and the last of each group counts."""
    rows, at = _replay(spark, sf_dir)
    streams.run_updates(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")), f"{at}/out", f"{at}/checkpoint")
    return streams.latest(spark.read.parquet(f"{at}/out"), ["event_type"])


@CASES.add(f"""
    WITH e AS (SELECT event_type, CASE WHEN event_id % 50 = 0 THEN 'broken' WHEN event_id % 20 = 0 THEN 'future' ELSE 'ok' END AS verdict FROM {EVENTS})
    SELECT verdict, event_type, count(*) AS n FROM e GROUP BY 1, 2""")
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a time, or with one that can't be yet, go to the dead letters; both tables are read back."""
    rows, at = _replay(spark, sf_dir)
    skewed = rows.withColumn("ts", F.when(F.col("event_id") % 50 == 0, F.lit(None)).when(F.col("event_id") % 20 == 0, F.lit("2999-01-01").cast("timestamp")).otherwise(F.col("ts")))
    streams.run_with_dead_letters(streams.guarded(skewed, "2900-01-01"), f"{at}/ok", f"{at}/dead", f"{at}/checkpoint")
    both = [spark.read.parquet(f"{at}/{name}") for name in ("ok", "dead")]
    return both[0].unionByName(both[1]).groupBy("verdict", "event_type").agg(F.count("*").alias("n"))


@CASES.add(f"""
    WITH e AS (SELECT event_id, user_id, event_type, sec, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS i FROM {EVENTS}),
    p AS (SELECT *, lag(i) OVER w AS j, lag(sec) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY i))
    SELECT event_id, user_id, event_type AS attribute FROM p WHERE j IS NULL OR sec - before > 864000 OR (SELECT count(DISTINCT q.event_type) FROM e q WHERE q.user_id = p.user_id AND q.i > p.j AND q.i < p.i) >= 3""")
def stream_new_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that aren't among a user's three most recent ones, from a map of state with timers."""
    rows, at = _replay(spark, sf_dir)
    state.run(spark, state.new_attributes(rows), lambda s: streams.run_to_parquet(s, f"{at}/out", f"{at}/checkpoint"))
    return spark.read.schema("event_id long, user_id long, attribute string").parquet(f"{at}/out")


@CASES.add(f"""
    WITH RECURSIVE s AS (SELECT event_id, user_id, event_type AS attribute, sec, lag(event_type) OVER w AS other, lag(event_type, 2) OVER w AS first, sec - lag(sec, 2) OVER w AS width FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
    a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS i FROM s WHERE attribute = first AND attribute <> other AND width <= 432000),
    r AS (SELECT *, sec AS sent FROM a WHERE i = 1 UNION ALL SELECT a.*, CASE WHEN a.sec - r.sent > 604800 THEN a.sec ELSE r.sent END FROM r JOIN a ON a.user_id = r.user_id AND a.i = r.i + 1)
    SELECT event_id, user_id, attribute, other, width FROM r WHERE sec = sent""")
def stream_back_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that go to another event type and back within five days; interim alerts are held back for a week."""
    rows, at = _replay(spark, sf_dir)
    state.run(spark, state.back_again(rows, 432_000, 604_800), lambda s: streams.run_to_parquet(s, f"{at}/out", f"{at}/checkpoint"))
    return spark.read.schema("event_id long, user_id long, attribute string, other string, width long").parquet(f"{at}/out")
