"""Queries over bucketed time series and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events, floor_to, rounded
from sluice.operators import histogram, sax, timeseries
from sluice.session import table

CASES = Cases()


@CASES.add(f"SELECT sec // 60 * 60 AS bucket, count(*) AS n FROM {EVENTS} GROUP BY 1")
def throughput_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per minute."""
    return events(spark, sf_dir).groupBy(floor_to("sec", 60).alias("bucket")).agg(F.count("*").alias("n"))


@CASES.add(f"""
    WITH c AS (SELECT sec // 3600 * 3600 AS bucket, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most FROM {EVENTS} GROUP BY 1),
    s AS (SELECT unnest(generate_series((SELECT min(bucket) FROM c), (SELECT max(bucket) FROM c), 3600)) AS bucket)
    SELECT CAST(s.bucket AS BIGINT) AS bucket, total, least, most FROM s LEFT JOIN c USING (bucket)""")
def ts_spine_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sum, minimum and maximum, with empty rows for hours without data."""
    made = timeseries.cells(events(spark, sf_dir), "sec", 3600, {"total": ("value", "sum"), "least": ("value", "min"), "most": ("value", "max")})
    return timeseries.spine(made, 3600).select("bucket", rounded(F.col("total"), "total"), "least", "most")


@CASES.add(f"""
    WITH c AS (SELECT event_type, sec // 86400 * 86400 AS bucket, count(*) AS n FROM {EVENTS} GROUP BY 1, 2), l AS (SELECT max(bucket) AS newest FROM c)
    SELECT event_type, string_agg(n, ',' ORDER BY bucket) AS counts FROM c, l WHERE bucket BETWEEN newest - 604800 AND newest - 86400 GROUP BY 1""")
def ts_range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's daily counts of the week before the newest day, as one array."""
    daily = events(spark, sf_dir).groupBy("event_type", floor_to("sec", 86400).alias("bucket")).agg(F.count("*").alias("n"))
    newest = daily.agg(F.max("bucket")).scalar()
    week = daily.withColumn("newest", newest).filter("bucket between newest - 604800 and newest - 86400")
    return week.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("p")).select("event_type", F.array_join(F.col("p.n").cast("array<string>"), ",").alias("counts"))


@CASES.add(f"""
    WITH a AS (SELECT sec // 3600 * 3600 AS bucket, count(*) AS n FROM {EVENTS} WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT sec // 3600 * 3600 AS bucket, count(*) AS n FROM {EVENTS} GROUP BY 1)
    SELECT bucket, CAST(b.n - coalesce(a.n, 0) AS DOUBLE) AS delta FROM b LEFT JOIN a USING (bucket) WHERE b.n <> coalesce(a.n, 0)""")
def ts_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the odd events add to the hourly counts of the even ones."""
    rows = events(spark, sf_dir).withColumn("one", F.lit(1.0))
    before = timeseries.cells(rows.filter("event_id % 2 = 0"), "sec", 3600, {"n": ("one", "sum")})
    return timeseries.deltas(before, timeseries.cells(rows, "sec", 3600, {"n": ("one", "sum")}), "n", ["bucket"])


@CASES.add(f"""
    WITH c AS (SELECT sec // 60 * 60 AS bucket, count(*) AS n FROM {EVENTS} GROUP BY 1)
    SELECT bucket, CAST(n AS DOUBLE) AS n FROM c WHERE bucket > (SELECT max(bucket) FROM c) - 1440 * 60""")
def ts_advance_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of 1440 minutes: what is older than the newest minute by more is dropped."""
    made = timeseries.cells(events(spark, sf_dir).withColumn("one", F.lit(1.0)), "sec", 60, {"n": ("one", "sum")})
    return timeseries.retain(made, 1440, 60)


@CASES.add(f"""
    WITH p AS (SELECT sec // 86400 * 86400 AS bucket, event_id % 4 AS part, sum(CAST(value AS DECIMAL(18,2))) AS s, min(value) AS lo, max(value) AS hi FROM {EVENTS} GROUP BY 1, 2)
    SELECT bucket, CAST(sum(s) AS DOUBLE) AS total, min(lo) AS least, max(hi) AS most FROM p GROUP BY 1""")
def ts_merge_sum_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four partial series merged by each column's own rule."""
    rows = events(spark, sf_dir).groupBy(floor_to("sec", 86400).alias("bucket"), (F.col("event_id") % 4).alias("part"))
    parts = rows.agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return parts.groupBy("bucket").agg(F.sum("s").cast("double").alias("total"), F.min("lo").alias("least"), F.max("hi").alias("most"))


@CASES.add(f"SELECT bucket, total FROM (SELECT sec // 86400 * 86400 AS bucket, round(sum(value), 4) AS total FROM {EVENTS} GROUP BY 1)")
def cbuf_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily series written as text lines and read back."""
    made = timeseries.cells(events(spark, sf_dir), "sec", 86400, {"total": ("value", "sum")})
    return timeseries.from_text(timeseries.to_text(made, ["total"]), ["total"]).select("bucket", rounded(F.col("total"), "total", 4))


@CASES.add("""
    WITH d AS (SELECT CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS day, count(*) AS fresh FROM orders GROUP BY 1)
    SELECT day, fresh, CAST(sum(fresh) OVER (ORDER BY day) AS BIGINT) AS total FROM d""")
def daily_new_and_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows of each day and their running total; one row a day reaches the window."""
    day = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000).cast("long")
    daily = table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(F.count("*").alias("fresh"))
    return daily.select("day", "fresh", F.sum("fresh").over(W.orderBy("day")).alias("total"))


@CASES.add(f"""
    SELECT event_type, CAST(day AS BIGINT) AS day, count(*) AS n FROM (SELECT event_type, unnest(generate_series(sec // 86400, sec // 86400 + 6)) AS day FROM {EVENTS}) GROUP BY 1, 2""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the seven days that end with each day: daily partial sums first, then the slides."""
    daily = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("sec") / 86400).cast("long").alias("d")).agg(F.count("*").alias("n"))
    slid = daily.select("event_type", F.explode(F.sequence("d", F.col("d") + 6)).alias("day"), "n")
    return slid.groupBy("event_type", "day").agg(F.sum("n").alias("n"))


@CASES.add(f"""
    SELECT event_type, CAST(day AS BIGINT) AS day, count(DISTINCT user_id) AS users FROM (SELECT event_type, user_id, unnest(generate_series(sec // 86400, sec // 86400 + 6)) AS day FROM {EVENTS}) GROUP BY 1, 2""")
def sliding_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users over the seven days that end with each day; users are made distinct by day first."""
    daily = events(spark, sf_dir).select("event_type", "user_id", F.floor(F.col("sec") / 86400).cast("long").alias("d")).distinct()
    return daily.select("event_type", "user_id", F.explode(F.sequence("d", F.col("d") + 6)).alias("day")).groupBy("event_type", "day").agg(F.count_distinct("user_id").alias("users"))


@CASES.add(f"""
    WITH b AS (SELECT event_type, least(floor(value / 10), 19)::INTEGER AS slot, count(*) AS n FROM {EVENTS} GROUP BY 1, 2)
    SELECT event_type, slot, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM b""")
def histogram_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear histogram of each type's values, as shares."""
    return histogram.shares(histogram.counts(events(spark, sf_dir), ["event_type"], histogram.linear_slot(F.col("value"), 10.0, 20)), ["event_type"])


@CASES.add(f"""
    WITH b AS (SELECT event_type, least(floor(value / 10), 19)::INTEGER AS slot, count(*) AS n FROM {EVENTS} GROUP BY 1, 2),
    f AS (SELECT t.event_type, CAST(s.slot AS INTEGER) AS slot, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY t.event_type) AS share
          FROM (SELECT DISTINCT event_type FROM b) t CROSS JOIN (SELECT unnest(generate_series(0, 19)) AS slot) s LEFT JOIN b ON b.event_type = t.event_type AND b.slot = s.slot),
    p AS (SELECT a.event_type, b.event_type AS closest, corr(a.share, b.share) AS r FROM f a JOIN f b ON a.slot = b.slot AND a.event_type <> b.event_type GROUP BY 1, 2)
    SELECT event_type, closest, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(r, 9) DESC, closest) AS place FROM p) WHERE place = 1""")
def histogram_pcc_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each type the other type whose histogram correlates best."""
    counts = histogram.counts(events(spark, sf_dir), ["event_type"], histogram.linear_slot(F.col("value"), 10.0, 20))
    return histogram.closest(histogram.shares(histogram.dense(counts, "event_type", 20), ["event_type"]), "event_type").select("event_type", "closest", rounded(F.col("r"), "r"))


@CASES.add("""
    WITH e AS (SELECT CAST(floor(log2(greatest(l_extendedprice, 1))) AS INTEGER) AS slot FROM lineitem)
    SELECT least(slot, 30) AS slot, CAST(pow(2, least(slot, 30)) AS BIGINT) AS floor, count(*) AS n FROM e GROUP BY 1, 2""")
def exp_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential histogram of prices: slot k starts at 2 to the k."""
    rows = table(spark, sf_dir, "lineitem").select(histogram.exponential_slot(F.col("l_extendedprice"), 31).alias("slot"))
    return rows.groupBy("slot").agg(F.count("*").alias("n")).select("slot", F.pow(F.lit(2.0), "slot").cast("long").alias("floor"), "n")


#: DuckDB: the words of daily counts by a key.
SAX = """WITH d AS (SELECT {key} AS key, sec // 86400 AS day, count(*)::DOUBLE AS n FROM {source} GROUP BY 1, 2),
    z AS (SELECT key, day, CASE WHEN stddev_pop(n) OVER w > 0 THEN (n - avg(n) OVER w) / stddev_pop(n) OVER w ELSE 0 END AS z FROM d WINDOW w AS (PARTITION BY key)),
    p AS (SELECT *, ntile(8) OVER (PARTITION BY key ORDER BY day) AS piece FROM z), m AS (SELECT key, piece, round(avg(z), 9) AS m, count(*) AS r FROM p GROUP BY 1, 2),
    s AS (SELECT key, string_agg(CASE WHEN m >= 0.6744897501960817 THEN 'd' WHEN m >= 0 THEN 'c' WHEN m >= -0.6744897501960817 THEN 'b' ELSE 'a' END, '' ORDER BY piece) AS word, CAST(sum(r) AS BIGINT) AS rows FROM m GROUP BY 1)"""


@CASES.add(SAX.format(key="user_id", source=EVENTS) + " SELECT key AS user_id, word, rows FROM s")
def sax_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbolic word of each user's daily counts, eight symbols of four letters."""
    daily = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("sec") / 86400).alias("day")).agg(F.count("*").cast("double").alias("n"))
    return sax.words(daily, "user_id", "day", "n", pieces=8)


@CASES.add(SAX.format(key="event_type", source=f"(SELECT event_type, sec FROM {EVENTS} UNION ALL SELECT 'all', sec FROM {EVENTS})") + """,
    c AS (SELECT s.key, s.word, a.word AS other, s.rows, unnest(generate_series(1, length(s.word))) AS i FROM s, s a WHERE a.key = 'all' AND s.key <> 'all'),
    g AS (SELECT *, ascii(substr(word, i, 1)) - 96 AS x, ascii(substr(other, i, 1)) - 96 AS y FROM c),
    t AS (SELECT *, CASE WHEN abs(x - y) <= 1 THEN 0 ELSE pow([-0.6744897501960817, 0.0, 0.6744897501960817][greatest(x, y) - 1] - [-0.6744897501960817, 0.0, 0.6744897501960817][least(x, y)], 2) END AS gap FROM g)
    SELECT key AS event_type, word, other, round(sqrt(rows / length(word)::DOUBLE) * sqrt(sum(gap)), 6) AS distance FROM t GROUP BY key, word, other, rows""")
def sax_mindist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each type's word is from that of all rows, at least."""
    daily = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("sec") / 86400).alias("day")).agg(F.count("*").cast("double").alias("n"))
    whole = daily.groupBy("day").agg(F.sum("n").alias("n")).withColumn("event_type", F.lit("all"))
    own, base = sax.words(daily, "event_type", "day", "n", 8), sax.words(whole, "event_type", "day", "n", 8)
    return own.withColumn("other", base.select("word").scalar()).select("event_type", "word", "other", rounded(sax.mindist(F.col("word"), F.col("other"), F.col("rows")), "distance"))
