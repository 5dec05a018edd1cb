"""Document-type monitors: rolling errors and duplicates at every depth of a key, sizes, latencies, and errors that are news.

The type of an event and a band of its number make up the key; the number's last digit says whether a
document failed (0), repeats another (1) or is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events, floor_to, rounded
from sluice.operators import alerts, sax
from sluice.session import table

CASES = Cases()


def depths(*parts: Column) -> Column:
    """The key at every depth, as paths: a, a/b, a/b/c."""
    return F.array(*[F.concat_ws("/", *parts[: k + 1]) for k in range(len(parts))])


def rolling_shares(rows: DataFrame, keys: list[str], unit: int, width: int, least: int) -> DataFrame:
    """Sums of valid, failed and repeated rows over the last `width` units, with the shares of failures and repeats in percent.

    rows have bucket (the unit's start), valid, failed and repeated; keys with fewer than `least` valid and failed rows in a window are left out.
    """
    span = W.partitionBy(*keys).orderBy("bucket").rangeBetween(-unit * (width - 1), 0)
    summed = rows.select(*keys, "bucket", *[F.sum(c).over(span).alias(c) for c in ("valid", "failed", "repeated")])
    share = lambda c: F.round(F.col(c) * 100.0 / F.nullif(F.col("valid") + F.col(c), F.lit(0)), 6)
    return summed.filter((F.col("valid") >= least) | (F.col("failed") >= least)).withColumns({"percent_failed": share("failed"), "percent_repeated": share("repeated")})


@CASES.add(f"""
    WITH e AS (SELECT sec // 3600 * 3600 AS bucket, event_type AS a, 'k' || (json_extract(props, '$.k')::BIGINT // 50) AS b, json_extract(props, '$.k')::BIGINT % 10 AS m FROM {EVENTS}),
    p AS (SELECT bucket, a AS path, m FROM e UNION ALL SELECT bucket, a || '/' || b, m FROM e),
    c AS (SELECT path, bucket, count(*) FILTER (m > 1) AS valid, count(*) FILTER (m = 0) AS failed, count(*) FILTER (m = 1) AS repeated FROM p GROUP BY 1, 2),
    r AS (SELECT path, bucket, CAST(sum(valid) OVER w AS BIGINT) AS valid, CAST(sum(failed) OVER w AS BIGINT) AS failed, CAST(sum(repeated) OVER w AS BIGINT) AS repeated FROM c
          WINDOW w AS (PARTITION BY path ORDER BY bucket RANGE BETWEEN 216000 PRECEDING AND CURRENT ROW))
    SELECT *, round(failed * 100.0 / nullif(valid + failed, 0), 6) AS percent_failed, round(repeated * 100.0 / nullif(valid + repeated, 0), 6) AS percent_repeated FROM r WHERE valid >= 5 OR failed >= 5""")
def doctype_rolling_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures and repeats of the last 61 hours at both depths of the key, where there are rows enough."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = events(spark, sf_dir).select(floor_to("sec", 3600).alias("bucket"), (k % 10).alias("m"), F.explode(depths(F.col("event_type"), F.concat(F.lit("k"), F.floor(k / 50).cast("string")))).alias("path"))
    counts = rows.groupBy("path", "bucket").agg(F.count_if(F.col("m") > 1).alias("valid"), F.count_if(F.col("m") == 0).alias("failed"), F.count_if(F.col("m") == 1).alias("repeated"))
    return rolling_shares(counts, ["path"], 3600, 61, 5)


@CASES.add(f"""
    WITH d AS (SELECT event_type, sec // 86400 * 86400 AS bucket, avg(length(props) + value) AS size FROM {EVENTS} GROUP BY 1, 2)
    SELECT a.event_type, a.bucket, round(a.size, 6) AS size, round(b.size, 6) AS week_ago, round((a.size - b.size) * 100 / b.size, 6) AS change FROM d a JOIN d b ON a.event_type = b.event_type AND a.bucket = b.bucket + 604800 WHERE abs(a.size - b.size) * 100 / b.size > 5""")
def doctype_size_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose mean document size differs by more than five percent from that of a week before."""
    daily = events(spark, sf_dir).groupBy("event_type", floor_to("sec", 86400).alias("bucket")).agg(F.avg(F.char_length("props") + F.col("value")).alias("size"))
    past = daily.select("event_type", (F.col("bucket") + 7 * 86400).alias("bucket"), F.col("size").alias("week_ago"))
    change = (F.col("size") - F.col("week_ago")) * 100 / F.col("week_ago")
    return daily.join(past, ["event_type", "bucket"]).filter(F.abs(change) > 5).select("event_type", "bucket", rounded(F.col("size"), "size"), rounded(F.col("week_ago"), "week_ago"), rounded(change, "change"))


@CASES.add("""
    WITH l AS (SELECT o_orderpriority AS channel, CAST(epoch_us(o_orderdate) // 86400000000 // 7 AS BIGINT) AS week, date_diff('day', o_orderdate, l_shipdate) AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    h AS (SELECT channel, week, CAST(least(greatest(late, 0) // 30, 5) AS INTEGER) AS slot, count(*) AS n FROM l GROUP BY ALL)
    SELECT channel, week, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) FILTER (slot >= 2) AS BIGINT) AS late, round(coalesce(sum(n) FILTER (slot >= 2), 0) * 100.0 / sum(n), 6) AS percent_late FROM h GROUP BY 1, 2""")
def doctype_latency_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of rows that came sixty days or more after their order, by channel and week, from a latency histogram."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("placed"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("timestamp").alias("came")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    week = F.floor(F.floor(F.unix_micros("placed") / 86_400_000_000) / 7).cast("long")
    slot = F.least(F.floor(F.greatest(F.datediff("came", "placed"), F.lit(0)) / 30), F.lit(5)).cast("int")
    slots = rows.groupBy(F.col("o_orderpriority").alias("channel"), week.alias("week"), slot.alias("slot")).agg(F.count("*").alias("n"))
    late = F.sum(F.when(F.col("slot") >= 2, F.col("n")))
    return slots.groupBy("channel", "week").agg(F.sum("n").alias("n"), late.alias("late"), F.round(F.coalesce(late, F.lit(0)) * 100.0 / F.sum("n"), 6).alias("percent_late"))


@CASES.add(f"""
    WITH RECURSIVE c AS (SELECT event_type, sec // 86400 AS day, json_extract(props, '$.k')::BIGINT // 10 AS error, count(*) AS n FROM {EVENTS} GROUP BY 1, 2, 3),
    p AS (SELECT *, row_number() OVER (PARTITION BY event_type, day ORDER BY n DESC, error) AS place FROM c),
    t AS (SELECT event_type, day, list(error ORDER BY place) AS top, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM p WHERE place <= 3 GROUP BY 1, 2),
    s AS (SELECT event_type, day, i, top, top AS held, true AS sent FROM t WHERE i = 1
          UNION ALL SELECT t.event_type, t.day, t.i, t.top, CASE WHEN list_contains(s.held, t.top[1]) THEN s.held ELSE t.top END, NOT list_contains(s.held, t.top[1]) FROM s JOIN t ON t.event_type = s.event_type AND t.i = s.i + 1)
    SELECT event_type, day, array_to_string(top, ',') AS top FROM s WHERE sent""")
def doctype_new_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose most frequent error isn't among the three of the last day that was reported.

    Errors are counted and ranked first; the fold then goes over a type's days, of which there is one row each.
    """
    counts = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("sec") / 86400).alias("day"), F.floor(F.get_json_object("props", "$.k").cast("long") / 10).alias("error")).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("event_type", "day").orderBy(F.desc("n"), "error"))
    tops = counts.withColumn("place", place).filter("place <= 3").groupBy("event_type", "day").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "error"))), lambda x: x["error"]).alias("top"))
    days = tops.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("day", "top"))).alias("days"))
    empty = F.struct(F.array().cast("array<long>").alias("held"), F.array().cast("array<struct<day:long,top:array<long>>>").alias("sent"))

    def step(state: Column, x: Column) -> Column:
        known = F.array_contains(state["held"], x["top"][0])
        return F.when(known, state).otherwise(F.struct(x["top"].alias("held"), F.array_append(state["sent"], x).alias("sent")))

    return days.select("event_type", F.explode(F.aggregate("days", empty, step)["sent"]).alias("s")).select("event_type", "s.day", F.array_join("s.top", ",").alias("top"))


@CASES.add(f"""
    WITH h AS (SELECT event_type, sec // 86400 * 86400 AS start, sec // 3600 * 3600 AS bucket, count(*)::DOUBLE AS n FROM {EVENTS} GROUP BY ALL),
    f AS (SELECT event_type, start, unnest(range(start, start + 86400, 3600)) AS bucket FROM (SELECT DISTINCT event_type, start FROM h)),
    d AS (SELECT f.event_type, f.start, f.bucket, coalesce(n, 0) AS n FROM f LEFT JOIN h USING (event_type, start, bucket)),
    z AS (SELECT *, CASE WHEN stddev_pop(n) OVER w > 0 THEN (n - avg(n) OVER w) / stddev_pop(n) OVER w ELSE 0 END AS z FROM d WINDOW w AS (PARTITION BY event_type, start)),
    p AS (SELECT *, ntile(8) OVER (PARTITION BY event_type, start ORDER BY bucket) AS piece FROM z), m AS (SELECT event_type, start, piece, round(avg(z), 9) AS m FROM p GROUP BY 1, 2, 3),
    l AS (SELECT *, CASE WHEN m >= 0.6744897501960817 THEN 4 WHEN m >= 0 THEN 3 WHEN m >= -0.6744897501960817 THEN 2 ELSE 1 END AS x FROM m),
    g AS (SELECT a.event_type, a.start, a.piece, a.x, b.x AS y, CASE WHEN abs(a.x - b.x) <= 1 THEN 0 ELSE pow([-0.6744897501960817, 0.0, 0.6744897501960817][greatest(a.x, b.x) - 1] - [-0.6744897501960817, 0.0, 0.6744897501960817][least(a.x, b.x)], 2) END AS gap
        FROM l a JOIN l b ON a.event_type = b.event_type AND a.start = b.start + 604800 AND a.piece = b.piece)
    SELECT event_type, start, string_agg(chr(CAST(96 + x AS INTEGER)), '' ORDER BY piece) AS word, string_agg(chr(CAST(96 + y AS INTEGER)), '' ORDER BY piece) AS before, round(sqrt(3.0) * sqrt(sum(gap)), 6) AS distance FROM g GROUP BY 1, 2 HAVING sum(gap) * 3 > 4""")
def doctype_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose hours have another shape than a week before, by symbolic words of eight letters."""
    hourly = events(spark, sf_dir).groupBy("event_type", floor_to("sec", 3600).alias("bucket")).agg(F.count("*").alias("n"))
    return sax.shape_changes(hourly, ["event_type"], "n", 3600, 86_400, 604_800, 8, 2.0)


@CASES.add(f"""
    WITH h AS (SELECT user_id AS channel, max(sec // 3600 * 3600) AS last FROM {EVENTS} WHERE json_extract(props, '$.k')::BIGINT % 10 <> 0 GROUP BY 1), e AS (SELECT max(sec // 3600 * 3600) AS last FROM {EVENTS})
    SELECT channel, h.last, CAST((e.last - h.last) // 3600 AS BIGINT) AS silence FROM h, e WHERE (e.last - h.last) // 3600 > 12""")
def channel_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels without a valid document for more than twelve hours before the last one of all."""
    hourly = events(spark, sf_dir).groupBy(F.col("user_id").alias("channel"), floor_to("sec", 3600).alias("bucket")).agg(F.count_if(F.get_json_object("props", "$.k").cast("long") % 10 != 0).alias("valid"))
    return alerts.silent(hourly, ["channel"], 3600, 12, hourly.agg(F.max("bucket")).first()[0] or 0)
