"""Records, counters and times as files hold them, and accessors over messages; what is read is written from the tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events, rounded
from sluice.functions import decoders
from sluice.operators import buildlog
from sluice.session import scratch, table
from sluice.sources import readers

CASES = Cases()


def _folder(spark: SparkSession, name: str) -> str:
    return scratch(spark, name)


@CASES.add(f"SELECT user_id, event_id * 3 AS first, 'BEGIN ' || event_type || chr(10) || '  k=' || json_extract(props, '$.k') || chr(10) || 'END' AS record FROM {EVENTS}")
def multi_line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three lines, ended by a line of their own."""
    texts = F.array(F.concat(F.lit("BEGIN "), F.col("event_type")), F.concat(F.lit("  k="), F.get_json_object("props", "$.k")), F.lit("END"))
    lines = events(spark, sf_dir).select("user_id", "event_id", F.posexplode(texts).alias("i", "value")).select("user_id", (F.col("event_id") * 3 + F.col("i")).alias("place"), "value")
    return readers.multi_line(lines, None, ["user_id"], "place", end="^END$")


@CASES.add(f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM {EVENTS} GROUP BY 1")
def packed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of packed text files."""
    path = _folder(spark, "lines")
    events(spark, sf_dir).select(F.concat_ws("\t", "event_type", F.col("value").cast("string"))).write.option("compression", "gzip").text(path)
    part = F.split("value", "\t")
    return readers.text_records(spark, path).select(part[0].alias("event_type"), part[1].cast("double").alias("v")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@CASES.add(f"""
    WITH c AS (SELECT user_id, event_id, sec, CAST(sum(json_extract(props, '$.k')::BIGINT) OVER (PARTITION BY user_id, sec // 432000 ORDER BY sec, event_id) AS BIGINT) AS total FROM {EVENTS}),
    d AS (SELECT user_id, CASE WHEN total >= lag(total) OVER w THEN total - lag(total) OVER w ELSE total END AS gained FROM c WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id))
    SELECT user_id, CAST(sum(gained) AS BIGINT) AS gained, count(*) AS n FROM d GROUP BY 1""")
def counter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that start anew every five days, from tab-separated files; what they gained in all."""
    path = _folder(spark, "counters")
    running = F.sum(F.get_json_object("props", "$.k").cast("long")).over(W.partitionBy("user_id", F.floor(F.col("sec") / 432000)).orderBy("sec", "event_id"))
    events(spark, sf_dir).select("user_id", F.format_string("%020d-%020d", "sec", "event_id").alias("at"), running.alias("total")).write.option("sep", "\t").csv(path)
    gained = readers.counter_deltas(readers.counters(spark, path, "user_id long, at string, total long"), ["user_id"], "at", ["total"])
    return gained.groupBy("user_id").agg(F.sum("total").alias("gained"), F.count("*").alias("n"))


@CASES.add(f"SELECT event_id, CAST(event_id % 8 AS INTEGER) AS kind, sec FROM {EVENTS}")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of eight formats read by one function."""
    shown = lambda pattern: F.date_format("ts", pattern)
    texts = F.array(
        shown("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), shown("dd/MMM/yyyy:HH:mm:ss Z"), F.concat(shown("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")), F.concat(shown("EEE MMM "), F.lpad(shown("d"), 2, " "), shown(" HH:mm:ss yyyy")),
        F.concat(shown("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC")), shown("yyyy-MM-dd HH:mm:ss"), F.concat(shown("yyMMdd "), F.lpad(shown("H:mm:ss"), 8, " ")), shown("yyyy/MM/dd HH:mm:ss"),
    )
    kind = (F.col("event_id") % 8).cast("int")
    return events(spark, sf_dir).select("event_id", kind.alias("kind"), F.unix_seconds(decoders.any_time(F.element_at(texts, kind + 1))).alias("sec"))


@CASES.add(f"SELECT event_id, event_type || chr(10) || 'é\"' || user_id AS text, event_type || ' & é' AS percent FROM {EVENTS}")
def escape_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C escapes by name, in hexadecimal and octal, and percent codes."""
    written = F.concat(F.lit(r"\x"), F.hex(F.substring("event_type", 1, 1)), F.substring("event_type", 2, 99), F.lit(r"\n\303\251\""), F.col("user_id").cast("string"))
    percent = F.url_encode(F.concat(F.col("event_type"), F.lit(" & é")))
    return events(spark, sf_dir).select("event_id", decoders.unescape_c(written).alias("text"), F.try_url_decode(percent).alias("percent"))


@CASES.add("""
    WITH c AS (SELECT c_custkey, c_nationkey AS n, lower(c_mktsegment) AS kind, c_custkey % 4 AS form FROM customer)
    SELECT c_custkey, CASE form WHEN 0 THEN 'u' || n WHEN 1 THEN 'v' || n WHEN 2 THEN 'w' || n END AS user, kind AS type, CASE WHEN form = 3 THEN 'none' ELSE 'host-' || n END AS hostname, 'login ' || CASE form WHEN 0 THEN 'u' || n WHEN 1 THEN 'v' || n WHEN 2 THEN 'w' || n ELSE '' END || ' (' || kind || ')' AS payload, 7 AS pid FROM c""")
def message_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers set by rules: values, other fields, the first field that is there, templates; and the user's name out of an address or a role."""
    n, form = F.col("c_nationkey").cast("string"), F.col("c_custkey") % 4
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lower("c_mktsegment").alias("kind"), F.when(form == 0, F.concat(F.lit("u"), n, F.lit("@example.com"))).when(form == 1, F.concat(F.lit("ou=people,mail=v"), n, F.lit("@example.org,o=x"))).alias("mail"),
        F.when(form == 2, F.concat(F.lit("arn:aws:sts::1:assumed-role/ops/w"), n)).alias("role"), F.when(form < 2, F.concat(F.lit("host-"), n)).alias("server"), F.when(form < 3, F.concat(F.lit("host-"), n)).alias("host"),
    )
    named = rows.withColumn("user", decoders.user_name("mail", "role"))
    return decoders.set_headers(named, {"type": ("field", "kind"), "hostname": ("first", ["server", "host"], "none"), "payload": ("template", "login %{user} (%{kind})"), "pid": ("value", 7)}).select("c_custkey", "user", "type", "hostname", "payload", "pid")


@CASES.add(f"""
    WITH e AS (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM {EVENTS})
    SELECT event_id, 'b' || k AS build_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS channel, 'Linux' AS os, user_id % 2 = 0 AS is_default, user_id AS profile_day, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS addons,
        round(CASE WHEN k * 200000 >= 1 AND k * 200000 < 15552000 THEN k * 200000 / 3600.0 ELSE 0 END, 6) AS hours FROM e""")
def ping_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessors over a client's nested document; missing parts are null."""
    k = F.get_json_object("props", "$.k").cast("long")
    addons = F.when(F.col("event_id") % 2 == 0, F.struct(F.struct(F.struct(F.lit(1).alias("v")).alias("a"), F.struct(F.lit(2).alias("v")).alias("b")).alias("activeAddons")))
    environment = F.struct(
        F.struct(F.concat(F.lit("b"), k.cast("string")).alias("buildId")).alias("build"), F.struct(F.struct(F.lit("Linux").alias("name")).alias("os")).alias("system"), F.struct(F.col("user_id").alias("creationDate")).alias("profile"), addons.alias("addons"),
        F.struct(F.struct(F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("channel")).alias("update"), (F.col("user_id") % 2 == 0).alias("isDefaultBrowser")).alias("settings"),
    )
    document = F.to_json(F.struct(environment.alias("environment"), F.struct(F.struct((k * 200_000).alias("subsessionLength")).alias("info")).alias("payload")))
    found = events(spark, sf_dir).select("event_id", document.alias("d")).select("event_id", decoders.ping("d").alias("p"))
    return found.select("event_id", "p.build_id", "p.channel", "p.os", "p.is_default", "p.profile_day", "p.addons", rounded(F.col("p.hours"), "hours"))


@CASES.add("""
    WITH c AS (SELECT c_mktsegment AS worker, o_orderpriority AS kind, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY n DESC, kind) AS place FROM c)
    SELECT worker, place, kind, n, round((n - done) / nullif(done, 0)::DOUBLE, 6) AS open_per_done FROM r WHERE place <= 3""")
def worker_top_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent kinds of each worker type, with a ratio that is null where it can't be."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = rows.groupBy(F.col("c_mktsegment").alias("worker"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    place = F.row_number().over(W.partitionBy("worker").orderBy(F.desc("n"), "kind")).cast("long")
    ratio = F.try_divide((F.col("n") - F.col("done")).cast("double"), F.col("done").cast("double"))
    return counts.withColumn("place", place).filter("place <= 3").select("worker", "place", "kind", "n", rounded(ratio, "open_per_done"))


@CASES.add("""
    WITH o AS (SELECT o_orderpriority AS kind, o_totalprice, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) < '8' AS half FROM orders)
    SELECT kind, count(*) FILTER (half) AS first, count(*) FILTER (NOT half) AS second, round(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (half), 0)::DOUBLE, 2) AS first_cost, round(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (NOT half), 0)::DOUBLE, 2) AS second_cost FROM o GROUP BY 1""")
def hash_split_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks dealt to two halves by a hash of their id, with what each half costs."""
    half = F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 1) < "8"
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").cast("decimal(18,2)").alias("cost"), half.alias("half"))
    cost = lambda c, name: F.round(F.coalesce(F.sum(F.when(c, F.col("cost"))), F.lit(0)).cast("double"), 2).alias(name)
    return rows.groupBy("kind").agg(F.count_if("half").alias("first"), F.count_if(~F.col("half")).alias("second"), cost(F.col("half"), "first_cost"), cost(~F.col("half"), "second_cost"))


#: DuckDB: each user's events as a build's log: place, clock, level, and which line it is.
BUILD = f"""b AS (SELECT user_id, sec % 86400 AS clock, event_type, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
    c AS (SELECT *, CASE WHEN clock < lag(clock) OVER w THEN 1 ELSE 0 END AS back FROM b WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    t AS (SELECT *, CAST(sum(back) OVER (PARTITION BY user_id ORDER BY i) AS BIGINT) * 86400 + clock AS moment FROM c)"""


def _build_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = W.partitionBy("user_id").orderBy("sec", "event_id")
    rows = events(spark, sf_dir).withColumn("i", F.row_number().over(own)).withColumn("n", F.count("*").over(W.partitionBy("user_id")))
    message = (
        F.when(F.col("i") == 2, buildlog.STARTING).when(F.col("i") == F.col("n") - 1, buildlog.FINISHED)
        .when(F.col("event_type") == "view", F.concat(F.lit('MEASURE_DATA: {"framework":{"name":"bench"},"suites":[{"name":"s1","value":'), F.col("value").cast("string"), F.lit(',"unit":"ms"},{"name":"s2","value":1.5}]}'))).otherwise("step")
    )
    head = F.when(F.col("i") == 1, F.date_format("ts", "'[worker 'yyyy-MM-dd HH:mm:ss.SSS'Z] '")).otherwise(F.concat(F.date_format("ts", "HH:mm:ss"), F.lit("     "), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.lit(" - ")))
    return rows.select("user_id", "i", F.concat(head, message).alias("line"))


@CASES.add(f"""
    WITH {BUILD}, p AS (SELECT *, CASE WHEN i < 2 THEN 'setup' WHEN n = 3 THEN 'task' WHEN i > n - 1 THEN 'teardown' ELSE 'task' END AS phase FROM t)
    SELECT user_id, phase, count(*) AS lines, count(*) FILTER (i > 1 AND event_type = 'error') AS errors, max(moment) - min(moment) AS seconds FROM p GROUP BY 1, 2""")
def build_log_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, errors and seconds of each phase of a task, from its log; clocks pass midnight."""
    rows = buildlog.timed(_build_lines(spark, sf_dir), ["user_id"], "i")
    return buildlog.totals(buildlog.phases(rows, ["user_id"], "i"), ["user_id"]).withColumn("seconds", F.col("seconds").cast("long"))


@CASES.add(f"""
    WITH {BUILD}, v AS (SELECT user_id, value FROM t WHERE event_type = 'view' AND i <> 2 AND i <> n - 1)
    SELECT user_id, suite, count(*) AS n, round(sum(CASE suite WHEN 's1' THEN value ELSE 1.5 END), 4) AS total FROM v, (SELECT unnest(['s1', 's2']) AS suite) GROUP BY 1, 2""")
def build_log_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suites of measurements that a task's log carries."""
    rows = buildlog.timed(_build_lines(spark, sf_dir), ["user_id"], "i")
    return buildlog.measurements(rows, ["user_id"]).groupBy("user_id", "suite").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
