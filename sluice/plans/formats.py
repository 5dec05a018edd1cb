"""Log lines and other text formats: lines are written from the tables, then parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events
from sluice.functions import grammar
from sluice.operators import blocks
from sluice.session import scratch, table
from sluice.sources import sinks

CASES = Cases()


@CASES.add("SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(max(length(l)) AS INTEGER) AS longest FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n+')) AS l FROM documents) WHERE l <> '' GROUP BY 1")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads into lines, empty ones dropped."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\n+")).alias("l")).filter("l <> ''")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.char_length("l")).alias("longest"))


@CASES.add(f"SELECT event_id, event_type AS kind, user_id AS user, 'said \"' || event_type || '\"' AS note FROM {EVENTS}")
def logfmt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key=value lines with quoted values."""
    line = F.format_string('level=info kind=%s user=%d note="said \\"%s\\"" kind=%s', F.col("event_type"), F.col("user_id"), F.col("event_type"), F.col("event_type"))
    found = events(spark, sf_dir).select("event_id", grammar.logfmt(line).alias("m"))
    return found.select("event_id", F.col("m.kind").alias("kind"), F.col("m.user").cast("long").alias("user"), F.col("m.note").alias("note"))


@CASES.add(f"SELECT event_id, user_id AS uid, event_type AS what, round(value, 2) AS took FROM {EVENTS}")
def printf_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a printf template wrote, back into typed fields."""
    template = "user %d did %s in %.2f ms (100%%)"
    line = F.format_string(template, F.col("user_id"), F.col("event_type"), F.col("value"))
    found = events(spark, sf_dir).select("event_id", grammar.parse(line, grammar.printf(template, ["uid", "what", "took"])).alias("f"))
    return found.select("event_id", "f.uid", "f.what", F.round("f.took", 2).alias("took"))


@CASES.add(f"""
    SELECT event_id, '10.0.' || (user_id % 256) || '.7' AS remote_addr, 'GET /' || event_type || ' HTTP/1.1' AS request, CAST(200 + event_id % 300 AS INTEGER) AS status, CASE WHEN event_id % 3 > 0 THEN user_id * 10 END AS body_bytes_sent, 'Firefox' AS browser, 99 AS version FROM {EVENTS}""")
def clf_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access log lines by their format, with the browser."""
    template = '$remote_addr - $remote_user [$time_local] "$request" $status $body_bytes_sent "$http_referer" "$http_user_agent"'
    agent = "Mozilla/5.0 (X11; Linux x86_64; rv:99.0) Gecko/20100101 Firefox/99.0"
    size = F.when(F.col("event_id") % 3 > 0, (F.col("user_id") * 10).cast("string")).otherwise("-")
    line = F.concat(
        F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".7 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), F.col("event_type"), F.lit(' HTTP/1.1" '),
        (200 + F.col("event_id") % 300).cast("string"), F.lit(" "), size, F.lit(f' "-" "{agent}"'),
    )
    found = events(spark, sf_dir).select("event_id", grammar.parse(line, grammar.access_log(template)).alias("f"))
    return found.select("event_id", "f.remote_addr", "f.request", "f.status", "f.body_bytes_sent", grammar.user_agent(F.col("f.http_user_agent")).alias("ua")).select("event_id", "remote_addr", "request", "status", "body_bytes_sent", "ua.browser", "ua.version")


@CASES.add(f"SELECT event_id, CAST(user_id % 192 // 8 AS INTEGER) AS facility, CAST(user_id % 8 AS INTEGER) AS severity, 'host' || (user_id % 4) AS host, event_type AS program, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS INTEGER) END AS pid, props AS message FROM {EVENTS}")
def syslog_pri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System log lines: priority into facility and severity, an optional process id."""
    pid = F.when(F.col("event_id") % 2 == 0, F.format_string("[%d]", F.col("user_id"))).otherwise("")
    line = F.concat(F.lit("<"), (F.col("user_id") % 192).cast("string"), F.lit(">"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" host"), (F.col("user_id") % 4).cast("string"), F.lit(" "), F.col("event_type"), pid, F.lit(": "), F.col("props"))
    found = events(spark, sf_dir).select("event_id", grammar.parse(line, grammar.syslog()).alias("f"))
    return found.select("event_id", F.floor(F.col("f.pri") / 8).cast("int").alias("facility"), (F.col("f.pri") % 8).alias("severity"), "f.host", "f.program", "f.pid", "f.message")


@CASES.add("""
    SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages""")
def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each address; missing ones are empty."""
    part = lambda name: F.coalesce(F.parse_url("url", F.lit(name)), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"), part("REF").alias("fragment"))


@CASES.add("""
    SELECT page_id, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source, TRY_CAST(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS INTEGER) AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages""")
def url_query_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query parameters as a map."""
    m = table(spark, sf_dir, "pages").select("page_id", grammar.query_map(F.col("url")).alias("m"))
    get = lambda name: F.try_element_at("m", F.lit(name))
    return m.select("page_id", get("utm_source").alias("utm_source"), get("page").try_cast("int").alias("page"), get("ref").alias("ref"))


@CASES.add("""
    SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Firefox' WHEN 1 THEN 'Edge' WHEN 2 THEN 'Safari' WHEN 3 THEN 'MSIE' WHEN 4 THEN 'Opera' END AS browser,
        CAST(CASE c_custkey % 6 WHEN 0 THEN 70 + c_nationkey WHEN 1 THEN 80 + c_nationkey WHEN 2 THEN 604 WHEN 3 THEN 11 WHEN 4 THEN c_nationkey END AS INTEGER) AS version,
        CASE c_custkey % 6 WHEN 0 THEN 'Windows 10' WHEN 1 THEN 'Windows 8.1' WHEN 2 THEN 'iPhone' WHEN 3 THEN 'Windows 7' WHEN 4 THEN 'Windows Vista' END AS os FROM customer""")
def ua_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browser, version and system of user agents; null where they don't say."""
    n = F.col("c_nationkey")
    agents = F.array(
        F.format_string("Mozilla/5.0 (Windows NT 10.0; rv:%d.0) Gecko/20100101 Firefox/%d.0", 70 + n, 70 + n), F.format_string("Mozilla/5.0 (Windows NT 6.3) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/99.0 Safari/537.36 Edg/%d.1", 80 + n),
        F.format_string("Mozilla/5.0 (iPhone; CPU iPhone OS 15_0 like Mac OS X) AppleWebKit/605 (KHTML, like Gecko) Version/%d.0 Mobile/15E Safari/604.1", n), F.lit("Mozilla/5.0 (Windows NT 6.1; WOW64; Trident/7.0; TestPC; rv:11.0) like Gecko"),
        F.format_string("Opera/9.80 (Windows NT 6.0; Edition Sluice) Presto/2.7.3 Version/%d.61", n), F.lit("sluice-probe/2"),
    )
    text = F.element_at(agents, (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", grammar.user_agent(text).alias("u")).select("c_custkey", "u.*")


@CASES.add(f"SELECT event_id, sec // 1 AS sec, CAST(epoch_us(ts) AS BIGINT) AS micros FROM {EVENTS}")
def strftime_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in two formats and read back."""
    short, long = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss Z"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return events(spark, sf_dir).select("event_id", F.unix_seconds(F.try_to_timestamp(short, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))).alias("sec"), F.unix_micros(F.try_to_timestamp(long, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))).alias("micros"))


@CASES.add(f"""
    SELECT event_id, CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'login' ELSE 'unknown' END AS rule, CASE WHEN event_type IN ('error', 'signup') THEN user_id::VARCHAR END AS user FROM {EVENTS} WHERE event_type <> 'view'""")
def sub_decoder_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered grammars, the first that matches wins; one kind of line is dropped."""
    line = F.when(F.col("event_type") == "error", F.format_string("Failed password for user %d from 10.0.0.1 port 22", F.col("user_id"))).when(F.col("event_type") == "signup", F.format_string("Accepted key for user %d", F.col("user_id"))).otherwise(F.col("event_type"))
    rules = [
        ("failure", grammar.printf("Failed password for user %s from %s port %d", ["user", "ip", "port"])), ("login", grammar.printf("Accepted key for user %s", ["user"])),
        ("drop", grammar.printf("view", [])), ("unknown", grammar.printf("%s", ["text"])),
    ]
    found = events(spark, sf_dir).select("event_id", grammar.first_match(line, rules, ["user"]).alias("r")).filter("r.rule <> 'drop'")
    return found.select("event_id", "r.rule", F.try_element_at("r.fields", F.lit("user")).alias("user"))


@CASES.add(f"SELECT event_id, 'events,type=' || event_type || ' user=' || user_id || 'i ' || epoch_us(ts) || '000' AS line FROM {EVENTS}")
def line_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a time series database: tags, fields, nanoseconds."""
    rows = events(spark, sf_dir).select("event_id", F.col("event_type").alias("type"), F.col("user_id").alias("user"), "ts")
    return sinks.line_protocol(rows, "events", ["type"], ["user"], F.unix_micros("ts") * 1000, ("event_id",)).withColumnRenamed("value", "line")


@CASES.add("SELECT c_custkey AS worker_key, c_name AS worker_name_, c_nationkey AS zone FROM customer")
def hive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names made fit for a metastore."""
    raw = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").toDF("WorkerKey", "workerName?", "zone")
    return raw.toDF(*[grammar.hive_name(c) for c in raw.columns])


@CASES.add(f"SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM {EVENTS} GROUP BY 1, 2")
def parquet_partition_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written by dimension and day, read back with partition pruning at hand."""
    path = scratch(spark, "events")
    rows = events(spark, sf_dir).select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "value")
    sinks.write_partitioned(rows, path, ["event_type", "day"])
    return spark.read.option("basePath", path).parquet(path).groupBy("event_type", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@CASES.add(f"""
    WITH s AS (SELECT user_id AS task, min(sec) AS a, max(sec) AS b, min(sec) FILTER (event_type = 'view') AS c, max(sec) FILTER (event_type = 'view') AS d FROM {EVENTS} GROUP BY 1)
    SELECT task, 'task' AS name, 0 AS level, a AS start, b AS finish, true AS closed FROM s UNION ALL SELECT task, 'view', 1, c, d, true FROM s WHERE c IS NOT NULL""")
def ci_log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's span as an outer block, the span of their views as an inner one."""
    spans = events(spark, sf_dir).groupBy(F.col("user_id").alias("task")).agg(
        F.min("sec").alias("a"), F.max("sec").alias("b"), F.min(F.when(F.col("event_type") == "view", F.col("sec"))).alias("c"), F.max(F.when(F.col("event_type") == "view", F.col("sec"))).alias("d")
    )
    marks = [("start", "task", "a"), ("start", "view", "c"), ("end", "view", "d"), ("end", "task", "b")]
    line = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(m).alias("mark"), F.lit(n).alias("name"), F.col(c).alias("sec")) for k, (m, n, c) in enumerate(marks)]))
    return blocks.blocks(spans.select("task", line.alias("l")).select("task", "l.*").filter("sec is not null"))
