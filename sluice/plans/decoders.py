"""Decoders and their twins: lines are written from the tables and parsed, documents are mutated, matched and fanned out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events, rounded
from sluice.functions import decoders, grammar
from sluice.session import scratch, table
from sluice.sources import sinks

CASES = Cases()


def _parsed(spark: SparkSession, sf_dir: str, line, made) -> DataFrame:
    return events(spark, sf_dir).select("event_id", grammar.parse(line, made).alias("f"))


@CASES.add(f"""
    SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS time, CAST(CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 7 ELSE 6 END AS INTEGER) AS severity, CAST(user_id AS INTEGER) AS pid,
        CASE WHEN event_id % 3 > 0 THEN event_id END AS connection, 'open() "/' || event_type || '" failed' AS message FROM {EVENTS}""")
def nginx_error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A web server's error lines: level into severity, an optional connection."""
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "debug").otherwise("info")
    connection = F.when(F.col("event_id") % 3 > 0, F.format_string("*%d ", F.col("event_id"))).otherwise("")
    line = F.concat(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit(" ["), level, F.format_string("] %d#0: ", F.col("user_id")), connection, F.lit('open() "/'), F.col("event_type"), F.lit('" failed'))
    severity = F.array_position(F.array(*[F.lit(x) for x in decoders.LEVELS]), F.col("f.level")).cast("int") - 1
    return _parsed(spark, sf_dir, line, decoders.nginx_error()).select("event_id", "f.time", severity.alias("severity"), "f.pid", "f.connection", "f.message")


@CASES.add(f"""
    SELECT event_id, 'h' || user_id || '.example.com' AS remote_addr, CAST(200 + event_id % 300 AS INTEGER) AS status, CASE WHEN event_id % 3 > 0 THEN user_id END AS body_bytes_sent, CAST(floor(value * 1000) AS BIGINT) AS request_time, 'GET /' || event_type || ' HTTP/1.1' AS request, 'a "b"' AS referer FROM {EVENTS}""")
def apache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access log lines by a format of %letters."""
    size = F.when(F.col("event_id") % 3 > 0, F.col("user_id").cast("string")).otherwise("-")
    line = F.concat(
        F.format_string("h%d.example.com - - [", F.col("user_id")), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), F.col("event_type"), F.format_string(' HTTP/1.1" %d ', 200 + F.col("event_id") % 300),
        size, F.format_string(' %d "a \\"b\\""', F.floor(F.col("value") * 1000)),
    )
    f = _parsed(spark, sf_dir, line, decoders.apache_log('%h %l %u %t "%r" %>s %b %D "%{Referer}i"'))
    return f.select("event_id", "f.remote_addr", "f.status", "f.body_bytes_sent", "f.request_time", "f.request", F.regexp_replace("f.referer", r"\\(.)", "$1").alias("referer"))


@CASES.add(f"SELECT event_id, 'host' || (user_id % 9) AS host, event_type AS program, props AS message, CAST(user_id % 192 AS INTEGER) AS pri, sec AS sec FROM {EVENTS}")
def daemon_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log daemon's own template, with times that have no year."""
    stamp = F.concat(F.date_format("ts", "MMM "), F.lpad(F.date_format("ts", "d"), 2, " "), F.date_format("ts", " HH:mm:ss"))
    line = F.concat(F.lit("<"), (F.col("user_id") % 192).cast("string"), F.lit(">"), stamp, F.lit(" host"), (F.col("user_id") % 9).cast("string"), F.lit(" "), F.col("event_type"), F.lit(": "), F.col("props"))
    made = decoders.daemon_template("<%PRI%>%TIMESTAMP% %HOSTNAME% %programname%: %msg:::drop-last-lf%")
    rows = events(spark, sf_dir).select("event_id", F.year("ts").alias("year"), grammar.parse(line, made).alias("f"))
    return rows.select("event_id", "f.host", "f.program", "f.message", "f.pri", F.unix_seconds(decoders.yearless_time(F.col("f.time"), F.col("year"))).alias("sec"))


@CASES.add(f"""
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol, CASE WHEN event_id % 3 = 0 THEN 6 ELSE 4 END AS ip_version, CASE WHEN event_type = 'error' THEN 'block' ELSE 'pass' END AS action,
        CASE WHEN event_id % 3 = 0 THEN 'fe80::' || (user_id % 99) ELSE '10.0.0.' || (user_id % 250) END AS source, CAST(event_id % 60000 AS INTEGER) AS source_port, 443 AS destination_port, CASE WHEN event_id % 2 = 0 THEN 'S' END AS tcp_flags FROM {EVENTS}""")
def packet_filter_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet filter's lines, of both versions and two protocols."""
    tcp, six = F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0
    name, number = F.when(tcp, "tcp").otherwise("udp"), F.when(tcp, "6").otherwise("17")
    head = F.concat(F.lit("5,,,1000000103,em0,match,"), F.when(F.col("event_type") == "error", "block").otherwise("pass"), F.lit(",in,"))
    v4 = F.concat(F.lit("4,0x0,,64,1,0,DF,"), number, F.lit(","), name, F.format_string(",60,10.0.0.%d,10.0.0.1,", F.col("user_id") % 250))
    v6 = F.concat(F.lit("6,0x00,0x0,1,"), name, F.lit(","), number, F.format_string(",60,fe80::%d,fe80::1,", F.col("user_id") % 99))
    tail = F.concat((F.col("event_id") % 60000).cast("string"), F.lit(",443,0"), F.when(tcp, ",S,1,0,64240,mss").otherwise(""))
    f = events(spark, sf_dir).select("event_id", decoders.packet_filter(F.concat(head, F.when(six, v6).otherwise(v4), tail)).alias("f"))
    return f.select("event_id", "f.protocol", "f.ip_version", "f.action", "f.source", "f.source_port", "f.destination_port", "f.tcp_flags")


@CASES.add(f"""
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id END AS user, user_id AS thread_id, round(value, 3) AS query_time, CASE WHEN event_id % 3 > 0 THEN 'No' END AS full_scan, sec AS timestamp, 'SELECT ' || event_type AS statement FROM {EVENTS}""")
def mariadb_slow_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow query records with thread and scan marks, half of them without the user's line."""
    user = F.when(F.col("event_id") % 2 == 0, F.format_string("# User@Host: u%d[u] @ db [10.0.0.1]\n", F.col("user_id"))).otherwise("")
    scan = F.when(F.col("event_id") % 3 > 0, "# Full_scan: No  Full_join: No\n").otherwise("")
    record = F.concat(user, F.format_string("# Thread_id: %d  Schema: shop  QC_hit: No\n# Query_time: %.3f  Lock_time: 0.001  Rows_sent: 1  Rows_examined: 7\n", F.col("user_id"), F.col("value")), scan, F.format_string("SET timestamp=%d;\nSELECT %s", F.col("sec"), F.col("event_type")))
    return _parsed(spark, sf_dir, record, decoders.mariadb_slow_query()).select("event_id", F.nullif("f.user", F.lit("")).alias("user"), "f.thread_id", F.round("f.query_time", 3).alias("query_time"), F.nullif("f.full_scan", F.lit("")).alias("full_scan"), "f.timestamp", "f.statement")


@CASES.add(f"SELECT event_id, 'u' || user_id AS user, '/' || event_type AS path, CAST(floor(value * 1000) AS BIGINT) AS rtime FROM {EVENTS}")
def tab_access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An application's access lines of eleven fields between tabs."""
    template = "[%s]\t%d\t%s\t%s\t%s\t%s\t%s\t%s\t%s\t%d\t%d"
    line = F.format_string(template, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.col("event_id"), F.lit("web1"), F.lit("10.0.0.7"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("Controller"), F.lit("run"), F.concat(F.lit("/"), F.col("event_type")), F.lit("-"), F.lit(200), F.floor(F.col("value") * 1000))
    made = grammar.printf(template, ["time", "pid", "host", "ip", "user", "controller", "function", "path", "referrer", "status", "rtime"])
    return _parsed(spark, sf_dir, line, made).select("event_id", "f.user", "f.path", "f.rtime")


@CASES.add("""
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ipv4' WHEN 1 THEN 'ipv6' WHEN 2 THEN 'hostname' END AS kind,
        CASE WHEN c_custkey % 4 = 1 THEN '2001:0db8:0000:0000:0000:0000:0000:' || lpad(printf('%x', c_nationkey), 4, '0') END AS whole FROM customer""")
def address_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of both versions and host names told apart; short IPv6 addresses written out."""
    n = F.col("c_nationkey")
    texts = F.array(F.format_string("10.1.2.%d", n), F.format_string("2001:DB8::%x", n), F.format_string("h%d.example.com", n), F.format_string("10.1.2.%d", 256 + n))
    text = F.element_at(texts, (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", decoders.address_kind(text).alias("kind"), decoders.ipv6_full(text).alias("whole"))


@CASES.add(f"""
    SELECT event_id, CASE WHEN event_type = 'signup' THEN 'console' ELSE 'bastion' END AS category, CASE WHEN event_type = 'signup' AND user_id % 10 = 7 THEN 'admin' ELSE 'u' || (user_id % 10) END AS subject,
        CASE WHEN event_type = 'signup' THEN 'account' ELSE 'host' || (event_id % 5) END AS object, '10.0.0.' || (user_id % 250) AS source FROM {EVENTS} WHERE event_type IN ('signup', 'purchase') AND event_id % 7 > 0""")
def principal_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who did what from where: the first category that a message fits names its fields; messages without an address have no principal."""
    source = F.when(F.col("event_id") % 7 > 0, F.format_string("10.0.0.%d", F.col("user_id") % 250))
    who = F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))
    console = F.struct(F.col("event_type").alias("kind"), F.struct(who.alias("name")).alias("identity"), source.alias("ip"))
    bastion = F.struct(F.col("event_type").alias("program"), who.alias("remote_user"), F.concat(F.lit("host"), (F.col("event_id") % 5).cast("string")).alias("host"), source.alias("addr"))
    document = F.when(F.col("event_type") == "signup", F.to_json(console)).otherwise(F.to_json(bastion))
    categories = [("console", "$.kind", "^signup$", "$.identity.name", "account", "$.ip", {"u7": "admin"}), ("bastion", "$.program", "^purchase$", "$.remote_user", "$.host", "$.addr", {})]
    return events(spark, sf_dir).select("event_id", decoders.principal(categories, document).alias("p")).filter("p is not null").select("event_id", "p.*")


@CASES.add("""
    WITH o AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS events FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN list_contains(events, '1-URGENT') AND list_contains(events, '2-HIGH') THEN 'both' WHEN list_contains(events, '1-URGENT') THEN 'urgent' ELSE 'other' END AS kind, array_to_string(list_filter(events, lambda e: e <> '5-LOW'), ';') AS joined FROM o""")
def event_list_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of event names classified by patterns over its members, and joined."""
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("events"))
    has = lambda pattern: F.exists("events", lambda e: e.rlike(pattern))
    kind = F.when(has("URGENT$") & has("HIGH$"), "both").when(has("URGENT$"), "urgent").otherwise("other")
    return lists.select("o_custkey", kind.alias("kind"), F.array_join(F.filter("events", lambda e: ~e.rlike("LOW$")), ";").alias("joined"))


#: Rules of a second-factor service by action and result, first to last; the last is for all other actions.
FACTOR_RULES = (
    ("bypass_create", "action = 'bypass_create'", "high"), ("admin_login_error", "action = 'admin_login_error'", "medium"), ("user_delete", "action = 'user_delete'", "medium"), ("integration_change", "action LIKE 'integration%'", "high"),
    ("fraud", "action = 'authentication' AND result = 'fraud'", "critical"), ("denied", "action = 'authentication' AND result = 'denied'", "low"), ("login", "action = 'authentication'", "info"), ("other", "true", "info"),
)


@CASES.add(f"""
    WITH e AS (SELECT event_id, k % 8 AS m FROM (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM {EVENTS}))
    SELECT event_id, CASE m WHEN 0 THEN 'bypass_create' WHEN 1 THEN 'admin_login_error' WHEN 2 THEN 'user_delete' WHEN 3 THEN 'integration_change' WHEN 4 THEN 'fraud' WHEN 5 THEN 'denied' WHEN 6 THEN 'login' ELSE 'other' END AS rule,
        CASE m WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' WHEN 4 THEN 'critical' WHEN 5 THEN 'low' ELSE 'info' END AS severity FROM e""")
def factor_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rules over action and result of a second-factor log."""
    m = F.get_json_object("props", "$.k").cast("long") % 8
    pick = lambda *names: F.element_at(F.array(*[F.lit(x) for x in names]), (m + 1).cast("int"))
    rows = events(spark, sf_dir).select("event_id", pick("bypass_create", "admin_login_error", "user_delete", "integration_update", *["authentication"] * 3, "phone_update").alias("action"), pick(*["ok"] * 4, "fraud", "denied", "ok", "ok").alias("result"))
    rule, severity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, condition, level in reversed(FACTOR_RULES):
        rule, severity = F.when(F.expr(condition), name).otherwise(rule), F.when(F.expr(condition), level).otherwise(severity)
    return rows.select("event_id", rule.alias("rule"), severity.alias("severity"))


@CASES.add("SELECT c_custkey AS id, coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, 'none') AS kind, 1 AS version FROM customer")
def json_mutate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents renamed, scrubbed and given defaults."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("kind"), "c_name", "c_acctbal")
    return decoders.mutate(rows, {"c_custkey": "id"}, ["c_name", "c_acctbal"], {"kind": "none", "version": 1})


@CASES.add(f"SELECT event_type, count(*) AS n FROM {EVENTS} WHERE event_type = 'error' AND value > 50 OR event_type LIKE 'p%' AND user_id < 100 GROUP BY 1")
def dynamic_matcher(spark: SparkSession, sf_dir: str, condition: str = "event_type = 'error' and value > 50 or event_type like 'p%' and user_id < 100") -> DataFrame:
    """Rows that a user's SQL condition selects, by type."""
    return events(spark, sf_dir).filter(F.expr(condition)).groupBy("event_type").agg(F.count("*").alias("n"))


@CASES.add(f"SELECT event_id, sec // 60 * 60 AS minute, regexp_replace(event_type, '(error|view)$', 'x-\\1') AS worker, CASE WHEN value * 3600 >= 1 AND value * 3600 < 15552000 THEN round(value, 6) ELSE 0 END AS hours FROM {EVENTS}")
def time_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times floored to the minute, worker types made alike, and session lengths in hours."""
    rows = events(spark, sf_dir)
    return rows.select("event_id", F.unix_seconds(F.date_trunc("minute", "ts")).alias("minute"), F.regexp_replace("event_type", "(error|view)$", "x-$1").alias("worker"), rounded(decoders.hours(F.col("value") * 3600), "hours"))


SCHEMA = "message event { required int64 event_id; required binary event_type (UTF8); optional group props { optional int32 k; } optional double value; }"


@CASES.add(f"SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, value FROM {EVENTS}")
def schema_text_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read with a schema that its text declares."""
    document = F.to_json(F.struct("event_id", "event_type", F.from_json("props", "k int").alias("props"), "value"))
    return events(spark, sf_dir).select(F.from_json(document, decoders.message_schema(SCHEMA)).alias("d")).select("d.event_id", "d.event_type", "d.props.k", "d.value")


@CASES.add(f"""
    SELECT experiment, branch, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, 'x' || (user_id % 3) AS experiment, 'b' || (event_id % 2) AS branch FROM {EVENTS}
    UNION ALL SELECT user_id, 'all', event_type FROM {EVENTS}) GROUP BY 1, 2""")
def experiment_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message goes to the partition of every experiment that it is in; partitions are read back."""
    found = F.create_map(F.concat(F.lit("x"), (F.col("user_id") % 3).cast("string")), F.concat(F.lit("b"), (F.col("event_id") % 2).cast("string")), F.lit("all"), F.col("event_type"))
    path = scratch(spark, "experiments")
    sinks.write_partitioned(events(spark, sf_dir).select("event_id", "user_id", F.explode(found).alias("experiment", "branch")), path, ["experiment", "branch"])
    return spark.read.parquet(path).groupBy("experiment", "branch").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@CASES.add(f"""
    WITH d AS (SELECT event_type, 'k' AS name, 'int' AS kind FROM {EVENTS} UNION ALL SELECT event_type, 'value', 'double' FROM {EVENTS} WHERE event_type <> 'view' OR event_id % 2 = 0 UNION ALL SELECT event_type, 'tag', 'text' FROM {EVENTS} WHERE event_id % 3 > 0),
    g AS (SELECT event_type, count(*) AS total FROM {EVENTS} GROUP BY 1)
    SELECT event_type, name, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n, count(*) = any_value(total) AS required FROM d JOIN g USING (event_type) GROUP BY 1, 2""")
def field_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of each type's documents as they are found, with their kinds; required if every document has them."""
    value = F.when((F.col("event_type") != "view") | (F.col("event_id") % 2 == 0), F.col("value"))
    document = F.to_json(F.struct(F.from_json("props", "k int").getField("k").alias("k"), value.alias("value"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("t"), F.col("user_id").cast("string"))).alias("tag")))
    rows = events(spark, sf_dir).select("event_type", document.alias("d"))
    fields = rows.select("event_type", F.explode(F.from_json("d", "map<string,string>")).alias("name", "text"))
    kind = F.when(F.col("text").rlike(r"^-?\d+$"), "int").when(F.col("text").try_cast("double").isNotNull(), "double").otherwise("text")
    found = fields.groupBy("event_type", "name").agg(F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds"), F.count("*").alias("n"))
    return found.join(rows.groupBy("event_type").agg(F.count("*").alias("total")), "event_type").select("event_type", "name", "kinds", "n", (F.col("n") == F.col("total")).alias("required"))


@CASES.add(f"""
    SELECT user_id, CAST(sum(json_extract(props, '$.k')::BIGINT) AS BIGINT) AS k, arg_max(event_type, (sec, event_id)) AS last_type FROM {EVENTS} GROUP BY 1""")
def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects merged by user: numbers add up, of other values the last wins."""
    pairs = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type"))
    rows = events(spark, sf_dir).select("user_id", F.struct("sec", "event_id").alias("at"), F.explode(pairs).alias("name", "text"))
    merged = rows.groupBy("user_id", "name").agg(F.sum(F.col("text").try_cast("long")).alias("total"), F.max_by("text", "at").alias("last"))
    return merged.groupBy("user_id").agg(F.max(F.when(F.col("name") == "k", F.col("total"))).alias("k"), F.max(F.when(F.col("name") == "type", F.col("last"))).alias("last_type"))


@CASES.add("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def delimited_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written for a bulk loader, by status, and read back."""
    path = scratch(spark, "export")
    sinks.write_delimited(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus"), path, "|", date="o_orderstatus")
    return spark.read.schema("o_orderkey long, o_orderpriority string, o_totalprice double, o_orderstatus string").option("sep", "|").csv(path).filter("o_orderstatus = 'F'").drop("o_orderstatus")


@CASES.add("""
    WITH q AS (SELECT o_orderstatus AS kind, unnest(generate_series(0, 100)) AS percent, unnest(quantile_cont(o_totalprice, list_transform(generate_series(0, 100), lambda x: x / 100.0))) AS value FROM orders GROUP BY 1)
    SELECT kind, CAST(percent AS INTEGER) AS percent, round(value, 4) AS value FROM q""")
def quantiles_101(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 101 percentiles of each kind's cost; values are counted before they meet."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind"), "o_totalprice").agg(F.count("*").alias("n"))
    made = counts.groupBy("kind").agg(F.percentile("o_totalprice", F.array(*[F.lit(k / 100) for k in range(101)]), F.col("n")).alias("q"))
    return made.select("kind", F.posexplode("q").alias("percent", "value")).select("kind", "percent", rounded(F.col("value"), "value", 4))


@CASES.add("""
    WITH p AS (SELECT p_partkey, p_retailprice, [{'key': 'brand', 'value': p_brand}, {'key': 'type', 'value': p_type}] AS labels FROM part)
    SELECT CASE WHEN len(list_filter(labels, lambda l: l.key = 'brand' AND l.value LIKE '%1')) > 0 THEN 'first' WHEN len(list_filter(labels, lambda l: l.key = 'type')) > 0 THEN 'typed' ELSE 'none' END AS class,
        count(*) AS n, round(sum(CAST(p_retailprice AS DECIMAL(18,2)))::DOUBLE, 4) AS cost FROM p GROUP BY 1""")
def label_exists_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by whether any label of a row fits."""
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), F.col(value).alias("value"))
    rows = table(spark, sf_dir, "part").select("p_retailprice", F.array(pair("brand", "p_brand"), pair("type", "p_type")).alias("labels"))
    kind = F.when(F.exists("labels", lambda x: (x["key"] == "brand") & x["value"].endswith("1")), "first").when(F.exists("labels", lambda x: x["key"] == "type"), "typed").otherwise("none")
    return rows.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double"), 4).alias("cost"))


@CASES.add("""
    WITH b AS (SELECT min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders), m AS (SELECT to_timestamp(epoch(a) + (epoch(z) - epoch(a)) / 2) AT TIME ZONE 'UTC' AS mid FROM b),
    o AS (SELECT CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS day, CAST(epoch_us((SELECT mid FROM m)) // 86400000000 AS BIGINT) AS cut, o_totalprice FROM orders)
    SELECT day, CASE WHEN day >= cut THEN 'new' ELSE 'old' END AS origin, count(*) AS n, round(sum(CAST(o_totalprice * CASE WHEN day >= cut THEN 2 ELSE 1 END AS DECIMAL(18,2)))::DOUBLE, 2) AS cost FROM o GROUP BY 1, 2""")
def cost_replace_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily costs in which a range of days is deleted and inserted anew at the corrected rate."""
    orders = table(spark, sf_dir, "orders").select(F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000).cast("long").alias("day"), "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    cut = orders.agg(F.floor((F.min("at") + (F.max("at") - F.min("at")) / 2) / 86_400_000_000).cast("long")).scalar()
    daily = lambda rate, origin: orders.groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum((F.col("o_totalprice") * rate).cast("decimal(18,2)")).cast("double"), 2).alias("cost")).withColumn("origin", F.lit(origin))
    held = daily(1, "old").withColumn("cut", cut).filter("day < cut")
    return held.unionByName(daily(2, "new").withColumn("cut", cut).filter("day >= cut")).select("day", "origin", "n", "cost")
