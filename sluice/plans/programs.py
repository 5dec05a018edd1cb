"""System programs' log lines: written from the tables by their templates, then parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events
from sluice.functions import grammar, programs
from sluice.session import table

CASES = Cases()


@CASES.add(f"""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'failed_invalid' WHEN 2 THEN 'command' WHEN 3 THEN 'command' WHEN 4 THEN 'opened' END AS rule,
        CASE WHEN event_id % 6 < 5 THEN 'u' || user_id END AS user, CASE WHEN event_id % 6 < 2 THEN '10.0.0.' || (user_id % 250) END AS ip FROM {EVENTS}""")
def program_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of lines by program and template; the last has no template."""
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    ip = F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"))
    kinds = [
        ("/usr/sbin/sshd", F.format_string("Accepted publickey for %s from %s port 22 ssh2", user, ip)), ("sshd[7]", F.format_string("Failed password for invalid user %s from %s port 22 ssh2", user, ip)),
        ("sudo", F.format_string("%s : TTY=pts/1 ; PWD=/home ; USER=root ; COMMAND=/bin/ls -l", user)), ("CRON", F.format_string("(%s) CMD (run-parts)", user)),
        ("pam", F.format_string("pam_unix(login:session): session opened for user %s by (uid=0)", user)), ("other", F.lit("no template")),
    ]
    line = F.element_at(F.array(*[F.struct(F.lit(p).alias("program"), m.alias("message")) for p, m in kinds]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = events(spark, sf_dir).select("event_id", line.alias("l")).select("event_id", programs.program_fields(F.col("l.program"), F.col("l.message")).alias("p"))
    return rows.select("event_id", "p.rule", F.try_element_at("p.fields", F.lit("user")).alias("user"), F.try_element_at("p.fields", F.lit("ip")).alias("ip"))


@CASES.add(f"""
    SELECT event_id, 'u' || user_id || '@example.com' AS "to", round(value, 2) AS delay, CASE WHEN event_type = 'error' THEN 'deferred' ELSE 'sent' END AS status FROM {EVENTS}""")
def mail_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mail transport's key and value pairs, typed."""
    status = F.when(F.col("event_type") == "error", "deferred").otherwise("sent")
    line = F.format_string("4A2: to=<u%d@example.com>, relay=mx[10.0.0.1]:25, delay=%.2f, dsn=2.0.0, status=%s (250 ok)", F.col("user_id"), F.col("value"), status)
    m = events(spark, sf_dir).select("event_id", programs.key_values(line).alias("m"))
    return m.select("event_id", F.try_element_at("m", F.lit("to")).alias("to"), F.round(F.try_element_at("m", F.lit("delay")).try_cast("double"), 2).alias("delay"), F.try_element_at("m", F.lit("status")).alias("status"))


@CASES.add(f"SELECT event_id, '10.0.0.' || (user_id % 250) AS src, CAST(event_id % 60000 AS INTEGER) AS dpt, event_id % 2 = 0 AS syn, event_id % 3 = 0 AS ack FROM {EVENTS}")
def packet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel packet lines with flags."""
    flags = F.concat(F.when(F.col("event_id") % 2 == 0, " SYN").otherwise(""), F.when(F.col("event_id") % 3 == 0, " ACK").otherwise(""))
    line = F.concat(F.lit("IN=eth0 OUT= SRC=10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(" DST=10.0.0.1 PROTO=TCP DPT="), (F.col("event_id") % 60000).cast("string"), flags, F.lit(" URGP=0"))
    p = events(spark, sf_dir).select("event_id", programs.netfilter(line).alias("p"))
    return p.select("event_id", F.try_element_at("p.fields", F.lit("SRC")).alias("src"), F.try_element_at("p.fields", F.lit("DPT")).try_cast("int").alias("dpt"), F.array_contains("p.flags", "SYN").alias("syn"), F.array_contains("p.flags", "ACK").alias("ack"))


@CASES.add(f"SELECT event_id, 'u' || user_id AS user, round(value, 3) AS query_time, event_id % 100 AS rows_sent, sec AS timestamp, 'SELECT ' || event_type AS statement FROM {EVENTS}")
def slow_query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database's slow query records of several lines."""
    record = F.format_string(
        "# User@Host: u%d[u] @ db [10.0.0.1]\n# Query_time: %.3f  Lock_time: 0.001 Rows_sent: %d  Rows_examined: 7\nuse shop;\nSET timestamp=%d;\nSELECT %s", F.col("user_id"), F.col("value"), F.col("event_id") % 100, F.col("sec"), F.col("event_type")
    )
    f = events(spark, sf_dir).select("event_id", grammar.parse(record, programs.slow_query()).alias("f"))
    return f.select("event_id", "f.user", F.round("f.query_time", 3).alias("query_time"), "f.rows_sent", "f.timestamp", "f.statement")


@CASES.add(f"SELECT user_id % 192 AS pri, count(*) AS n, CASE user_id % 8 WHEN 0 THEN 'emerg' WHEN 1 THEN 'alert' WHEN 2 THEN 'crit' WHEN 3 THEN 'err' WHEN 4 THEN 'warning' WHEN 5 THEN 'notice' WHEN 6 THEN 'info' ELSE 'debug' END AS severity FROM {EVENTS} GROUP BY 1, 3")
def severity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by priority with the severity's name."""
    return events(spark, sf_dir).groupBy((F.col("user_id") % 192).alias("pri")).agg(F.count("*").alias("n")).withColumn("severity", programs.severity_name(F.col("pri") % 8))


@CASES.add("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html, text AS back FROM documents")
def escape_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts escaped for HTML, and for JSON and back."""
    return table(spark, sf_dir, "documents").select("doc_id", programs.escape_html(F.col("text")).alias("html"), programs.unescape_json(programs.escape_json(F.col("text"))).alias("back"))


@CASES.add(f"SELECT event_id, 'logs-' || event_type || '-' || strftime(ts, '%Y%m%d') || '-%{{missing}}' AS name FROM {EVENTS}")
def interpolated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template with a field, a date and an unknown name."""
    return events(spark, sf_dir).select("event_id", programs.interpolate("logs-%{kind}-%{+yyyyMMdd}-%{missing}", {"kind": F.col("event_type")}, F.col("ts")).alias("name"))


@CASES.add(f"""
    WITH e AS (SELECT *, event_id % 8 AS m FROM {EVENTS})
    SELECT event_id, CASE m WHEN 0 THEN 'connect' WHEN 1 THEN 'reject' WHEN 2 THEN 'message_id' WHEN 3 THEN 'active' WHEN 4 THEN 'removed' WHEN 5 THEN 'delivery' WHEN 6 THEN 'pregreet' ELSE 'rate' END AS rule,
        CASE WHEN m IN (0, 1, 6) THEN '10.0.0.' || (user_id % 250) END AS ip, CASE WHEN m IN (1, 5) THEN 'u' || user_id || '@example.com' END AS "to", CASE WHEN m BETWEEN 2 AND 5 THEN 'A' || event_id END AS queue, CASE WHEN m = 5 THEN round(value, 2) END AS delay FROM e""")
def mail_daemons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mail transport's daemons log, a rule for each kind of line."""
    user, ip, queue = F.format_string("u%d@example.com", F.col("user_id")), F.format_string("10.0.0.%d", F.col("user_id") % 250), F.format_string("A%d", F.col("event_id"))
    kinds = [
        ("postfix/smtpd[7]", F.format_string("connect from mx.example.com[%s]", ip)), ("postfix/smtpd", F.format_string("NOQUEUE: reject: RCPT from mx.example.com[%s]: 554 5.7.1 Relay access denied; from=<a@b.org> to=<%s> proto=ESMTP helo=<mx>", ip, user)),
        ("postfix/cleanup", F.format_string("%s: message-id=<7@example.com>", queue)), ("postfix/qmgr", F.format_string("%s: from=<a@b.org>, size=812, nrcpt=1 (queue active)", queue)), ("postfix/qmgr", F.format_string("%s: removed", queue)),
        ("postfix/lmtp", F.format_string("%s: to=<%s>, relay=mail[private/lmtp], delay=%.2f, delays=0.1/0/0/0.1, dsn=2.0.0, status=sent (250 2.0.0 Ok)", queue, user, F.col("value"))),
        ("postfix/postscreen", F.format_string("PREGREET 11 after 0.12 from [%s]:2525: EHLO mx", ip)), ("postfix/anvil", F.lit("statistics: max connection rate 2/60s for (smtp:10.0.0.1) at May  1 10:00:00")),
    ]
    line = F.element_at(F.array(*[F.struct(F.lit(p).alias("program"), m.alias("message")) for p, m in kinds]), (F.col("event_id") % 8 + 1).cast("int"))
    known = ("smtpd", "cleanup", "qmgr", "lmtp", "postscreen", "anvil")
    rows = events(spark, sf_dir).select("event_id", line.alias("l")).select("event_id", programs.program_fields(F.col("l.program"), F.col("l.message"), known).alias("p"))
    field = lambda name: F.try_element_at("p.fields", F.lit(name))
    return rows.select("event_id", "p.rule", field("ip").alias("ip"), field("to").alias("to"), field("queue").alias("queue"), F.round(field("delay").try_cast("double"), 2).alias("delay"))
