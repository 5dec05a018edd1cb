"""Rules of build logs over lines that are made from the events, and runs of tasks made from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events
from sluice.operators import logrules
from sluice.operators.logrules import Rule
from sluice.session import table

CASES = Cases()
RULES = [
    Rule("compile", "took", r"^compile (unit\d) took (\d+)s$", part=1, length=2), Rule("fetch", "until next line", r"^fetch begins"), Rule("checkout", "since line before", r"^checkout done"),
    Rule("lock", "until next match", r"^waiting for lock"), Rule("step", "block begins", r"^Begin (\w+)", part=1), Rule("step", "block ends", r"^End (\w+)", part=1),
]
#: DuckDB: the same lines, in columns: what kind a line is of, its part and its neighbours.
_LINES = f"""l AS (SELECT user_id, row_number() OVER w AS i, CAST(sec AS DOUBLE) AS sec, event_type, json_extract(props, '$.k')::BIGINT AS k, event_id,
        CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'noise' WHEN event_type = 'signup' AND json_extract(props, '$.k')::BIGINT < 60 THEN 'begin' WHEN event_type = 'signup' THEN 'end' ELSE event_type END AS kind FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
    m AS (SELECT *, lag(sec) OVER w AS before, lead(sec) OVER w AS after, first_value(CASE WHEN kind <> 'noise' THEN sec END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM l WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    b AS (SELECT user_id, i, sec, kind, 'step' || event_id % 2 AS part, lag(kind) OVER w AS was, lag(sec) OVER w AS begun FROM l WHERE kind IN ('begin', 'end') WINDOW w AS (PARTITION BY user_id, event_id % 2 ORDER BY i))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    step = F.format_string("step%d", F.col("event_id") % 2)
    message = (
        F.when(F.col("event_type") == "view", F.format_string("compile unit%d took %ds", F.col("event_id") % 3, k)).when(F.col("event_type") == "click", "fetch begins").when(F.col("event_type") == "purchase", "checkout done")
        .when(F.col("event_type") == "error", "waiting for lock").when(F.col("event_id") % 5 == 0, "nothing of note").when(k < 60, F.concat(F.lit("Begin "), step)).otherwise(F.concat(F.lit("End "), step))
    )
    place = F.row_number().over(W.partitionBy("user_id").orderBy("sec", "event_id"))
    return events(spark, sf_dir).select("user_id", place.alias("i"), "sec", message.alias("message"))


@CASES.add(f"""
    WITH {_LINES}, t AS (SELECT user_id, 'compile' AS component, 'unit' || event_id % 3 AS part, sec - k AS start, sec AS finish FROM m WHERE kind = 'view'
        UNION ALL SELECT user_id, 'fetch', NULL, sec, coalesce(after, sec) FROM m WHERE kind = 'click' UNION ALL SELECT user_id, 'checkout', NULL, coalesce(before, sec), sec FROM m WHERE kind = 'purchase'
        UNION ALL SELECT user_id, 'lock', NULL, sec, following FROM m WHERE kind = 'error' AND following IS NOT NULL UNION ALL SELECT user_id, 'step', part, begun, sec FROM b WHERE kind = 'end' AND was = 'begin')
    SELECT user_id, component, part, count(*) AS n, sum(finish - start) AS seconds, min(start) AS first, max(finish) AS last FROM t GROUP BY ALL""")
def build_log_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that a log's lines tell of by themselves, with the line before or after, with the next line of any rule, or as blocks."""
    spans = logrules.timings(_lines(spark, sf_dir), ["user_id"], "i", "sec", "message", RULES)
    return spans.groupBy("user_id", "component", "part").agg(F.count("*").alias("n"), F.sum(F.col("finish") - F.col("start")).alias("seconds"), F.min("start").alias("first"), F.max("finish").alias("last"))


@CASES.add(f"""
    WITH {_LINES}, o AS (SELECT user_id, part FROM b QUALIFY row_number() OVER (PARTITION BY user_id, part ORDER BY i DESC) = 1 AND kind = 'begin')
    SELECT user_id, string_agg('Grammar step, ' || part || ' unfinished', '|' ORDER BY part) AS detail FROM o WHERE user_id % 4 > 0 GROUP BY 1""")
def build_log_unclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of completed tasks whose blocks are left open; one task in four failed and has none."""
    lines = _lines(spark, sf_dir)
    tasks = lines.select("user_id").distinct().withColumn("state", F.when(F.col("user_id") % 4 > 0, "completed").otherwise("failed"))
    return logrules.unclosed(logrules.open_blocks(lines, ["user_id"], "i", "message", RULES), ["user_id"], tasks, "state")


@CASES.add("""
    WITH o AS (SELECT *, o_orderkey % 4 AS own, epoch_us(o_orderdate) // 1000000 AS t FROM orders), r AS (SELECT *, unnest(range(0, 5)) AS run FROM o),
    s AS (SELECT *, CASE WHEN run = own THEN 'completed' WHEN (o_orderkey + run) % 3 = 0 THEN 'exception' ELSE 'failed' END AS state FROM r)
    SELECT o_orderkey, CAST(run AS INTEGER) AS run, state, CAST(CASE WHEN run % 2 = 0 THEN t + 60 * run ELSE t + 60 * run + 30 END AS BIGINT) AS started, CAST(t + 60 * run + 30 AS BIGINT) AS resolved
    FROM s WHERE run = own OR (run < own AND state = 'exception' AND (o_custkey + run) % 5 > 0)""")
def task_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of tasks out of their messages: the one that a message is about, and those before it that ended in an exception."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000).cast("long").alias("t"))
    shown = lambda sec: F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    own = F.col("o_orderkey") % 4

    def run(i: Column) -> Column:
        state = F.when(i == own, "completed").when((F.col("o_orderkey") + i) % 3 == 0, "exception").otherwise("failed")
        resolved = F.when((i == own) | ((F.col("o_custkey") + i) % 5 > 0), shown(F.col("t") + 60 * i + 30))
        return F.struct(i.cast("int").alias("runId"), state.alias("state"), F.when(i % 2 == 0, shown(F.col("t") + 60 * i)).alias("started"), resolved.alias("resolved"))

    document = F.to_json(F.struct(own.cast("int").alias("runId"), F.struct(F.transform(F.sequence(F.lit(0), F.lit(4)), run).alias("runs")).alias("status")))
    found = logrules.expanded_runs(rows, document, ["o_orderkey"])
    return found.select("o_orderkey", "run", "state", F.unix_seconds("started").alias("started"), F.unix_seconds("resolved").alias("resolved"))
