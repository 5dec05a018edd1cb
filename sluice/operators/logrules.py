"""Rules over the lines of build logs: timings from a line and its neighbours, blocks left open, and a task's several runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("took", "since line before", "until next line", "until next match", "block begins", "block ends")


@dataclass(frozen=True)
class Rule:
    """What a line that matches says: about a component, and a part of it that the pattern's group `part` names.

    `took`: the line ends a span whose length is the group `length`, in units of so many seconds. `since line before` and `until next line` take the
    other end from the neighbour, `until next match` from the next line that any rule matches. Two rules of kinds `block begins` and `block ends`
    with one component make a block.
    """

    component: str
    kind: str
    pattern: str
    part: int = 0
    length: int = 0
    unit: float = 1.0

    def __post_init__(self) -> None:
        if self.kind not in KINDS or (self.kind == "took") != bool(self.length):
            raise ValueError(f"{self.component}: {self.kind}")


def matched(rows: DataFrame, message: str, rules: list[Rule]) -> DataFrame:
    """rows with the first rule that a line matches: rule (its number), component, kind, part and length; null where there is none."""
    text, out = F.col(message), F.lit(None).cast("struct<rule:int,component:string,kind:string,part:string,length:double>")
    for k, rule in reversed(list(enumerate(rules))):
        part = F.nullif(F.regexp_extract(text, rule.pattern, rule.part), F.lit("")) if rule.part else F.lit(None)
        length = F.regexp_extract(text, rule.pattern, rule.length).try_cast("double") * rule.unit if rule.length else F.lit(None)
        found = F.struct(F.lit(k).alias("rule"), F.lit(rule.component).alias("component"), F.lit(rule.kind).alias("kind"), part.cast("string").alias("part"), length.cast("double").alias("length"))
        out = F.when(text.rlike(rule.pattern), found).otherwise(out)
    return rows.withColumn("__m", out).select(*rows.columns, "__m.*")


def timings(rows: DataFrame, keys: list[str], place: str, sec: str, message: str, rules: list[Rule]) -> DataFrame:
    """(keys, place, component, part, start, finish): the spans that lines of a log tell of, in the order of `place`.

    Of a log's last line the next one is itself; a line that waits for the next match and has none gives no span. A block ends at the first end of its
    component and part after its last begin; an end without a begin, and a begin without an end, give none.
    """
    own, back = W.partitionBy(*keys).orderBy(place), W.partitionBy(*keys).orderBy(F.desc(place))
    told = matched(rows.select(*keys, place, sec, message), message, rules)
    at = F.col(sec).cast("double")
    # The next match is the last one seen from the end, so that no frame is gone through anew for each line.
    next_match = F.last(F.when(F.col("rule").isNotNull(), at), ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1))
    near = told.withColumns({"__before": F.lag(at, 1).over(own), "__next": F.lead(at, 1).over(own), "__match": next_match}).filter("rule is not null")
    block = W.partitionBy(*keys, "component", "part").orderBy(place)
    mark = F.col("kind").isin("block begins", "block ends")
    marked = near.withColumn("__begun", F.lag(F.when(F.col("kind") == "block begins", at), 1).over(block)).withColumn("__was", F.lag("kind", 1).over(block))
    start = (
        F.when(F.col("kind") == "took", at - F.col("length")).when(F.col("kind") == "since line before", F.coalesce("__before", at))
        .when((F.col("kind") == "block ends") & (F.col("__was") == "block begins"), F.col("__begun")).when(~mark, at)
    )
    finish = F.when(F.col("kind") == "until next line", F.coalesce("__next", at)).when(F.col("kind") == "until next match", F.col("__match")).when(F.col("kind") != "block begins", at)
    made = marked.select(*keys, place, "component", "part", start.alias("start"), finish.alias("finish"))
    return made.filter("start is not null and finish is not null")


def open_blocks(rows: DataFrame, keys: list[str], place: str, message: str, rules: list[Rule]) -> DataFrame:
    """(keys, component, part, place): blocks whose last mark is a begin; an aggregate with map-side combine."""
    marks = matched(rows.select(*keys, place, message), message, [r for r in rules if r.kind.startswith("block")]).filter("rule is not null")
    last = marks.groupBy(*keys, "component", "part").agg(F.max(F.struct(place, "kind")).alias("__last"))
    return last.filter("__last.kind = 'block begins'").select(*keys, "component", "part", F.col(f"__last.{place}").alias(place))


def unclosed(blocks: DataFrame, keys: list[str], tasks: DataFrame, state: str) -> DataFrame:
    """(keys, detail): an error for each completed task with blocks left open, which are named in order; tasks in another state may leave theirs."""
    named = F.concat(F.lit("Grammar "), "component", F.lit(", "), F.coalesce("part", F.lit("nil")), F.lit(" unfinished"))
    found = blocks.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(named)), "|").alias("detail"))
    return found.join(tasks.filter(F.col(state) == "completed").select(*keys).distinct(), keys, "left_semi")


RUNS = "runId int, status struct<runs:array<struct<runId:int,state:string,reasonResolved:string,scheduled:timestamp,started:timestamp,resolved:timestamp,workerGroup:string>>>"


def expanded_runs(df: DataFrame, document: Column, keys: list[str]) -> DataFrame:
    """(keys, run, state, reason, scheduled, started, resolved, worker_group): the run that a task's message is about, and runs before it that
    ended in an exception, which have no message of their own. A run that never started began when it was resolved."""
    parsed = df.select(*keys, F.from_json(document, RUNS).alias("d")).select(*keys, F.col("d.runId").alias("__own"), F.explode("d.status.runs").alias("r"))
    earlier = (F.col("r.runId") < F.col("__own")) & (F.col("r.state") == "exception") & F.col("r.resolved").isNotNull()
    return parsed.filter((F.col("r.runId") == F.col("__own")) | earlier).select(
        *keys, F.col("r.runId").alias("run"), "r.state", F.col("r.reasonResolved").alias("reason"), "r.scheduled", F.coalesce("r.started", "r.resolved").alias("started"), "r.resolved", F.col("r.workerGroup").alias("worker_group")
    )
