"""Build logs: lines with a time of day, phases between marks, totals and embedded measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Marks that the build farm writes between the phases of a task: fixed values.
STARTING, FINISHED = "=== Task Starting ===", "=== Task Finished ==="
_LINE = r"^(?:\[[a-z]+ (\d{4}-\d\d-\d\d) (\d\d:\d\d:\d\d)(?:\.\d+)?Z\]|(\d\d:\d\d:\d\d))\s+(?:(DEBUG|INFO|WARNING|ERROR|CRITICAL|FATAL) - )?(.*)$"
MEASURES = "framework struct<name:string>, suites array<struct<name:string,value:double,unit:string,lowerIsBetter:boolean>>"


def parsed(line: Column) -> Column:
    """A struct (date, second of the day, level, message) of a line; level and date may be missing, other lines give null."""
    part = lambda k: F.nullif(F.regexp_extract(line, _LINE, k), F.lit(""))
    clock = F.coalesce(part(2), part(3))
    piece = lambda k: F.get(F.split(clock, ":"), F.lit(k)).try_cast("int")
    return F.when(line.rlike(_LINE), F.struct(part(1).try_cast("date").alias("date"), (piece(0) * 3600 + piece(1) * 60 + piece(2)).alias("clock"), part(4).alias("level"), F.regexp_extract(line, _LINE, 5).alias("message")))


def timed(lines: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Lines (keys, place, line) with what is parsed of them and `sec`, the seconds since the midnight before the first: a clock that goes back has passed midnight."""
    own = W.partitionBy(*keys).orderBy(place)
    rows = lines.withColumn("p", parsed(F.col("line"))).filter("p is not null").select(*keys, place, "p.*")
    back = rows.withColumn("back", F.coalesce((F.col("clock") < F.lag("clock").over(own)).cast("int"), F.lit(0)))
    return back.withColumn("sec", F.sum("back").over(own) * 86400 + F.col("clock")).drop("back")


def phases(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Timed lines with `phase`: setup before the starting mark, task up to the finishing one, teardown after it, and the lines before and after each."""
    own = W.partitionBy(*keys).orderBy(place)
    started = F.coalesce(F.max(F.col("message").contains(STARTING).cast("int")).over(own), F.lit(0))
    finished = F.coalesce(F.max(F.col("message").contains(FINISHED).cast("int")).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    named = F.when(finished == 1, "teardown").when(started == 1, "task").otherwise("setup")
    return rows.withColumns({"phase": named, "previous": F.lag("message").over(own), "following": F.lead("message").over(own)})


def totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, phase, lines, errors, seconds) of each phase."""
    errors = F.count_if(F.col("level").isin("ERROR", "CRITICAL", "FATAL"))
    return rows.groupBy(*keys, "phase").agg(F.count("*").alias("lines"), errors.alias("errors"), (F.max("sec") - F.min("sec")).alias("seconds"))


def measurements(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, framework, suite, value, unit): the suites of measurements that lines carry as JSON."""
    text = F.regexp_extract("message", r"^[A-Z]+_DATA: (\{.*\})\s*$", 1)
    found = rows.select(*keys, F.from_json(F.nullif(text, F.lit("")), MEASURES).alias("m")).filter("m.suites is not null")
    return found.select(*keys, F.col("m.framework.name").alias("framework"), F.explode("m.suites").alias("s")).select(*keys, "framework", F.col("s.name").alias("suite"), "s.value", "s.unit")
