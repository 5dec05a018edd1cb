"""Bucketed time series: fixed-width rows with a retention, ranges, deltas and merges.

A series is a DataFrame with a bucket column in epoch seconds. The retention keeps a given number of
rows before the newest one, as a ring of rows would; a late value inside it still counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.cases import floor_to

#: How values of one cell combine.
COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def cells(df: DataFrame, sec: str, width: int, columns: dict[str, tuple[str, str]], keys: list[str] | None = None) -> DataFrame:
    """Aggregate into buckets; columns: name -> (value column, one of sum, min, max or last).

    NaN means no value. `last` keeps the value of the latest second, the largest of ties.
    """
    made = []
    for name, (value, how) in columns.items():
        clean = F.nullif(F.col(value).cast("double"), F.lit(float("nan")))
        made.append((F.max_by(clean, F.when(clean.isNotNull(), F.struct(F.col(sec), clean))) if how == "last" else COMBINE[how](clean)).alias(name))
    return df.groupBy(*(keys or []), floor_to(sec, width).alias("bucket")).agg(*made)


def retain(series: DataFrame, rows: int, width: int) -> DataFrame:
    """The newest `rows` buckets; older ones are dropped as too late."""
    newest = series.agg(F.max("bucket")).scalar()
    return series.withColumn("__newest", newest).filter(F.col("bucket") > F.col("__newest") - rows * width).drop("__newest")


def spine(series: DataFrame, width: int, keys: list[str] | None = None) -> DataFrame:
    """Every bucket from the first to the last (of each key), with nulls where nothing was written."""
    names = keys or []
    bounds = series.groupBy(*names).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    full = bounds.filter("lo is not null").select(*names, F.explode(F.sequence("lo", "hi", F.lit(width).cast("long"))).alias("bucket"))
    return full.join(series, [*names, "bucket"], "left")


def deltas(before: DataFrame, after: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """What each cell gained between two snapshots; cells without a change are left out."""
    joined = after.select(*keys, F.col(value).alias("new")).join(before.select(*keys, F.col(value).alias("old")), keys, "full")
    delta = F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))
    return joined.withColumn("delta", delta).filter("delta <> 0").select(*keys, "delta")


def rolling(series: DataFrame, value: str, width: int, rows: int, name: str, keys: list[str] | None = None) -> DataFrame:
    """The sum of a value over the last `rows` buckets, gaps counted as nothing.

    Without keys the window runs in one task: use it on series that are aggregated already.
    """
    over = W.partitionBy(*(keys or [])).orderBy("bucket").rangeBetween(-(rows - 1) * width, 0)
    return series.withColumn(name, F.sum(value).over(over))


def to_text(series: DataFrame, columns: list[str]) -> DataFrame:
    """One tab-separated line per bucket, `nan` where there is no value."""
    shown = [F.coalesce(F.format_string("%.6f", F.col(c)), F.lit("nan")) for c in columns]
    return series.select("bucket", F.concat_ws("\t", *shown).alias("line"))


def from_text(lines: DataFrame, columns: list[str]) -> DataFrame:
    """The inverse of to_text."""
    parts = F.split("line", "\t")
    return lines.select("bucket", *[F.nullif(F.get(parts, F.lit(k)), F.lit("nan")).try_cast("double").alias(c) for k, c in enumerate(columns)])


def off_days(rows: DataFrame, keys: list[str], day: str, value: str, days: int, deviations: float, least: float, slack: float = 0.0) -> DataFrame:
    """(keys, day, value, mean, sd): days whose sum is so many standard deviations, and more than `least`, off the mean of the days before, on either side.

    The days before are those of the last `days` that have rows, two at least; null keys are keys. Sums are made before the window, which so
    holds a row for each day. slack is what a difference must exceed the deviations by, against rounding.
    """
    daily = rows.groupBy(*keys, day).agg(F.sum(value).alias(value))
    before, x = W.partitionBy(*keys).orderBy(day).rangeBetween(-days, -1), F.col(value).cast("double")
    held = daily.withColumns({"mean": F.avg(x).over(before), "sd": F.stddev_pop(x).over(before), "__n": F.count("*").over(before)})
    off = F.abs(x - F.col("mean"))
    return held.filter((F.col("__n") >= 2) & (off - deviations * F.col("sd") >= slack) & (off > least)).drop("__n")


#: The states of a task: fixed values. The last three end it.
STATES = ("pending", "running", "completed", "failed", "exception")


def task_states(messages: DataFrame, keys: list[str], task: list[str], state: str, sec: str, started: str, width: int) -> DataFrame:
    """(keys, bucket, a count for each state, concurrency): messages of tasks' states by buckets, a message that is sent again counted once.

    concurrency is what started so far less what ended, 0 at least; an end counts only if its task had started. Of messages sent again the
    earliest stands. Counts are made before the running sum, which so holds a row for each bucket.
    """
    once = messages.groupBy(*keys, *task, state).agg(F.min(F.struct(sec, started)).alias("__m")).select(*keys, state, F.col(f"__m.{sec}").alias(sec), F.col(f"__m.{started}").alias(started))
    ends = F.col(state).isin(*STATES[2:]) & F.col(started)
    step = F.when(F.col(state) == "running", 1).when(ends, -1).otherwise(0)
    sums = once.groupBy(*keys, floor_to(sec, width).alias("bucket")).agg(*[F.count_if(F.col(state) == s).alias(s) for s in STATES], F.sum(step).alias("__step"))
    running = F.sum("__step").over(W.partitionBy(*keys).orderBy("bucket"))
    return sums.withColumn("concurrency", F.greatest(running, F.lit(0)).cast("long")).drop("__step")
