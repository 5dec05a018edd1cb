"""How a module of plans collects its queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Cases:
    """Queries by name; each may have a DuckDB twin."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.oracles[query.__name__] = sql
            return query

        return keep


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with `sec`, its time in whole seconds."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("sec", F.floor(F.unix_micros("ts") / 1_000_000).cast("long"))


def floor_to(sec: Column | str, width: int) -> Column:
    """The start of the bucket of `width` seconds since the epoch that holds a time."""
    value = F.col(sec) if isinstance(sec, str) else sec
    return (value - F.pmod(value, F.lit(width))).cast("long")


def rounded(value: Column, name: str, digits: int = 6) -> Column:
    return F.round(value, digits).alias(name)


#: DuckDB: the events with `sec`.
EVENTS = "(SELECT *, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS sec FROM events)"
