"""Clients that walk the same ordered set of paths again and again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def repeated_sets(rows: DataFrame, client: str, path: str, order: list[str], sets: dict[str, tuple[str, ...]], least: int, most_paths: int | None = None) -> DataFrame:
    """(name, client, runs, paths): how often in a row a client walks through each set, if that is `least` times or more.

    A step that isn't the next of the set breaks the row. paths is how many distinct paths a client has; clients with most_paths or more
    are left out. Where a set can be laid over itself, the longest row at any offset counts. Steps are marked by windows over a client's rows, and rows
    are runs of marks a set's length apart, so that no client's rows are gathered.
    """
    own = W.partitionBy(client).orderBy(*order)
    depth = max(map(len, sets.values()))
    placed = rows.select(client, F.row_number().over(own).alias("__n"), *[F.lag(path, k).over(own).alias(f"__{k}") for k in range(depth)])

    def walked(steps: tuple[str, ...]) -> Column:
        return reduce(Column.__and__, [F.col(f"__{k}").eqNullSafe(F.lit(step)) for k, step in enumerate(reversed(steps))])

    ends = F.array(*[F.when(walked(steps), F.struct(F.lit(name).alias("name"), F.lit(len(steps)).alias("size"))) for name, steps in sets.items()])
    hits = placed.select(client, "__n", F.explode(F.filter(ends, lambda h: h.isNotNull())).alias("__h")).select(client, "__n", "__h.*")
    offset, turn = F.pmod("__n", "size"), F.floor(F.col("__n") / F.col("size"))
    island = turn - F.row_number().over(W.partitionBy(client, "name", offset).orderBy("__n"))
    runs = hits.withColumns({"__o": offset, "__i": island}).groupBy(client, "name", "__o", "__i").agg(F.count("*").alias("runs"))
    best = runs.groupBy(client, "name").agg(F.max("runs").alias("runs")).filter(F.col("runs") >= least)
    distinct = rows.groupBy(client).agg(F.count_distinct(path).alias("paths"))
    made = best.join(distinct, client)
    return (made.filter(F.col("paths") < most_paths) if most_paths else made).select("name", client, "runs", "paths")
