"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import join_hot, release, settle


def _stars(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"), F.count(F.when(F.col("b") > F.col("a"), 1)).alias("n")), "least")
    return join_hot(both.filter("b > a"), least, ["a"], "n").select(F.col("b").alias("a"), F.col("root").alias("b"))


def _contract(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = settle(down.groupBy("a").agg(F.min("b").alias("root"), F.count("*").alias("n")), "least")
    moved = join_hot(down, least, ["a"], "n").filter("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.union(least.select("a", F.col("root").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the smallest node reachable.

    Self loops, repeated and reversed edges don't matter; edges with a null end are left out.
    Both steps aggregate before they join, and a node with very many edges is joined by a bounded
    broadcast. Every round is settled in the shared folder.
    """
    now = settle(edges.filter("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    mark = None
    while True:
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or (row["n"], row["h"]) == mark:
            break
        mark = (row["n"], row["h"])
        new = settle(_contract(settle(_stars(now), "stars")), "edges")
        release(now)
        now = new
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
