"""Mergeable summaries of frequencies and quantiles: count-min counters, Misra-Gries lists and quantile sketches.

Each is a table, made with map-side combine, that merges to coarser keys by an aggregate; its size depends on the wanted
error and not on how many rows or items there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructType


def count_min_size(error: float, confidence: float) -> tuple[int, int]:
    """(depth, width): estimates exceed a count by more than error x total with a chance of 1 - confidence at most."""
    return max(1, math.ceil(math.log(1 / (1 - confidence)))), max(1, math.ceil(math.e / error))


def _slots(item: str, depth: int, width: int):
    return F.array(*[F.struct(F.lit(d).alias("line"), F.pmod(F.xxhash64(F.col(item), F.lit(d)), F.lit(width)).cast("int").alias("slot")) for d in range(depth)])


def count_min(df: DataFrame, keys: list[str], item: str, error: float = 0.001, confidence: float = 0.99) -> DataFrame:
    """(keys, line, slot, n): a counter for each line and slot that an item of the keys meets; depth x width rows a key at most."""
    depth, width = count_min_size(error, confidence)
    spread = df.select(*keys, F.explode(_slots(item, depth, width)).alias("at"))
    return spread.groupBy(*keys, F.col("at.line").alias("line"), F.col("at.slot").alias("slot")).agg(F.count("*").alias("n"))


def merged_counters(sketch: DataFrame, keys: list) -> DataFrame:
    """The counters of coarser keys; keys are columns or expressions over the finer ones."""
    return sketch.groupBy(*keys, "line", "slot").agg(F.sum("n").alias("n"))


def estimated(sketch: DataFrame, keys: list[str], items: DataFrame, item: str, error: float = 0.001, confidence: float = 0.99) -> DataFrame:
    """items (keys, item, ...) with `estimate`, at least an item's count and rarely more than error x total above it; 0 for keys without counters."""
    depth, width = count_min_size(error, confidence)
    asked = items.withColumn("__at", F.explode(_slots(item, depth, width))).select("*", F.col("__at.line").alias("line"), F.col("__at.slot").alias("slot")).drop("__at")
    met = asked.join(sketch.withColumnRenamed("n", "__n"), [*keys, "line", "slot"], "left")
    return met.groupBy(*items.columns).agg(F.min(F.coalesce("__n", F.lit(0))).alias("estimate"))


def totals(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total): all occurrences, which each line of a sketch sums to."""
    return sketch.filter("line = 0").groupBy(*keys).agg(F.sum("n").alias("total"))


#: Lists of tasks are merged in groups of so many parts, then in fewer.
LEVELS = (256, 16, 1)


def misra_gries(df: DataFrame, keys: list[str], item: str, size: int) -> DataFrame:
    """(keys, item, n, error, total): up to `size` items of each key, among them all that make up more than one in size + 1 of its rows.

    n is an item's count less `error` at most, and error is total / (size + 1) at most. Tasks keep `size` counters a key; their lists are merged
    in a tree. Keys should be few, and there is one at least; null items count as rows but are never listed.
    """
    columns = [*keys, item]
    schema = StructType([df.schema[c] for c in columns]).add("n", LongType()).add("error", LongType()).add("part", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict] = {}
        lost: dict[tuple, list[int]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(columns).aggregate([([], "count_all")])
            rows = zip(*[table.column(c).to_pylist() for c in (*columns, "count_all")], strict=True)
            for *key, value, n in rows:
                own, mark = held.setdefault(tuple(key), {}), lost.setdefault(tuple(key), [0, 0])
                mark[0] += n
                if value is not None:
                    own[value] = own.get(value, 0) + n
            for key, own in held.items():
                if len(own) > size:
                    cut = int(np.partition(np.fromiter(own.values(), np.int64, len(own)), len(own) - size - 1)[len(own) - size - 1])
                    held[key] = {v: n - cut for v, n in own.items() if n > cut}
                    lost[key][1] += cut
        part = TaskContext.get().partitionId()
        out = [(*key, v, n, 0, part) for key, own in held.items() for v, n in own.items()] + [(*key, None, n, error, part) for key, (n, error) in lost.items()]
        columns_of = list(zip(*out, strict=True)) or [()] * len(schema)
        types = [to_arrow_type(f.dataType) for f in schema.fields]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_of, types, strict=True)], schema.names)

    lists = df.select(*columns).mapInArrow(run, schema)
    for parts in LEVELS:
        lists = _merged_lists(lists.withColumn("part", F.pmod("part", F.lit(parts))), [*keys, "part"], item, size)
    whole = lists.filter(F.col(item).isNull()).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("n").alias("total"), F.col("error").alias("__error"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return lists.filter(F.col(item).isNotNull()).join(whole, same).select(*keys, item, "n", F.col("__error").alias("error"), "total")


def _merged_lists(lists: DataFrame, keys: list[str], item: str, size: int) -> DataFrame:
    """Lists of the same keys added up, and less the count of the item after the last that has room; the row without item has total and error."""
    summed = lists.groupBy(*keys, item).agg(F.sum("n").alias("n"), F.sum("error").alias("error"))
    own = W.partitionBy(*keys).orderBy(F.col(item).isNull().cast("int"), F.desc("n"))
    real = F.col(item).isNotNull()
    placed = summed.withColumn("__place", F.row_number().over(own))
    cut = F.coalesce(F.max(F.when(real & (F.col("__place") == size + 1), F.col("n"))).over(W.partitionBy(*keys)), F.lit(0))
    less = placed.withColumn("__cut", cut)
    kept = less.filter(~real | (F.col("n") > F.col("__cut")))
    return kept.select(*keys, item, F.when(real, F.col("n") - F.col("__cut")).otherwise(F.col("n")).alias("n"), F.when(real, 0).otherwise(F.col("error") + F.col("__cut")).cast("long").alias("error"))


def frequent(df: DataFrame, keys: list[str], item: str, share: float) -> DataFrame:
    """(keys, item, n, total): the items of more than `share` of a key's rows, counted exactly in a second pass over the few candidates."""
    size = math.ceil(1 / share)
    listed = misra_gries(df, keys, item, size)
    named = listed.select(*[F.col(k).alias(f"__{k}") for k in (*keys, item)], "total")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, item)]
    counts = df.select(*keys, item).join(named, same, "left_semi").groupBy(*keys, item).agg(F.count("*").alias("n"))
    found = counts.join(named, same).select(*keys, item, "n", "total")
    return found.filter(F.col("n") > F.col("total") * share)


def quantile_sketches(df: DataFrame, keys: list, value: str, size: int = 200) -> DataFrame:
    """(keys, sketch): a quantile sketch of each key's values, of a rank error of about 1.7 per cent at size 200; NaN and null are left out."""
    real = df.withColumn(value, F.nullif(F.col(value).cast("double"), F.lit(float("nan"))))
    return real.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(value, F.lit(size)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: list) -> DataFrame:
    """The sketches of coarser keys."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(sketch: str, share: float):
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(share))
