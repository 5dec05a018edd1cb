"""Deep merge of nested documents, as rows of paths: documents are dealt by key, added up by path in tasks, and put together again.

What a path holds is decided by the first document that has it: later values of another kind are left out, with all that lies below
them. Numbers add up; of texts and truth values the last counts; objects and lists merge member by member; null stays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from sluice.session import scratch

#: A kind of value by one letter: object, list, number, text, truth value, null.
_KINDS = {dict: "o", list: "l", int: "n", float: "n", str: "t", bool: "b", type(None): "z"}
PATHS = "level int, path string, above string, kinds string, whole decimal(38,0), broken double, text string"
_TYPES = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.decimal128(38, 0), pa.float64(), pa.string()]
_WHOLE = 10**30


def _add(seen: dict, document: object, row: int) -> None:
    """Add a document to a tree of what was seen: (step, kind) to [first row, whole numbers, other numbers, text, its row, values below]."""
    left = [(seen, None, document)]
    while left:
        beside, step, value = left.pop()
        kind = _KINDS[type(value)]
        held = beside.get((step, kind))
        if held is None:
            held = beside[step, kind] = [row, None, None, None, row, {} if kind in "ol" else None]
        if kind == "o":
            below = held[5]
            for name, inner in value.items():
                left.append((below, name, inner))
        elif kind == "l":
            below = held[5]
            for place, inner in enumerate(value):
                left.append((below, place, inner))
        elif kind == "n":
            if isinstance(value, int) and abs(value) < _WHOLE:
                held[1] = value + (held[1] or 0)
            else:
                held[2] = float(value) + (held[2] or 0.0)
        elif kind != "z":
            held[3], held[4] = value if kind == "t" else json.dumps(value), row


def _rows(seen: dict, deepest: int) -> Iterator[tuple]:
    """(first row, row of the text, *PATHS) of all values of a tree; of what lies below `deepest` only the level is told."""
    left = [(seen, 0, None, "")]
    while left:
        values, level, above, kinds = left.pop()
        for (step, kind), (first, whole, broken, text, last, below) in values.items():
            path = "[]" if level == 0 else "" if level > deepest else f"{above[:-1]}{', ' if level > 1 else ''}{json.dumps(step)}]"
            own = kinds + kind if level <= deepest else ""
            yield first, last, level, path, above, own, whole, broken, text
            if below:
                left.append((below, level + 1, path, own))


def paths(df: DataFrame, keys: list[str], document: str, order: list[str], deepest: int = 64) -> DataFrame:
    """(keys, first, last, PATHS): the values in each key's documents, added up by path and kinds as far as they meet in a task.

    `first` is the place in the given order of the first document with such a value, `last` that of the last one, whose text counts. Text
    that isn't JSON gives no rows. Documents are dealt by key; a key with very many of them may be dealt to several tasks.
    """
    dealt = df.select(*keys, F.struct(*order).alias("at"), document).hint("rebalance", *keys).sortWithinPartitions(*keys, "at")
    fields = StructType([dealt.schema[k] for k in keys])
    schema = StructType(fields.fields).add("first", dealt.schema["at"].dataType).add("last", dealt.schema["at"].dataType)
    schema = StructType(schema.fields + StructType.fromDDL(PATHS).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) or [()] * batch.num_rows
            rows, seen = [], {}
            for k, text in enumerate(batch.column(document).to_pylist()):
                if k and own[k] != own[k - 1]:
                    rows += _rows(seen, deepest)
                    seen = {}
                try:
                    made = json.loads(text or "")
                except (ValueError, RecursionError):
                    continue
                _add(seen, made, k)
            rows += _rows(seen, deepest)
            first, last, *columns = list(zip(*rows, strict=True)) or [()] * (2 + len(_TYPES))
            first, last, at = pa.array(first, pa.int64()), pa.array(last, pa.int64()), batch.column("at")
            sums = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(first) for k in keys), at.take(first), at.take(last), *sums], schema.names)

    return dealt.mapInArrow(run, schema)


def merged(df: DataFrame, keys: list[str], document: str, order: list[str], deepest: int = 64) -> DataFrame:
    """(keys, document): each key's documents merged in the given order. Keys without any JSON are left out.

    Documents are read once: values are added up by key, path and kinds before they are written to the application's folder, so that a key
    with very many documents costs its distinct paths. Documents nested deeper than `deepest` raise an error.
    """
    made = paths(df, keys, document, order, deepest)
    at = scratch(df.sparkSession, "paths")
    made.write.parquet(at)
    parts = df.sparkSession.read.schema(made.schema).parquet(at)
    levels = parts.agg(F.max("level")).first()[0]
    if levels is not None and levels > deepest:
        raise ValueError(f"documents are nested {levels} deep")
    sums = parts.repartition(*keys or [F.lit(0)]).groupBy(*keys, "level", "path", "above", "kinds").agg(
        F.min("first").alias("first"), F.sum("whole").alias("whole"), F.sum("broken").alias("broken"), F.max_by("text", F.when(F.col("text").isNotNull(), F.col("last"))).alias("text")
    )
    value = F.coalesce(F.when(F.col("broken").isNull(), F.col("whole").cast("string")), (F.coalesce(F.col("whole").cast("double"), F.lit(0.0)) + F.col("broken")).cast("string"), F.col("text"))
    ordered = sums.sortWithinPartitions(*keys, "level", "path", "first", "kinds").select(*keys, "path", "above", "kinds", value.alias("value"))
    return _together(ordered, keys, document)


def _value(kind: str, text: str | None) -> object:
    if kind in "olz":
        return {"o": {}, "l": [], "z": None}[kind]
    return text if kind == "t" else json.loads(text) if kind == "b" or text.lstrip("-").isdigit() else float(text)


def _put(made: dict, path: str, above: str | None, kinds: str, text: str | None) -> None:
    """Add a value to a document's paths (path: kinds, value), which come from the top down and, of each path, the first document's first."""
    if path in made or (above is not None and made.get(above, ("",))[0] != kinds[:-1]):
        return  # another kind came first, here or above
    value = _value(kinds[-1], text)
    made[path] = kinds, value
    if above is None:
        return
    step, into = json.loads(path)[-1], made[above][1]
    if isinstance(into, list):
        into.extend([None] * (step + 1 - len(into)))
    into[step] = value


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def _together(ordered: DataFrame, keys: list[str], document: str) -> DataFrame:
    """The JSON text of each key's document, from rows that lie together by key and are ordered from the top down."""
    schema = StructType([ordered.schema[k] for k in keys]).add(document, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, made, types = None, {}, []
        written = lambda: json.dumps(made["[]"][1], sort_keys=True, ensure_ascii=False)
        for batch in batches:
            done = []
            types = [batch.column(k).type for k in keys]
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) or [()] * batch.num_rows
            for k, row in zip(own, zip(*(batch.column(c).to_pylist() for c in ("path", "above", "kinds", "value")), strict=True), strict=True):
                if key is None or not _same(k, key):
                    if made:
                        done.append((*key, written()))
                    key, made = k, {}
                _put(made, *row)
            yield _batch(done, types, schema.names)
        if made:
            yield _batch([(*key, written())], types, schema.names)

    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.string()], strict=True)], names)
