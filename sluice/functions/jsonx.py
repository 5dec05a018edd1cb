"""JSON documents: finding, flattening, validating and merging."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def find(document: Column | str, *path: str | int) -> Column:
    """The text at a path of names and 0-based places, null if there is none."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path)
    return F.get_json_object(document, f"${steps}")


def flatten(df: DataFrame, column: str, separator: str = ".", max_depth: int = 8) -> DataFrame:
    """A struct column as flat columns; what lies below max_depth stays as JSON text."""

    def leaves(kind: T.StructType, at: str, name: str, depth: int) -> list[Column]:
        out: list[Column] = []
        for field in kind.fields:
            path, label = f"{at}.`{field.name}`", f"{name}{separator}{field.name}" if name else field.name
            if isinstance(field.dataType, T.StructType) and depth < max_depth:
                out += leaves(field.dataType, path, label, depth + 1)
            elif isinstance(field.dataType, (T.StructType, T.MapType, T.ArrayType)):
                out.append(F.to_json(F.col(path)).alias(label))
            else:
                out.append(F.col(path).alias(label))
        return out

    others = [F.col(c) for c in df.columns if c != column]
    return df.select(*others, *leaves(df.schema[column].dataType, column, "", 1))


def checked(document: Column | str, schema: str, rules: dict[str, str]) -> Column:
    """A struct (value, error): the parsed document, and the first rule that it breaks, else null.

    rules: name -> SQL condition over `value`; text that isn't JSON breaks the rule `json`.
    """
    text = F.col(document) if isinstance(document, str) else document
    value = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    error = F.when(F.try_parse_json(text).isNull(), "json")
    for name, rule in rules.items():
        error = error.when(~F.coalesce(rule(value) if callable(rule) else F.expr(rule), F.lit(False)), name)
    return F.struct(value.alias("value"), error.alias("error"))


def merge_counts(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Maps of numbers merged by sum: one map per group, from rows that are summed before they meet."""
    spread = df.select(*keys, F.explode(column).alias("name", "number"))
    sums = spread.groupBy(*keys, "name").agg(F.sum("number").alias("number"))
    return sums.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "number")))).alias(column))


def packed(df: DataFrame, column: str) -> DataFrame:
    """df with the bytes of a column packed with gzip; null stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if x is None else gzip.compress(x, mtime=0) for x in batch.column(column).to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(column), column, pa.array(made, pa.binary()))

    return df.mapInArrow(run, df.schema)


def unpacked(df: DataFrame, column: str, most: int = 64 << 20) -> DataFrame:
    """df with the bytes of a column unpacked where they begin as gzip does, and unpack_error, null where that went well.

    Broken bytes, and ones that unpack to more than `most` bytes, become null with an error; others stay as they are.
    """

    def one(data: bytes | None) -> tuple[bytes | None, str | None]:
        if not (data or b"").startswith(b"\x1f\x8b"):
            return data, None
        reader = zlib.decompressobj(zlib.MAX_WBITS | 16)
        try:
            made = reader.decompress(data, most + 1)
        except zlib.error:
            return None, "broken"
        return (None, "too long") if len(made) > most else (made, None) if reader.eof else (None, "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(x) for x in batch.column(column).to_pylist()]
            whole = batch.set_column(batch.schema.get_field_index(column), column, pa.array([d[0] for d in done], pa.binary()))
            yield whole.append_column("unpack_error", pa.array([d[1] for d in done], pa.string()))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("unpack_error", T.StringType())]))
