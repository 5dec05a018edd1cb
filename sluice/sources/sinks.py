"""Where results go: partitioned Parquet, delimited text, bulk JSON, line protocol and alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, dimensions: list[str], per_file: int = 1_000_000, unknown: str = "UNKNOWN", mode: str = "errorifexists") -> None:
    """Parquet by dimensions; a null dimension goes to `unknown`, characters unfit for paths become underscores.

    Rows are dealt by dimension before they are written, so a partition has few files; a large one is
    cut by Spark into several tasks.
    """
    clean = df.withColumns({d: F.regexp_replace(F.coalesce(F.col(d).cast("string"), F.lit(unknown)), r"[^A-Za-z0-9_.-]", "_") for d in dimensions})
    clean.hint("rebalance", *dimensions).write.mode(mode).partitionBy(*dimensions).option("maxRecordsPerFile", per_file).parquet(path)


def write_delimited(df: DataFrame, path: str, separator: str = "\t", null: str = "\\N", date: str | None = None) -> None:
    """TSV or PSV for a bulk loader, one folder a day where a date column is named."""
    writer = df.write.option("sep", separator).option("nullValue", null).option("quote", "").option("escape", "\\")
    (writer.partitionBy(date) if date else writer).csv(path)


def bulk_json(df: DataFrame, index: Column, columns: list[str]) -> DataFrame:
    """(value): the action line and the document of a search engine's bulk interface."""
    action = F.to_json(F.struct(F.struct(index.alias("_index")).alias("index")))
    return df.select(F.concat(action, F.lit("\n"), F.to_json(F.struct(*columns))).alias("value"))


def line_protocol(df: DataFrame, measure: str, tags: list[str], fields: list[str], nanos: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(value): lines of a time series database; null tags and fields are left out, whole numbers are marked with an i."""
    whole = {f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long")}
    escape = lambda c: F.regexp_replace(F.col(c).cast("string"), r"([ ,=])", r"\\$1")
    tag = F.concat_ws("", *[F.concat(F.lit(f",{t}="), escape(t)) for t in tags])
    field = F.concat_ws(",", *[F.concat(F.lit(f"{f}="), F.col(f).cast("string"), F.lit("i" if f in whole else "")) for f in fields])
    return df.select(*keep, F.concat(F.lit(measure), tag, F.lit(" "), field, F.lit(" "), nanos.cast("string")).alias("value"))


def send_alerts(alerts: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch of a streaming alert table to a sink of the caller's."""
    return alerts.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).start()
