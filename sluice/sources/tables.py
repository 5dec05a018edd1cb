"""Changes to partitioned Parquet tables as writes: partitions replaced by range, and rows merged by key.

A change is staged in the application's folder, then moved in by Spark's dynamic partition overwrite: only partitions that it touches are
written, and running it again gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import scratch


def _stage(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def partitions_of(spark: SparkSession, path: str, by: str) -> set[str]:
    """The values of the table's partition column, as texts; no file is opened."""
    at, fs = _filesystem(spark, path)
    if not fs.exists(at):
        return set()
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    names = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()]
    return {escape.unescapePathName(n.split("=", 1)[1]) for n in names if n.startswith(f"{by}=")}


def _drop(spark: SparkSession, path: str, by: str, values: set[str]) -> None:
    """Folders of partitions that hold nothing any more."""
    at, fs = _filesystem(spark, path)
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for status in list(fs.listStatus(at)) if fs.exists(at) else []:
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{by}=") and escape.unescapePathName(name.split("=", 1)[1]) in values:
            fs.delete(status.getPath(), True)


def _write(df: DataFrame, path: str, by: str) -> None:
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replace_range(rows: DataFrame, path: str, by: str, low: str, high: str) -> None:
    """Delete the partitions from low to high, both inclusive as texts, and insert rows, all of which must lie in that range.

    Partitions of the range for which there are no rows are empty afterwards; others, and their files, stay as they are.
    """
    spark = rows.sparkSession
    staged = _stage(rows.withColumn(by, F.col(by).cast("string")), "range")
    outside = staged.filter(F.coalesce((F.col(by) < low) | (F.col(by) > high), F.lit(True)))
    if not outside.isEmpty():
        raise ValueError(f"{by} of some rows isn't between {low} and {high}")
    new = {r[0] for r in staged.select(by).distinct().collect()}  # a value for each partition written
    _write(staged, path, by)
    _drop(spark, path, by, {v for v in partitions_of(spark, path, by) if low <= v <= high} - new)


def upsert(changes: DataFrame, path: str, keys: list[str], by: str, order: list[str], deleted: Column | None = None, schema: str | None = None) -> None:
    """Merge changes into the table: a key's last change replaces its row or adds one; where `deleted` is true the row goes.

    Partitions in which a changed key lies or will lie are written anew, from the rows of those partitions alone; a row may move to
    another partition. Null keys match null keys. A table that isn't there yet is made.
    """
    spark = changes.sparkSession
    marked = changes.withColumn("__gone", F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)).withColumn(by, F.col(by).cast("string"))
    others = [c for c in marked.columns if c not in keys]
    last = marked.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
    latest = _stage(last.select(*keys, "__row.*"), "changes")
    values = [c for c in changes.columns]
    if not partitions_of(spark, path, by):
        _write(latest.filter("not __gone").select(*values), path, by)
        return
    table = spark.read.option("basePath", path).schema(schema or latest.select(*values).schema).parquet(path)
    known = latest.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    hit = table.select(*keys, by).join(known, same, "left_semi").select(by)  # reads keys only
    touched = {r[0] for r in hit.union(latest.filter("not __gone").select(by)).distinct().collect()}
    held = table.filter(F.col(by).isin(*touched)) if touched else table.limit(0)
    made = _stage(held.join(known, same, "left_anti").select(*values).unionByName(latest.filter("not __gone").select(*values)), "merged")
    left = {r[0] for r in made.select(by).distinct().collect()}
    if left:
        _write(made, path, by)
    _drop(spark, path, by, touched - left)
