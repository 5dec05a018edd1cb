"""Which objects of a partitioned store to read: dimension rules become partition filters, and are applied to keys before anything is listed or opened."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a dimension without a value, or with one that its rule doesn't allow, is written as: fixed values.
UNKNOWN, OTHER = "UNKNOWN", "OTHER"


def clean(value: str) -> str:
    """Characters unfit for a path become underscores."""
    return "".join(c if c.isascii() and (c.isalnum() or c in "_.") else "_" for c in value)


def clean_column(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"[^A-Za-z0-9_.]", "_")


@dataclass(frozen=True)
class Dimension:
    """A partition column and what it may be: `*`, a value, a list of values, or a range {min, max} of strings, both ends inclusive."""

    name: str
    allowed: str | tuple[str, ...] | dict[str, str]

    @classmethod
    def of(cls, name: str, allowed: object) -> Dimension:
        if not name:
            raise ValueError("a dimension has no name")
        if isinstance(allowed, str):
            return cls(name, allowed if allowed == "*" else clean(allowed))
        if isinstance(allowed, list):
            if not all(isinstance(x, str) for x in allowed):
                raise ValueError(f"{name}: a list may hold strings only")
            return cls(name, tuple(clean(x) for x in allowed))
        if isinstance(allowed, dict):
            if not allowed or set(allowed) - {"min", "max"} or not all(isinstance(x, str) for x in allowed.values()):
                raise ValueError(f"{name}: a range has min or max, and both are strings")
            return cls(name, dict(allowed))
        raise ValueError(f"{name}: {type(allowed).__name__} is no rule")

    def allows(self, value: str) -> bool:
        """For one value on the driver, such as a folder's name."""
        if self.allowed == "*":
            return True
        if isinstance(self.allowed, dict):
            return self.allowed.get("min", value) <= value <= self.allowed.get("max", value)
        return value in self.allowed if isinstance(self.allowed, tuple) else value == self.allowed

    def matches(self, value: Column | None = None) -> Column:
        """The rule over a value, or over the partition column in a form that Spark takes as a partition filter."""
        column = F.col(self.name) if value is None else value
        if self.allowed == "*":
            return F.lit(True)
        if isinstance(self.allowed, dict):
            return reduce(Column.__and__, [column >= end if kind == "min" else column <= end for kind, end in self.allowed.items()])
        return column.isin(*self.allowed) if isinstance(self.allowed, tuple) else column == self.allowed

    def written(self, value: Column) -> Column:
        """The value that a row is filed under."""
        safe = clean_column(value)
        return F.when(value.isNull(), UNKNOWN).when(self.matches(safe), safe).otherwise(OTHER)


def dimensions(text: str) -> list[Dimension]:
    """The rules of a JSON document {"dimensions": [{"field_name": ..., "allowed_values": ...}, ...]}, in the order of the folders."""
    return [Dimension.of(d.get("field_name", ""), d.get("allowed_values")) for d in json.loads(text)["dimensions"]]


def matching(df: DataFrame, rules: Iterable[Dimension]) -> DataFrame:
    """The rows of a table partitioned by the rules' columns that all rules allow; folders that don't match aren't listed for a scan."""
    return df.filter(reduce(Column.__and__, [r.matches() for r in rules], F.lit(True)))


def write_by_rules(df: DataFrame, path: str, rules: list[Dimension], values: dict[str, Column], mode: str = "errorifexists") -> None:
    """Parquet filed by the rules: a row's value if it is allowed, else OTHER, or UNKNOWN for null."""
    filed = df.withColumns({r.name: r.written(values.get(r.name, F.col(r.name))) for r in rules})
    filed.hint("rebalance", *[r.name for r in rules]).write.mode(mode).partitionBy(*[r.name for r in rules]).parquet(path)


def key_parts(key: Column, rules: list[Dimension], root: str = "") -> list[Column]:
    """Each rule's value in an object's key, from folders named value or name=value below the root."""
    parts = F.split(F.regexp_replace(key, f"^{root.rstrip('/')}/" if root else "^/*", ""), "/")
    value = lambda i: F.regexp_replace(F.get(parts, F.lit(i)), "^[^=]*=", "")
    return [value(i).alias(r.name) for i, r in enumerate(rules)]


def matching_keys(objects: DataFrame, key: str, rules: list[Dimension], root: str = "") -> DataFrame:
    """The objects (key and other columns) whose folders all rules allow, with the folders' values; keys that are too short don't match."""
    named = objects.select("*", *key_parts(F.col(key), rules, root))
    deep = F.size(F.split(F.regexp_replace(F.col(key), f"^{root.rstrip('/')}/" if root else "^/*", ""), "/")) > len(rules)
    return matching(named.filter(deep), rules)


def dealt(objects: DataFrame, key: str, workers: int) -> DataFrame:
    """The objects with column worker, 0 to workers - 1; the same key always goes to the same one."""
    return objects.withColumn("worker", F.pmod(F.xxhash64(key), F.lit(workers)).cast("int"))


def hadoop_folders(spark: SparkSession) -> Callable[[str], list[str]]:
    """A function from a folder to the names of the folders in it, on any store that Spark reads."""

    def folders(path: str) -> list[str]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return sorted(x.getPath().getName() for x in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at) if x.isDirectory())

    return folders


def matching_folders(root: str, rules: list[Dimension], folders: Callable[[str], list[str]]) -> list[str]:
    """The folders of all dimensions that the rules allow; only folders that match so far are listed."""
    found = [root.rstrip("/")]
    for rule in rules:
        found = [f"{path}/{name}" for path in found for name in folders(path) if not name.startswith(("_", ".")) and rule.allows(name.split("=", 1)[-1])]
    return found


def read_matching(spark: SparkSession, root: str, rules: list[Dimension], schema: str | None = None) -> DataFrame:
    """The Parquet files in folders that the rules allow; others are neither listed nor opened. A schema keeps an empty match readable."""
    found = matching_folders(root, rules, hadoop_folders(spark))
    reader = spark.read.option("basePath", root)
    if not found:
        if schema is None:
            raise ValueError("no folder matches")
        return spark.createDataFrame([], schema)
    return (reader.schema(schema) if schema else reader).parquet(*found)
