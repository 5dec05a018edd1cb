"""Embedding whitening: covariance over distinct vectors with their multiplicity, then principal components of unit variance.

Vectors become whole numbers, so equal ones can be grouped exactly. Each distinct vector is centred, weighted, multiplied into the
covariance and whitened once, however many rows hold it, and joined back to them. Tasks make one small matrix
each; only matrices of dimension squared reach the driver, for their eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import join_hot, settle
from sluice.session import table

#: A vector's entry c becomes floor(SCALE * c) + SHIFT; the product is at most BOUND from zero.
SCALE, SHIFT, BOUND = 1024.0, 100_000, 2.0**53
COMPONENTS = 8


def quantised(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows with column x, a list of longs, in place of the vector; rows whose vector is null or holds a null, NaN or infinite entry go.

    So do empty vectors, and those of another length than most; of two lengths that are as frequent the longer stays.
    An entry whose product with SCALE would pass 2**53 counts as 2**53.
    """
    entries = F.col(vector).cast("array<double>")
    finite = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    whole = F.transform(entries, lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-BOUND)), F.lit(BOUND))) + F.lit(SHIFT))
    kept = vectors.filter(F.col(vector).isNotNull() & finite & (F.size(vector) > 0))
    lengths = kept.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    usual = lengths.agg(F.max_by("d", F.struct("n", "d"))).scalar()
    return kept.filter(F.size(vector) == usual).select(*[c for c in vectors.columns if c != vector], whole.alias("x"))


def distinct_vectors(rows: DataFrame, weights: str = "counts") -> DataFrame:
    """(x, rows, w): each distinct x, how many rows hold it, and its weight in the fit: that count, or one."""
    return rows.groupBy("x").agg(F.count("*").alias("rows")).withColumn("w", F.col("rows") if weights == "counts" else F.lit(1).cast("long"))


def weighted_sums(vectors: DataFrame, column: str) -> tuple[int, list]:
    """(sum of weights, weighted sum of each entry), whole numbers as exact ones."""
    kind = "decimal(38,0)" if dict(vectors.dtypes)[column] == "array<bigint>" else "double"
    entries = vectors.select("w", F.posexplode(column).alias("k", "v"))
    found = entries.groupBy("k").agg(F.sum("w").alias("n"), F.sum(F.col("v").cast(kind) * F.col("w").cast("decimal(20,0)" if kind != "double" else kind)).alias("s")).collect()
    sums = [r["s"] for r in sorted(found, key=lambda r: r["k"])]
    return (int(found[0]["n"]), [int(s) if isinstance(s, Decimal) else s for s in sums]) if found else (0, [])


def centred(values: np.ndarray, n: int, sums: list) -> np.ndarray:
    """Rows of values less the mean; whole numbers are subtracted exactly before the division by n."""
    if values.dtype != np.int64:
        return values - np.array(sums) / n
    exact = spread(values, n, sums)
    return (exact / n).astype(np.float64)


def spread(values: np.ndarray, n: int, sums: list) -> np.ndarray:
    """n * x - S of whole numbers, as 64-bit numbers where they fit and as Python's elsewhere."""
    most = max([abs(int(values.max(initial=0))), abs(int(values.min(initial=0)))])
    if n * most + max(map(abs, sums)) < 1 << 62:
        return values * n - np.array(sums, np.int64)
    return values.astype(object) * n - np.array(sums, object)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def weighted_covariance(vectors: DataFrame, column: str, n: int, sums: list) -> np.ndarray:
    """The covariance of the fit list, divisor n: each distinct vector is centred, then counts with its weight in a matrix product."""
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                around = centred(_matrix(batch.column(0)), n, sums)
                total += (around * (batch.column(1).to_numpy() / n)[:, None]).T @ around
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = vectors.select(column, "w").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def eigen(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue, `most` at most; directions without variance are left out."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:most]
    order = order[values[order] > max(values.max(initial=0.0), 0.0) * len(values) * np.finfo(float).eps * 8]
    return values[order], vectors[:, order]


def whitened(vectors: DataFrame, n: int, sums: list, values: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(x, rows, w, z, deviation): each distinct vector projected on the axes, over the roots of their eigenvalues.

    deviation is the sum of squares of n * x - S, exact, or null where it passes 64 bits.
    """
    scaled = axes / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            exact = spread(x, n, sums)
            if float(np.abs(exact).max()) ** 2 * x.shape[1] >= 2.0**62:
                exact = exact.astype(object)  # Python's whole numbers don't overflow
            far = [int(v) if v < 1 << 63 else None for v in (exact * exact).sum(axis=1)]
            z = centred(x, n, sums) @ scaled
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(list(z), pa.list_(pa.float64())), pa.array(far, pa.int64())], ["x", "rows", "w", "z", "deviation"])

    return vectors.select("x", "rows", "w").mapInArrow(run, "x array<long>, rows long, w long, z array<double>, deviation long")


def whiten(vectors: DataFrame, vector: str = "embedding", most: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """The rows with columns z (coordinates along up to `most` components), deviation, n, explained (a share for each component) and identity_error.

    The fit list is all vectors that `quantised` keeps, each as often as rows hold it, or once with weights="one"; n is its length. Components without variance
    are left out: equal vectors, or a single one, have none, and z is empty. Repeated ids are rows of their own; other columns stay, but for ones
    named as these, which are replaced; an empty table gives no rows. identity_error is the largest absolute entry of z's own covariance minus the identity.
    """
    new = ("z", "deviation", "n", "explained", "identity_error", "x", "rows", "w")
    given = vectors.select(vector, *[c for c in vectors.columns if c != vector and c.lower() not in new])
    rows = settle(quantised(given, vector), "quantised")
    fit = settle(distinct_vectors(rows, weights), "distinct")
    n, sums = weighted_sums(fit, "x")
    values, axes, trace = np.zeros(0), np.zeros((len(sums), 0)), 1.0
    if n:
        covariance = weighted_covariance(fit, "x", n, sums)
        values, axes = eigen(covariance, most)
        trace = float(np.trace(covariance)) or 1.0
    made = settle(whitened(fit, n, sums, values, axes), "whitened")
    error = 0.0
    if len(values):
        _, means = weighted_sums(made, "z")
        error = float(np.abs(weighted_covariance(made, "z", n, means) - np.eye(len(values))).max())
    joined = join_hot(rows, made.drop("w"), ["x"], "rows")
    shares = F.array(*[F.lit(float(v / trace)) for v in values]).cast("array<double>")
    return joined.drop("x", "rows").withColumns({"n": F.lit(n).cast("long"), "explained": shares, "identity_error": F.lit(error)})


def by_component(made: DataFrame, *keep: str) -> DataFrame:
    """A row for each row and component, numbered from 1."""
    each: Column = F.posexplode(F.arrays_zip("z", "explained"))
    long = made.select(*keep, "n", "deviation", "identity_error", each.alias("k", "part"))
    return long.select(*keep, (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("part.z").alias("whitened"), F.col("part.explained").alias("explained"), "identity_error")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened coordinates of each embedding."""
    return by_component(whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "vec_id")


QUERIES = {"op13_whitening": op13_whitening}
#: Eigenvectors can't be said in SQL; a test holds the query against a plain decomposition.
ORACLES: dict[str, str] = {}
