"""What the corpus operators share: settled tables, held-out folds and batch slicing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import shared_dir

#: Where settled tables are.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def own_folder(spark: SparkSession) -> str:
    """The part of the shared folder that holds what this application settles."""
    return f"{shared_dir(spark)}/sluice/{spark.sparkContext.applicationId}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the plan ends there and lost executors cost no rerun."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[made] = path
    return made


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more: the earlier rounds of a loop."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            _delete(df.sparkSession, path.rsplit("/", 1)[0])


def cleanup(spark: SparkSession) -> None:
    """Delete all that this application has settled; results that were not yet written are lost with it."""
    _delete(spark, own_folder(spark))


#: A key with more than one in so many of all rows is hot; there are fewer than HOT such keys.
HOT = 1000


def join_hot(rows: DataFrame, found: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows left-joined with found, which has each key once and in `weight` how many of rows hold it.

    Hot keys come to every task by a broadcast of fewer than HOT rows, so that no task gets all rows of one; the
    others meet by a shuffle. Both tables are read twice and had better be settled.
    """
    values = [c for c in found.columns if c not in keys]
    hot = F.col(weight) * HOT > F.coalesce(found.agg(F.sum(weight)).scalar(), F.lit(0))
    few = found.filter(hot).select(*keys, F.struct(*values).alias("__few"))
    near = rows.join(F.broadcast(few), keys, "left")
    there = near.filter("__few is not null").select(*rows.columns, "__few.*")
    return there.unionByName(near.filter("__few is null").drop("__few").join(found.filter(~hot), keys, "left").select(*rows.columns, *values))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 marks the held-out rows. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def slices(texts: pa.Array, size: int = 4_000_000) -> Iterator[pa.Array]:
    """Zero-copy slices of an array of texts that hold about so many bytes each, one text at least."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < len(texts):
        before = lengths[start - 1] if start else 0
        end = max(start + 1, int(lengths.searchsorted(before + size, side="right")))
        yield texts.slice(start, end - start)
        start = end


#: Trimmed off the ends of words.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¡¿“”‘’„…–—·、。，！？：；（）"


def word_codes(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct, codes, starts) of the words of texts: white-space runs in lower case, trimmed of punctuation.

    The words of text k are distinct[c] for c in codes[starts[k]:starts[k + 1]]; a null text has none.
    """
    parts = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    offsets = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    raw = parts.flatten().dictionary_encode()
    trimmed = pc.utf8_trim(raw.dictionary, PUNCTUATION).dictionary_encode()
    distinct = trimmed.dictionary.to_numpy(zero_copy_only=False).tolist()
    codes = trimmed.indices.to_numpy().astype(np.int64)[raw.indices.to_numpy()] if len(raw) else np.zeros(0, np.int64)
    if "" in distinct:
        real = codes != distinct.index("")
        offsets = np.concatenate(([0], np.cumsum(real)))[offsets]
        codes = codes[real]
    return distinct, codes, offsets


def token_codes(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct, codes, starts) as word_codes has them, but the punctuation before and after a word counts as a token of its own."""
    parts = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    offsets = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    raw = parts.flatten().dictionary_encode()
    at: dict[str, int] = {}
    codes, counts = [], []
    for word in raw.dictionary.to_pylist():
        rest = word.lstrip(PUNCTUATION)
        core = rest.rstrip(PUNCTUATION)
        own = [x for x in (word[: len(word) - len(rest)], core, rest[len(core) :]) if x]
        codes += [at.setdefault(x, len(at)) for x in own]
        counts.append(len(own))
    each, place = np.array(counts, np.int64), raw.indices.to_numpy() if len(raw) else np.zeros(0, np.int64)
    n = each[place]
    first = np.cumsum(n) - n
    spread = np.repeat((np.cumsum(each) - each)[place] - first, n) + np.arange(int(n.sum()))
    return list(at), np.array(codes, np.int64)[spread], np.concatenate(([0], np.cumsum(n)))[offsets]
