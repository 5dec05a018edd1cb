"""Repeated lines across documents: Bloom filters of what was seen once and twice, then exact confirmation of suspects.

Tasks fill two filters of one size from the hashes of their documents' lines: a bit of the first is set by a
line, a bit of the second by another line that finds it set already. Two such pairs merge without loss, piece by piece,
in a shuffle of bits. Only the second filter is sent to the tasks, and its size is bounded; a line all of
whose bits it holds is suspected to stand in more than one document. Digests of suspects are the
only lines that shuffle: they are counted by document, and the largest id keeps the line. Texts without
a suspect never leave their task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import join_hot, settle, slices
from sluice.session import table

#: Bits of either filter for a line, bits that a line sets, and the smallest and largest filter (128 MB) as powers of two.
#: Beyond the largest more lines are suspected, and the exact step decides about more of them; results don't change.
BITS_PER_LINE, PROBES, LEAST_BITS, MOST_BITS = 12, 3, 16, 30
#: Bits of a piece of a filter, as a power of two (64 KB).
PIECE = 19
#: Stripped from both ends of a line.
SPACE = " \t\n\v\f\r"


def keys_of(texts: pa.Array, shortest: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, code of each line, owner of each line, lines of each text); the code is -1 where a key is shorter than `shortest`.

    A key is a line in lower case (A-Z only) without white space at its ends. A null or empty text is one empty line.
    """
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    count = pc.list_value_length(lines).to_numpy().astype(np.int64)
    coded = pc.ascii_trim(pc.ascii_lower(lines.flatten()), SPACE).dictionary_encode()
    keys, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    long = pc.greater_equal(pc.utf8_length(keys), shortest).to_numpy(zero_copy_only=False)
    return keys, np.where(long[codes], codes, -1), np.repeat(np.arange(len(texts)), count), count


def _probes(keys: pa.Array, used: np.ndarray, bits: int) -> np.ndarray:
    """A row of PROBES places in a filter for each of the keys in use, zeros for the others."""
    out = np.zeros((len(keys), PROBES), np.int64)
    if len(used):
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys.take(pa.array(used)).to_pylist()), np.uint64, len(used))
        step = (h >> np.uint64(32)) | np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(PROBES):
                out[used, k] = (h + np.uint64(k) * step) & np.uint64((1 << bits) - 1)
                h ^= h >> np.uint64(29)
    return out


def _distinct(codes: np.ndarray, owners: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, code) of the long lines, each once in a text."""
    real = codes >= 0
    pairs = np.unique(owners[real] * max(1, n_keys) + codes[real])
    return pairs // max(1, n_keys), pairs % max(1, n_keys)


def _get(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _set(filled: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filled, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def filter_bits(docs: DataFrame, most: int = MOST_BITS) -> int:
    """The size of the filters, as a power of two, from the number of lines of all texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select((F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n")).agg(F.sum("n")).first()[0] or 0
    return max(LEAST_BITS, min(most, int(lines * BITS_PER_LINE - 1).bit_length()))


def twice_seen(docs: DataFrame, bits: int, shortest: int) -> np.ndarray:
    """The second filter: the bits that lines of two documents, or two lines, have set.

    The driver gets 2**bits / 8 bytes at most. A piece of all tasks' filters is merged as a stream.
    """
    size = 1 << min(PIECE, bits) - 3

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(1 << bits - 3, np.uint8), np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            for texts in slices(batch.column(0)):
                keys, codes, owners, _ = keys_of(texts, shortest)
                _, found = _distinct(codes, owners, len(keys))
                at, n = np.unique(_probes(keys, np.unique(found), bits)[found].ravel(), return_counts=True)
                _set(twice, at[_get(once, at) | (n > 1)])
                _set(once, at)
        for piece in np.flatnonzero(once.reshape(-1, size).any(axis=1)):
            own = slice(piece * size, (piece + 1) * size)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([once[own].tobytes()]), pa.array([twice[own].tobytes()])], ["piece", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(piece: int, twice: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([twice.tobytes()])], ["piece", "twice"])

        now, once, twice = None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                piece, own, more = (batch.column(c)[k].as_py() for c in range(3))
                if piece != now:
                    if now is not None:
                        yield row(now, twice)
                    now, once, twice = piece, np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                own, more = np.frombuffer(own, np.uint8), np.frombuffer(more, np.uint8)
                twice |= more | (once & own)
                once |= own
        if now is not None:
            yield row(now, twice)

    filled = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(fill, "piece int, once binary, twice binary")
    merged = filled.repartition(max(1, (1 << bits - 3) // size // 4), "piece").sortWithinPartitions("piece").mapInArrow(merge, "piece int, twice binary")
    out = np.zeros(((1 << bits - 3) // size, size), np.uint8)
    for r in merged.toArrow().to_pylist():
        out[r["piece"]] = np.frombuffer(r["twice"], np.uint8)
    return out.ravel()


def _suspected(keys: pa.Array, codes: np.ndarray, bits: int, twice: np.ndarray) -> np.ndarray:
    """Whether the second filter holds each key that stands in a text and is long enough."""
    used = np.unique(codes[codes >= 0])
    out = np.zeros(len(keys), bool)
    out[used] = _get(twice, _probes(keys, used, bits)[used]).all(axis=1)
    return out


def _digests(keys: pa.Array) -> list[bytes]:
    return [hashlib.sha256(k.encode()).digest() for k in keys.to_pylist()]


def suspects(docs: DataFrame, bits: int, twice: Broadcast, shortest: int) -> DataFrame:
    """(key, doc_id, row): the SHA-256 of each suspected line, once for each row of docs that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in slices(batch.column(2)):
                keys, codes, owners, _ = keys_of(texts, shortest)
                who, what = _distinct(codes, owners, len(keys))
                held = _suspected(keys, codes, bits, twice.value)[what]
                used, place = np.unique(what[held], return_inverse=True)
                digests = pa.array(_digests(keys.take(pa.array(used))), pa.binary())
                rows = pa.array(who[held] + done)
                yield pa.RecordBatch.from_arrays([digests.take(pa.array(place)), batch.column(0).take(rows), batch.column(1).take(rows)], ["key", "doc_id", "row"])
                done += len(texts)

    return docs.filter("doc_id is not null").mapInArrow(run, "key binary, doc_id long, row long")


def confirmed(found: DataFrame, least: int) -> DataFrame:
    """(key, keeper, n): lines that at least so many documents hold, the largest id of them, and their rows in found."""
    by_doc = found.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"), F.sum("n").alias("n")).filter(F.col("docs") >= least).drop("docs")


_KEPT = "doc_id long, text string, n_lines long, n_dropped long"


def _result(ids: pa.Array, texts: pa.Array, n_lines: np.ndarray, n_dropped: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, texts, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])


def _untouched(docs: DataFrame, bits: int, twice: Broadcast, shortest: int) -> DataFrame:
    """The documents without a suspected line, which keep all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in slices(batch.column(2)):
                keys, codes, owners, count = keys_of(texts, shortest)
                touched = np.zeros(len(texts), bool)
                touched[owners[(codes >= 0) & _suspected(keys, codes, bits, twice.value)[codes]]] = True
                ids = batch.column(0).slice(done, len(texts))
                rows = np.flatnonzero(~touched | ids.is_null().to_numpy(zero_copy_only=False))
                yield _result(ids.take(pa.array(rows)), texts.take(pa.array(rows)), count[rows], np.zeros(len(rows), np.int64))
                done += len(texts)

    return docs.mapInArrow(run, _KEPT)


def _touched(docs: DataFrame, bits: int, twice: Broadcast, shortest: int) -> DataFrame:
    """(doc_id, row, text) of the documents with a suspected line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in slices(batch.column(2)):
                keys, codes, owners, _ = keys_of(texts, shortest)
                rows = np.unique(owners[(codes >= 0) & _suspected(keys, codes, bits, twice.value)[codes]])
                yield batch.slice(done, len(texts)).take(pa.array(rows))
                done += len(texts)

    return docs.filter("doc_id is not null").mapInArrow(run, "doc_id long, row long, text string")


def _without(docs: DataFrame, shortest: int) -> DataFrame:
    """docs (doc_id, text, drops) without the lines whose digests are in drops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in slices(batch.column(1)):
                keys, codes, _, count = keys_of(texts, shortest)
                drops, known, kept, lost = batch.column(2).slice(done, len(texts)), {}, [], []
                raw, start = pc.fill_null(texts, "").to_pylist(), 0
                for k, text in enumerate(raw):
                    own, gone = codes[start : start + count[k]], set(drops[k].as_py() or ())
                    start += count[k]
                    if not gone:
                        kept.append(text)
                        lost.append(0)
                        continue
                    for c in set(own[own >= 0].tolist()) - known.keys():
                        known[c] = hashlib.sha256(keys[c].as_py().encode()).digest()
                    stay = [line for line, c in zip(text.split("\n"), own.tolist(), strict=True) if c < 0 or known[c] not in gone]
                    kept.append("\n".join(stay))
                    lost.append(len(own) - len(stay))
                yield _result(batch.column(0).slice(done, len(texts)), pa.array(kept, pa.string()), count, np.array(lost, np.int64))
                done += len(texts)

    return docs.mapInArrow(run, _KEPT)


def drop_repeated_lines(docs: DataFrame, least: int = 3, shortest: int = 20, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, text, n_lines and n_dropped for each row of docs: lines that `least` documents hold stay only in the one with the largest id.

    Lines are cut at newlines and compared in lower case (A-Z) without white space at their ends; keys of fewer than `shortest` code
    points always stay, and n_lines counts all lines before any goes. A null or empty text is one empty line, and its text is empty. Rows of one
    doc_id are one document, so all of them keep a line that their id keeps. Rows without a doc_id keep all lines and count for no other.
    A document may lose all its lines; its text is empty then. Other columns are ignored; an empty table gives no rows.
    Equal SHA-256 digests stand for equal lines.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    bits = filter_bits(docs, most_bits)
    twice = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, bits, shortest))
    found = settle(suspects(rows, bits, twice, shortest), "suspects")
    real = settle(confirmed(found, least), "confirmed")
    lost = join_hot(found, real, ["key"], "n").filter("keeper is not null and keeper <> doc_id")
    drops = lost.groupBy("doc_id", "row").agg(F.collect_set("key").alias("drops"))
    changed = _touched(rows, bits, twice, shortest).join(drops, ["doc_id", "row"], "left").select("doc_id", "text", "drops")
    return _untouched(rows, bits, twice, shortest).union(_without(changed, shortest))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each document without repeated lines."""
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op12_line_dedup": op12_line_dedup}
ORACLES = {
    "op12_line_dedup": """
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
        m AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        r AS (SELECT key, max(doc_id) AS keeper FROM m WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
        FROM m LEFT JOIN r USING (key) GROUP BY doc_id""",
}
