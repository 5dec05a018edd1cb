"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

The rarity of a test item's n-gram is the product of its words' frequencies over all documents, so
that a test passage copied into many documents stays rare. A fixed-size bit map of the seeds' hashes
goes to every task; the passages around its hits are joined with the seeds by the full hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import settle, slices, word_codes
from sluice.session import table

#: Words of a seed.
SEED_WORDS = 3
#: Bits of the maps that pre-filter words and seeds: 8 MB each, whatever the benchmark's size.
MAP_BITS = 26
MATCH, MISMATCH, GAP = 2, -1, -1
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, their hashes, codes, starts) of texts, as word_codes has them."""
    distinct, codes, starts = word_codes(texts)
    return distinct, np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct)), codes, starts


def _grams(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SEED_WORDS words."""
    n = len(hashes) - SEED_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(SEED_WORDS):
            out = (out ^ hashes[k : k + n]) * _MIX[k]
            out ^= out >> np.uint64(29)
    return out


def _bit_map(df: DataFrame, column: str) -> np.ndarray:
    """A map with a bit for each hash of the column; tasks set the bits, and 2**MAP_BITS / 64 longs are collected at most."""
    low = F.col(column).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = df.select(F.shiftright(low, 6).alias("word"), low.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    packed = np.zeros(1 << (MAP_BITS - 6), np.int64)
    packed[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return packed.view(np.uint8)


def _holds(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = (hashes & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
    return (packed[low >> 3] >> (low & 7).astype(np.uint8)) & 1 > 0


def _item_words(items: DataFrame) -> DataFrame:
    """(item_id, n, word, words, seed, place): a row for each n-gram of each item, words as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, hashes, codes, _ = _words(batch.column(1).slice(k, 1))
                own = hashes[codes]
                grams = _grams(own)
                if not len(grams):
                    continue
                words = np.stack([own[i : i + len(grams)] for i in range(SEED_WORDS)], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[k].as_py()] * len(grams), pa.int64()),
                        pa.array([len(own)] * len(grams), pa.int32()),
                        pa.array(grams.view(np.int64)),
                        pa.array(np.arange(len(grams)), pa.int32()),
                        pa.array(words.tolist(), pa.list_(pa.int64())),
                    ],
                    ["item_id", "n", "seed", "place", "words"],
                )

    chosen = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "item_id long, n int, seed long, place int, words array<long>")


def word_counts(docs: DataFrame, packed: np.ndarray) -> DataFrame:
    """(word, n): occurrences over all documents of the words whose hashes the bit map holds; word 0 has the total."""
    sent = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, {}
        for batch in batches:
            for texts in slices(batch.column(0)):
                _, hashes, codes, _ = _words(texts)
                total += len(codes)
                counts = np.bincount(codes, minlength=len(hashes))
                for k in np.flatnonzero(_holds(sent.value, hashes)):
                    word = int(hashes.view(np.int64)[k])
                    seen[word] = seen.get(word, 0) + int(counts[k])
        yield pa.RecordBatch.from_arrays([pa.array([0, *seen], pa.int64()), pa.array([total, *seen.values()], pa.int64())], ["word", "n"])

    made = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def rare_seeds(docs: DataFrame, items: DataFrame, rare: float = 1e-9) -> DataFrame:
    """(seed, item_id, need): each item's n-grams whose word frequencies multiply to `rare` at most,
    and in any case the rarer half of them. need: how many of them a passage must share."""
    grams = settle(_item_words(items), "item_grams")
    words = grams.select("item_id", "place", "seed", F.explode("words").alias("word"))
    counts = settle(word_counts(docs, _bit_map(words, "word")), "word_counts")
    total = counts.filter("word = 0").agg(F.sum("n")).first()[0] or 1
    logs = words.join(counts.filter("word <> 0"), "word", "left").select("item_id", "place", "seed", F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total))).alias("log"))
    rated = logs.groupBy("item_id", "place", "seed").agg(F.sum("log").alias("log"))
    own = W.partitionBy("item_id")
    ranked = rated.withColumn("rank", F.row_number().over(own.orderBy("log", "place"))).withColumn("all", F.count("*").over(own))
    kept = ranked.filter((F.col("log") <= float(np.log10(rare))) | (F.col("rank") * 2 <= F.col("all") + 1))
    return kept.groupBy("seed", "item_id").agg(F.when(F.max("all") < 6, 1).otherwise(2).alias("need"))


def passages(docs: DataFrame, packed: np.ndarray, reach: int) -> DataFrame:
    """(doc_id, start, words, seeds): what lies within `reach` words of hits, in tiles of a bounded length."""
    sent = docs.sparkSession.sparkContext.broadcast(packed)

    def tiles(hits: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        cuts = np.flatnonzero(np.diff(hits) > 2 * reach) + 1
        for part in np.split(hits, cuts):
            first, last = max(0, int(part[0]) - reach), min(n, int(part[-1]) + SEED_WORDS + reach)
            at = first
            while True:
                yield at, min(last, at + 4 * reach)
                if at + 4 * reach >= last:
                    break
                at += 2 * reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done = batch.column(0).to_pylist(), 0
            for texts in slices(batch.column(1)):
                distinct, hashes, codes, starts = _words(texts)
                grams = _grams(hashes[codes])
                hit = np.flatnonzero(_holds(sent.value, grams))
                owner = np.searchsorted(starts, hit, side="right") - 1
                inside = hit + SEED_WORDS <= starts[owner + 1] if len(hit) else np.zeros(0, bool)
                hit, owner = hit[inside], owner[inside]
                out: list[tuple] = []
                for k in np.unique(owner):
                    own, low, high = hit[np.searchsorted(owner, k) : np.searchsorted(owner, k, side="right")], starts[k], starts[k + 1]
                    for a, b in tiles(own - low, high - low):
                        here = own[(own >= low + a) & (own + SEED_WORDS <= low + b)]
                        seeds = np.unique(grams[here]).view(np.int64).tolist()
                        out.append((ids[done + k], int(a), " ".join(distinct[c] for c in codes[low + a : low + b]), seeds))
                done += len(texts)
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True)], ["doc_id", "start", "words", "seeds"]
                )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, start long, words string, seeds array<long>")


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two code arrays: (score, end in passage, end in item), ends exclusive."""
    n = len(passage)
    row, best, where = np.zeros(n + 1, np.int64), 0, (0, 0)
    steps = -GAP * np.arange(n + 1)
    for i, code in enumerate(item):
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == code, MATCH, MISMATCH))
        new = np.maximum.accumulate(new + steps) - steps  # gaps in the item, carried along the row
        row = new
        if (top := int(row.max())) > best:
            best, where = top, (int(row.argmax()), i + 1)
    return best, *where


def _aligned(found: DataFrame) -> DataFrame:
    """Score every (passage, item) pair: score is the share of the item's best possible score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], tuple[float, int, int]] = {}
        for batch in batches:
            rows = batch.to_pydict()
            scores = []
            for item_id, start, words, text in zip(rows["item_id"], rows["start"], rows["words"], rows["text"], strict=True):
                key = (words, item_id)
                if key not in seen:
                    if len(seen) > 5000:
                        seen.clear()
                    codes: dict[str, int] = {}
                    distinct, _, places, _ = _words(pa.array([text], pa.string()))
                    item = np.array([codes.setdefault(distinct[c], len(codes)) for c in places])
                    passage = np.array([codes.get(w, -1) for w in words.split(" ")])
                    score, end, item_end = align(passage, item)
                    _, length, _ = align(passage[:end][::-1], item[:item_end][::-1])
                    seen[key] = (score / (MATCH * len(item)), end - length, end)
                share, first, last = seen[key]
                scores.append((share, start + first, start + last))
            columns = list(zip(*scores, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                ["doc_id", "item_id", "n_seeds", "score", "start_word", "end_word"],
            )

    return found.mapInArrow(run, "doc_id long, item_id long, n_seeds long, score double, start_word long, end_word long")


def contamination(docs: DataFrame, items: DataFrame, least: float = 0.4, rare: float = 1e-9, corpus: DataFrame | None = None) -> DataFrame:
    """One row for each document and test item that it holds a copy of: doc_id, item_id, score,
    start_word, end_word, n_seeds.

    score is the alignment's share of the item's best possible score, `least` or more. Of several
    copies in one document the best counts, then the first. Words are white-space runs in lower
    case, trimmed of punctuation; how rare they are is counted over `corpus`, or else over docs. Items of fewer than three words and null or empty texts match nothing; rows
    without doc_id and items without item_id are left out, repeated documents give one row, other columns are ignored, and
    empty tables give no rows.
    """
    items = items.filter("item_id is not null")
    seeds = settle(rare_seeds(docs if corpus is None else corpus, items, rare), "seeds")
    reach = settle(_item_words(items).select("n"), "lengths").agg(F.max("n")).first()[0] or SEED_WORDS
    spots = settle(passages(docs.filter("doc_id is not null"), _bit_map(seeds, "seed"), int(reach)), "passages")
    hits = spots.select("doc_id", "start", F.explode("seeds").alias("seed")).join(seeds, "seed")
    pairs = hits.groupBy("doc_id", "start", "item_id").agg(F.count_distinct("seed").alias("n_seeds"), F.max("need").alias("need")).filter("n_seeds >= need")
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropDuplicates(["item_id", "text"])
    found = pairs.join(spots.select("doc_id", "start", "words"), ["doc_id", "start"]).join(wanted, "item_id").select("doc_id", "item_id", "n_seeds", "start", "words", "text")
    best = _aligned(found).filter(F.col("score") >= least).groupBy("doc_id", "item_id")
    place = F.struct("score", (-F.col("start_word")).alias("before"), "end_word", "n_seeds")
    kept = best.agg(F.max(place).alias("b"))
    return kept.select("doc_id", "item_id", F.round("b.score", 6).alias("score"), (-F.col("b.before")).alias("start_word"), "b.end_word", "b.n_seeds")


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents, with their own columns, that hold no copy of a test item; rows without doc_id are judged by their text.

    Items without item_id count as well: each stands for its own text.
    """
    tests = items.select(F.coalesce(F.col("item_id").cast("long"), F.xxhash64("text")).alias("item_id"), "text")
    names, text = docs.columns, F.col("text").cast("string")
    bad = settle(contamination(docs, tests, least).select("doc_id").distinct(), "contaminated")  # its size is then known
    known = docs.filter("doc_id is not null").join(bad, docs["doc_id"].cast("long") == bad["doc_id"], "left_anti").select(*names)
    nameless = docs.filter("doc_id is null")
    if nameless.isEmpty():
        return known
    stand_in = nameless.select(F.xxhash64(text).alias("doc_id"), text.alias("text")).distinct()
    found = settle(contamination(stand_in, tests, least, corpus=docs).select(F.col("doc_id").alias("__text")).distinct(), "contaminated")
    return known.unionByName(nameless.join(found, F.xxhash64(text) == F.col("__text"), "left_anti").select(*names))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLES: dict[str, str] = {}
