"""Phrase collocations by Toivonen's method: a sample proposes, a full pass counts exactly, failures of the border are followed up.

A sample of the documents is mined level by level with a lowered threshold. The full pass counts the proposed phrases and their
negative border: every phrase, of those that occur, whose shorter parts were all proposed. A phrase of the border that turns
out frequent has longer phrases that nobody counted; so another pass counts those, until none is left. Each phrase
is counted in one pass, over all documents, and the result is that of counting all.

These passes count phrases by 64-bit hashes, which shuffle and group cheaply. Two phrases that share a hash only look more frequent, so a last
pass counts the text of those that look frequent, and those counts decide. Which phrases were proposed or look frequent reaches the tasks as
bit maps of bounded size; a phrase that meets another's bit is counted although it need not be, and nothing else changes. Tasks
count before they shuffle, so neither a common word nor a large language meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import settle, slices
from sluice.session import table

#: One in so many documents is in the sample; a phrase is proposed if it is held there by LOWERED times its due share of the threshold.
SAMPLE, LOWERED = 4, 0.8
#: Bits of a map for each phrase in it, and the largest map (32 MB) as a power of two. Larger sets fill it more: more phrases are counted.
BITS_PER_PHRASE, MOST_BITS = 32, 28
#: Bytes of text that a task counts at a time.
SLICE = 2_000_000
#: Parts that a language's phrases are ranked in before the best of all parts are.
PARTS = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.array([ord("." if chr(b) in ".,;:!?\n\v\f\r" else " " if b == 9 else chr(b).lower() if b < 128 else chr(b)) for b in range(256)], np.uint8)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, code, piece, text of each word): lower case (A-Z only), cut at spaces and tabs inside the pieces between punctuation."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    begins = offsets - offsets[0]
    low = _FOLD[raw]
    cut = low == ord(".")
    inside = ~(cut | (low == ord(" ")))
    edge = np.zeros(len(low) + 1, bool)  # a text starts here
    edge[begins] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(low) else inside
    after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(low) else inside
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    owner = np.searchsorted(begins, first, side="right") - 1
    piece = np.cumsum(cut, dtype=np.int32)[first] + owner
    ends = np.concatenate(([0], np.cumsum(last - first)))
    words = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(low[inside])])
    coded = words.dictionary_encode()
    return coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64), piece, owner


def word_hashes(words: pa.Array, langs: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word in its language: a polynomial of its bytes."""
    tongues = langs.dictionary_encode()
    seeds = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in tongues.dictionary.to_pylist()), np.uint64)[tongues.indices.to_numpy()]
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    with np.errstate(over="ignore"):
        powers = np.full(int(lengths.max(initial=0)), _MIX)
        powers = np.multiply.accumulate(powers)
        terms = (raw + np.uint64(1)) * powers[np.arange(len(raw)) - np.repeat(starts, lengths)]
        out = np.zeros(len(words), np.uint64)
        real = lengths > 0
        out[real] = np.add.reduceat(terms, starts[real]) if real.any() else 0
        out = (out ^ seeds) * _MIX
        return out ^ (out >> np.uint64(32))


def longer(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of phrases with one more word."""
    with np.errstate(over="ignore"):
        out = ((hashes ^ (hashes >> np.uint64(29))) * _MIX) ^ word
        return out ^ (out >> np.uint64(31))


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, number of each value among them, a place of each, how often it is there)."""
    coded = pa.array(values).dictionary_encode()
    numbers = coded.indices.to_numpy()
    place = np.zeros(len(coded.dictionary), np.int64)
    place[numbers] = np.arange(len(values))
    return coded.dictionary.to_numpy(), numbers.astype(np.int64), place, np.bincount(numbers, minlength=len(place))


@dataclass
class Proposed:
    """What phrases of each length below the longest are proposed, as bit maps."""

    maps: dict[int, np.ndarray]

    def holds(self, k: int, hashes: np.ndarray) -> np.ndarray:
        if k not in self.maps:
            return np.zeros(len(hashes), bool)
        filled = self.maps[k]
        at = (hashes & np.uint64(len(filled) * 8 - 1)).astype(np.int64)
        return (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def proposed(hashes: DataFrame, longest: int) -> Proposed:
    """The maps of hashes (k, h) of up to `longest` words; the driver gets 2**MOST_BITS / 8 bytes a length at most."""
    sizes = {r["k"]: r["n"] for r in hashes.filter(F.col("k") <= longest).groupBy("k").agg(F.count("*").alias("n")).collect()}
    bits = {k: max(10, min(MOST_BITS, (n * BITS_PER_PHRASE - 1).bit_length())) for k, n in sizes.items()}
    maps = {k: np.zeros(1 << b - 6, np.int64) for k, b in bits.items()}
    for k, b in bits.items():
        low = F.col("h").bitwiseAND(F.lit((1 << b) - 1))
        places = hashes.filter(F.col("k") == k).select(F.shiftright(low, 6).alias("word"), low.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        found = places.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
        maps[k][found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return Proposed({k: m.view(np.uint8) for k, m in maps.items()})


@dataclass
class Words:
    """The words of some texts: each distinct word of a language, its number and hash in every place, and the places' pieces."""

    names: pa.Array
    words: pa.Array
    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, names: pa.Array, tongue: np.ndarray, texts: pa.Array) -> Words:
        """tongue: the number of each text's language among the names."""
        words, codes, piece, owner = tokens(texts)
        pairs, ids, _, counts = _numbered(tongue[owner] * max(1, len(words)) + codes)
        own_words, own_names = words.take(pa.array(pairs % max(1, len(words)))), names.take(pa.array(pairs // max(1, len(words))))
        return cls(own_names, own_words, word_hashes(own_words, own_names), ids, counts, piece)

    def runs(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, whether k words from each place on lie in one piece, hash of each such run) for two words and more."""
        each = self.hashes[self.ids]
        hashes = each
        for k in range(2, longest + 1):
            if len(self.ids) < k:
                return
            hashes = longer(hashes[: len(self.ids) - k + 1], each[k - 1 :])
            yield k, self.piece[: len(self.ids) - k + 1] == self.piece[k - 1 :], hashes

    def phrases(self, start: np.ndarray, k: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(languages, phrases, counts) of the runs of k words from these places on."""
        same = self.ids[start]
        for j in range(1, k):
            _, same, _, _ = _numbered(same * len(self.words) + self.ids[start + j])
        _, _, first, n = _numbered(same)
        at = start[first]
        return self.names.take(pa.array(self.ids[at])), pc.binary_join_element_wise(*[self.words.take(pa.array(self.ids[at + j])) for j in range(k)], " "), n


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """(names of languages, number of each text's language, texts) of batches (lang, text), a few megabytes at a time."""
    for batch in batches:
        done = 0
        for texts in slices(batch.column(1), SLICE):
            tongues = batch.column(0).slice(done, len(texts)).dictionary_encode()
            yield tongues.dictionary, tongues.indices.to_numpy().astype(np.int64), texts
            done += len(texts)
        pa.default_memory_pool().release_unused()


def counted_hashes(docs: DataFrame, passes: list[Broadcast], least_k: int, longest: int) -> DataFrame:
    """(k, h, n) for docs (lang, text): the phrases of least_k to `longest` words that the last of passes admits and none before it.

    A pass admits all words, and a longer phrase if it proposes both phrases with a word less, and so on down.
    """

    def one(own: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if least_k <= 1:
            yield 1, own.hashes, own.counts
        held = [p.value.holds(1, own.hashes)[own.ids] for p in passes]
        for k, whole, hashes in own.runs(longest):
            fits = [whole & h[:-1] & h[1:] for h in held]
            new = fits[-1].copy()
            for f in fits[:-1]:
                new &= ~f
            if k >= least_k and new.any():
                found, _, _, n = _numbered(hashes[new].view(np.int64))
                yield k, found.view(np.uint64), n
            if k == longest:
                return
            held = [np.zeros(len(whole), bool) for _ in passes]
            for p, f, h in zip(passes, fits, held, strict=True):
                at = np.flatnonzero(f)
                h[at] = p.value.holds(k, hashes[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, tongue, texts in _by_slice(batches):
            for k, found, n in one(Words.of(names, tongue, texts)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.array(found.view(np.int64)), pa.array(n)], ["k", "h", "n"])

    # Slices are counted already and share few phrases, so tasks send them as they are: a hash map of them would take more memory than it saves rows.
    return docs.mapInArrow(run, "k int, h long, n long").repartition("k", "h").groupBy("k", "h").agg(F.sum("n").alias("n"))


def counted_phrases(docs: DataFrame, wanted: Broadcast, longest: int) -> DataFrame:
    """(lang, phrase, k, n) for docs (lang, text): the phrases whose hashes are wanted. The phrase of no words stands for all words of a language."""

    def one(names: pa.Array, tongue: np.ndarray, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array, int, np.ndarray]]:
        own = Words.of(names, tongue, texts)
        tongues = own.names.dictionary_encode()
        every = np.zeros(len(tongues.dictionary), np.int64)
        np.add.at(every, tongues.indices.to_numpy(), own.counts)
        yield tongues.dictionary, pa.array([""] * len(every), pa.string()), 0, every
        held = np.flatnonzero(wanted.value.holds(1, own.hashes))
        yield own.names.take(pa.array(held)), own.words.take(pa.array(held)), 1, own.counts[held]
        for k, whole, hashes in own.runs(longest):
            start = np.flatnonzero(whole)
            start = start[wanted.value.holds(k, hashes[start])]
            yield *(found := own.phrases(start, k))[:2], k, found[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, tongue, texts in _by_slice(batches):
            for langs, phrases, k, n in one(names, tongue, texts):
                yield pa.RecordBatch.from_arrays([langs, phrases, pa.array(np.full(len(n), k, np.int32)), pa.array(n)], ["lang", "phrase", "k", "n"])

    return docs.mapInArrow(run, "lang string, phrase string, k int, n long").groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, least: int = 10, longest: int = 3, sample: int = SAMPLE) -> DataFrame:
    """(lang, phrase, k, n): all phrases of up to `longest` words that occur `least` times in a language, with all their occurrences.

    The row with k = 0 has all word occurrences of a language, if there are any. A null lang is `und`; an empty table gives no rows.
    """
    send = docs.sparkSession.sparkContext.broadcast
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("string"), F.col("text")).alias("id"))
    few = rows.filter(F.pmod(F.xxhash64("id"), F.lit(sample)) == 0).select("lang", "text")
    rows = rows.select("lang", "text")
    lowered = max(1, int(LOWERED * least / sample))
    guess = send(Proposed({}))
    for k in range(1, longest):
        guess = send(Proposed(guess.value.maps | proposed(settle(counted_hashes(few, [guess], k, k).filter(F.col("n") >= lowered), "proposed"), k).maps))
    passes, found = [guess], None
    while True:
        new = settle(counted_hashes(rows, passes, 2 if found else 1, longest).filter(F.col("n") >= least), "counted")
        found = found.union(new) if found else new
        if not _missing(new, passes[-1], longest - 1):
            break
        passes.append(send(proposed(found, longest - 1)))
    wanted = send(proposed(found, longest))
    return settle(counted_phrases(rows, wanted, longest).filter((F.col("n") >= least) | (F.col("k") == 0)), "phrases")


def _missing(hashes: DataFrame, known: Broadcast, longest: int) -> bool:
    """Whether the maps lack any of these phrases of up to `longest` words: failures of the border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            lost = sum(int((~known.value.holds(int(k), h[ks == k])).sum()) for k in np.unique(ks))
            yield pa.RecordBatch.from_arrays([pa.array([lost], pa.int64())], ["n"])

    return (hashes.filter(F.col("k") <= longest).select("k", "h").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0) > 0


def collocations(found: DataFrame, least_words: int = 2, most: int = 2000, covered: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's best phrases of least_words words or more out of (lang, phrase, k, n).

    Cutting a phrase that occurs a times into parts that occur l and r times scores floor(1,000,000 a a / (l r)); the worst cut
    counts, the first of equally bad ones. A phrase goes if a longer one around it occurs in `covered` per cent of its places
    or more. Equal scores are ranked by a, then by the phrase's bytes. Products are exact up to 38 digits.
    """
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("part_n"))
    candidates = found.filter(F.col("k") >= least_words).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = candidates.filter(F.size("words") > 1).withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(words, 1, cut), ' ')").alias("head"), F.expr("array_join(slice(words, cut + 1, size(words) - cut), ' ')").alias("tail"))
    left = cuts.join(parts.withColumnsRenamed({"part": "head", "part_n": "l"}), ["lang", "head"])
    both = left.join(parts.withColumnsRenamed({"part": "tail", "part_n": "r"}), ["lang", "tail"])
    wide = "CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    worst = both.withColumn("score", F.expr(wide)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
    inner = F.expr(f"flatten(transform(sequence({least_words}, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), s -> array_join(slice(words, s, m), ' '))))")
    around = candidates.filter(F.size("words") > least_words).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("around"))
    kept = worst.join(around.groupBy("lang", "phrase").agg(F.max("around").alias("around")), ["lang", "phrase"], "left").filter(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * covered))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = kept.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part"))
    best = flat.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most).drop("part")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    totals = found.filter("k = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of each language."""
    return collocations(frequent_phrases(table(spark, sf_dir, "documents")))


QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {
    "op11_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
            UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) >= 2
            UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w WHERE len(w) >= 3),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
        c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
        u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
        s AS (SELECT u.lang, u.phrase, u.k, u.a, u.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * u.a * u.a) // (x.f::HUGEINT * y.f) AS score
            FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.cut + 1:], ' ')),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        o AS (SELECT lang, phrase, max(a) AS around FROM (SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE k = 3) GROUP BY ALL),
        z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
            FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase AND b.k = 2 WHERE around IS NULL OR 100 * around < 50 * a)
        SELECT z.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z JOIN t USING (lang) WHERE rank <= 2000""",
}
