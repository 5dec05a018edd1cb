"""Cross-entropy difference: target and background n-gram models over one vocabulary score each document.

Both models are interpolated bigram models with a count of their own for every word and every pair
of the corpus; the background counts all documents, the target those that are marked. The counts
are never broadcast. Documents are dealt to blocks. A block counts its own words and pairs first and
sends them, sorted, to buckets of keys; a bucket adds the blocks up and answers each with the
totals in the order of its keys, which then needn't travel back.

A document of the corpus can be scored by what all other documents say: its own words and pairs are
then taken out of both models first, so that neither knows the text that it scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import slices, token_codes, word_codes
from sluice.session import table

#: Words that smoothing reckons with, 2**19; more if the corpus has more.
WORD_BITS = 19
#: Weight of the pair's frequency against the word's.
PAIR_WEIGHT = 0.6
#: Bytes of text of a block on average at most; a bucket has a like share of the keys.
BLOCK_BYTES = 8_000_000
#: Buckets at least.
BUCKETS = 1 << 10
#: Keys are 63 bits of a hash, and the lowest bit tells words (0) from pairs (1).
_PAIR = np.uint64(1)
#: The keys of all tokens and of the start mark.
_TOTAL, _START = np.uint64(0), np.uint64(0x5851F42D4C957F2C)
_ROWS = "bucket int, block int, keys binary, n_background binary, n_target binary"


def _keys(texts: pa.ChunkedArray, split: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word keys, pair keys, starts) of texts; the first word of each follows a start mark."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for part in (s for chunk in texts.chunks for s in slices(chunk)):
        distinct, codes, starts = split(part)
        if len(codes):
            hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[codes] & ~_PAIR)
        counts.append(np.diff(starts))
    words, starts = np.concatenate(hashes), np.cumsum(np.concatenate(counts))
    with np.errstate(over="ignore"):
        pairs = (_before(words, starts, _START) * np.uint64(0x9E3779B97F4A7C15)) ^ (words * np.uint64(0xC2B2AE3D27D4EB4F))
    return words, (pairs ^ (pairs >> np.uint64(31))) | _PAIR, starts


def _before(values: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """The value of the word before each word, and `first` where a text starts."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[starts[:-1][starts[:-1] < starts[1:]]] = first
    return before


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as many bytes as the largest needs, all lowest bytes first."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(packed[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : packed[0]] = planes.T
    return out.view("<u8").reshape(-1)


def _counted(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys in order, the place of each key, sums of each weight)."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, place, [np.bincount(place, w, len(distinct)).astype(np.int64) for w in weights]


class Corpus:
    """Documents and the ids of the target's documents, from which both models count."""

    def __init__(self, docs: DataFrame, targets: DataFrame, marks: bool = False) -> None:
        self.split = token_codes if marks else word_codes
        self.docs, self.spark = docs, docs.sparkSession
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        self.blocks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
        self.bits = (max(BUCKETS, -(-size // BLOCK_BYTES)) - 1).bit_length()
        self.ids = targets.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").select(self._block(F.col("doc_id")), "doc_id")

    @cached_property
    def _names(self) -> list[int]:
        """A name for each block, so that Spark deals as many blocks to one partition as to another."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if self.blocks > 8192:
            return []
        each = -(-self.blocks // n)
        at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
        found = self.spark.range(0, 32 * n * each, 1, 1).groupBy(at.alias("p")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, each).alias("ids")).collect()
        return [k for r in found for k in r["ids"]]

    def _block(self, key: Column) -> Column:
        if not self._names:
            return F.pmod(F.xxhash64(key), F.lit(self.blocks)).cast("int").alias("block")
        names = F.array(*[F.lit(k).cast("int") for k in self._names])
        return F.get(names, F.pmod(F.xxhash64(key), F.lit(len(self._names))).cast("int")).alias("block")

    def dealt(self, docs: DataFrame) -> DataFrame:
        """(block, doc_id, text); rows of one id share a block."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return rows.select(self._block(F.coalesce("doc_id", F.xxhash64("text"))), "doc_id", "text")

    def counts(self, docs: DataFrame, ids: DataFrame | None) -> DataFrame:
        """The words and pairs of each block with its own counts, in a row for each bucket; without ids the counts are 0."""
        bits, learn, split = self.bits, ids is not None, self.split

        def run(key: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
            made = []
            if texts.num_rows:
                words, pairs, starts = _keys(texts.column("text"), split)
                n = np.diff(starts)
                wanted = np.isin(texts.column("doc_id").to_numpy(), marks.column("doc_id").to_numpy())
                own = np.concatenate((words, pairs, np.full(len(n), _START), np.full(len(n), _TOTAL)))
                full, target = (n > 0).astype(np.int32), np.repeat(wanted, n)
                everywhere = np.concatenate((np.ones(2 * len(words), np.int32), full, n.astype(np.int32)))
                del words, pairs
                distinct, _, (background, chosen) = _counted(own, everywhere, np.concatenate((target, target, full * wanted, n * wanted)))
                del own, target, everywhere
                edges = np.searchsorted(distinct, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(distinct)]
                for bucket in range(1 << bits):
                    i, j = edges[bucket], edges[bucket + 1]
                    steps = np.diff(distinct[i:j], prepend=np.uint64(bucket << (64 - bits)))
                    made.append((bucket, _pack(steps), _pack(background[i:j] * learn), _pack(chosen[i:j] * learn)))
            columns = list(zip(*made, strict=True)) or [[]] * 4
            return pa.table([pa.array(columns[0], pa.int32()), pa.array([key[0].as_py()] * len(made), pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", "block", "keys", "n_background", "n_target"])

        marks = ids if learn else self.ids.limit(0)
        return self.dealt(docs).groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(run, _ROWS)

    def totals(self, rows: DataFrame) -> DataFrame:
        """(block, bucket, n_background, n_target, vocabulary): the totals of the keys of each of rows, and the bucket's distinct words."""
        bits = self.bits

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            bucket = key[0].as_py()
            base = np.uint64(bucket << (64 - bits))
            read = [[_unpack(x) for x in rows.column(c).to_pylist()] for c in ("keys", "n_background", "n_target")]
            keys = np.concatenate([np.cumsum(x, dtype=np.uint64) + base for x in read[0]])
            distinct, place, sums = _counted(keys, np.concatenate(read[1]), np.concatenate(read[2]))
            seen = (sums[0] > 0) & (distinct & _PAIR == 0) & (distinct != _TOTAL) & (distinct != _START)
            blocks = rows.column("block").to_pylist()
            edges = np.concatenate(([0], np.cumsum([len(x) for x in read[0]])))
            made = [(block, *(_pack(s[place[edges[k] : edges[k + 1]]]) for s in sums)) for k, block in enumerate(blocks) if block is not None]
            columns = list(zip(*made, strict=True)) or [[]] * 3
            n = len(made)
            return pa.table(
                [pa.array(columns[0], pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary()), pa.array([int(seen.sum())] * n, pa.int64())],
                ["block", "bucket", "n_background", "n_target", "vocabulary"],
            )

        return rows.groupBy("bucket").applyInArrow(run, "block int, bucket int, n_background binary, n_target binary, vocabulary long")

    @cached_property
    def sizes(self) -> dict[str, tuple[int, int]]:
        """(tokens, documents with a word) of each model."""
        bits = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket, keys, *counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "n_background", "n_target")), strict=True):
                    own = np.cumsum(_unpack(keys), dtype=np.uint64) + np.uint64(bucket << (64 - bits))
                    sums = [int(_unpack(c)[own == k].sum()) for c in counts for k in (_TOTAL, _START)]
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()) for s in sums], ["a", "b", "c", "d"])

        special = [int(k >> np.uint64(64 - bits)) for k in (_TOTAL, _START)]
        r = self.counts(self.docs, self.ids).filter(F.col("bucket").isin(special)).mapInArrow(run, "a long, b long, c long, d long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "abcd"]).first()
        return {"background": (r["a"], r["b"]), "target": (r["c"], r["d"])}


class Model:
    """Frequencies of words and of pairs given the word before: one side of a corpus."""

    def __init__(self, corpus: Corpus, side: str) -> None:
        self.corpus, self.side = corpus, side

    @property
    def total(self) -> int:
        return self.corpus.sizes[self.side][0]

    @property
    def start(self) -> int:
        return self.corpus.sizes[self.side][1]


def losses(word: np.ndarray, context: np.ndarray, pair: np.ndarray, total: np.ndarray | int, vocabulary: int) -> np.ndarray:
    """The negative log likelihood of each word after the one before, from their counts."""
    alone = (word + 0.5) / (total + 0.5 * max(vocabulary, 1 << WORD_BITS))
    weight = np.where(context > 0, PAIR_WEIGHT, 0.0)
    return -np.log(weight * pair / np.maximum(context, 1) + (1 - weight) * alone)


def _within(codes: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """How often each code occurs in its own document; documents have n codes each, all below size."""
    _, place, times = np.unique(np.repeat(np.arange(len(n)), n) * size + codes, return_inverse=True, return_counts=True)
    return times.astype(np.int32)[place]


def train(docs: DataFrame, targets: DataFrame, marks: bool = False) -> tuple[Model, Model]:
    """(target, background) models; targets has the doc_ids of the target's documents.

    Words are white-space runs trimmed of punctuation; with marks the punctuation that is trimmed counts as words too.

    Documents without id are background only. Counting starts when documents are scored: only then
    is it known which blocks want which counts, and nothing of the corpus's size reaches the driver.
    """
    corpus = Corpus(docs, targets, marks)
    return Model(corpus, "target"), Model(corpus, "background")


def cross_entropy_difference(docs: DataFrame, target: Model, background: Model, leave_out: bool = False) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score for each document, repeated rows included.

    Losses are means per token in nats; score is background_loss - target_loss, so that documents
    like the target score higher. With leave_out each row of the models' own documents is scored by
    counts that lack it: all of its words, pairs, its start and its tokens, in the target too if it belongs there. A null text, or one without a word, has 0 tokens and zeros
    throughout. Both models come from one call of train. Other columns are ignored; an empty table gives no rows.
    """
    corpus = target.corpus
    if background.corpus is not corpus:
        raise ValueError("the models count different corpora and share no vocabulary")
    rows = corpus.counts(corpus.docs, corpus.ids)
    if not (docs is corpus.docs or docs.sameSemantics(corpus.docs)):
        if leave_out:
            raise ValueError("only the models' own documents can be left out of them")
        rows = rows.withColumn("block", F.lit(None).cast("int")).unionByName(corpus.counts(docs, None))
    split, sides = corpus.split, [f"n_{m.side}" for m in (target, background)]

    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        words, pairs, starts = _keys(texts.column("text"), split)
        n = np.diff(starts)
        marks = answers.column("doc_id").drop_null().to_numpy()
        answers = answers.filter(pc.is_valid(answers.column("bucket")))
        own, place = np.unique(np.concatenate((words, pairs, [_START, _TOTAL])), return_inverse=True)
        place = place.astype(np.int32)
        word, pair, (start, total) = place[: len(words)], place[len(words) : -2], place[-2:]
        del words, pairs
        if leave_out:
            wanted = np.isin(texts.column("doc_id").to_numpy(), marks)
            owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
            own_word, own_pair, own_start = _within(word, n, len(own)), _within(pair, n, len(own)), (n > 0).astype(np.int64)
            own_context = _before(own_word, starts, 0)
            firsts = starts[:-1][n > 0]
            own_context[firsts] = own_start[owner[firsts]]
        order = np.argsort(answers.column("bucket").to_numpy()).tolist()
        vocabulary, sums = int(answers.column("vocabulary").to_numpy().sum()), []
        for side in sides:
            packed = answers.column(side).to_pylist()
            counts = np.concatenate([np.zeros(0, np.uint64), *(_unpack(packed[k]) for k in order)]).astype(np.float64)
            if texts.num_rows and len(counts) != len(own):
                raise ValueError("the documents changed between counting and scoring")
            if not texts.num_rows:
                counts = np.zeros(len(own))
            seen, context, paired, tokens = counts[word], _before(counts[word], starts, counts[start]), counts[pair], counts[total]
            if leave_out:
                less = (wanted if side == "n_target" else np.ones(len(n), bool))[owner]
                seen, context, paired, tokens = seen - less * own_word, context - less * own_context, paired - less * own_pair, tokens - less * n[owner]
            loss = np.concatenate(([0.0], np.cumsum(losses(seen, context, paired, tokens, vocabulary))))
            sums.append((loss[starts[1:]] - loss[starts[:-1]]) / np.maximum(n, 1))
        return pa.table([texts.column("doc_id").cast(pa.int64()), pa.array(n), *(pa.array(s, pa.float64()) for s in sums)], ["doc_id", "n_tokens", "target_loss", "background_loss"])

    dealt, answers = corpus.dealt(docs), corpus.totals(rows).withColumn("doc_id", F.lit(None).cast("long"))
    if leave_out:
        answers = answers.unionByName(corpus.ids, allowMissingColumns=True)
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double")
    score = F.col("background_loss") - F.col("target_loss")
    return scored.select("doc_id", "n_tokens", F.round("target_loss", 9).alias("target_loss"), F.round("background_loss", 9).alias("background_loss"), F.round(score, 9).alias("score"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cross_entropy_difference(docs, *train(docs, table(spark, sf_dir, "labels").filter("quality = 1"), marks=True), leave_out=True)


QUERIES = {"op2_lm_score": op2_lm_score}
ORACLES: dict[str, str] = {}
