"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language. A word that no language knows falls
back to its character n-grams: the longest length of which any n-gram is known decides. The model
is counted by Spark over a bounded sample of labelled rows: at most about `per_lang` documents, of `longest`
characters at most, of each of the `langs` most frequent languages. All of the sample's words and
n-grams count that it holds twice or more; the bounds of the sample bound the model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import fold, release, settle, slices
from sluice.session import table

UNKNOWN = "und"
#: Character n-grams that an unseen word falls back to, longest first; 0 stands for whole words.
LENGTHS = (4, 3, 2, 1)
#: Words held in a task's cache before it starts anew.
_CACHE = 200_000
_LETTERS = regex.compile(r"\p{L}+")


def _grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if len(marked) >= n else []


def sample_labelled(docs: DataFrame, per_lang: int, longest: int = 20_000, langs: int = 200) -> DataFrame:
    """(lang, text) of about per_lang documents of each language, chosen by a hash of the id.

    The bound holds in expectation: each language is thinned to per_lang over its row count.
    """
    known = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null").filter(fold(F.col("doc_id")) != 0).filter(F.char_length("text") <= longest)
    share = known.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(langs).select("lang", (F.lit(float(per_lang)) / F.col("rows")).alias("share"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    largest = float(share.agg(F.max("share")).first()[0] or 0.0)  # lets the scan of the texts skip most rows
    return known.filter(draw < largest).join(share, "lang").filter(draw < F.col("share")).select("lang", "text")


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, kind, gram, n): how often each word (kind 0) and character n-gram occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(_LETTERS.findall(text.lower()))
        for lang, found in words.items():
            for kind in (0, *LENGTHS):
                made = found
                if kind:
                    made = Counter()
                    for word, n in found.items():
                        for gram in _grams(word, kind):
                            made[gram] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(made), pa.string()), pa.array([kind] * len(made), pa.int32()), pa.array(list(made), pa.string()), pa.array(list(made.values()), pa.int64())],
                    ["lang", "kind", "gram", "n"],
                )

    made = sample.mapInArrow(run, "lang string, kind int, gram string, n long")
    return made.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies by language: a table with a row for each word and n-gram; row 0 is all zeros."""

    def __init__(self, langs: list[str], rows: list[tuple[str, int, str, int, int]]) -> None:
        """rows: (lang, kind, gram, n, total of that language and kind)."""
        self.langs = langs
        at = {x: k for k, x in enumerate(langs)}
        self.index: dict[int, dict[str, int]] = {k: {} for k in (0, *LENGTHS)}
        kinds = [0]
        for _, kind, gram, _, _ in rows:
            if gram not in self.index[kind]:
                self.index[kind][gram] = len(kinds)
                kinds.append(kind)
        totals = {(lang, kind): total for lang, kind, _, _, total in rows}
        floors = {kind: [np.log(0.5 / max(totals.get((x, kind), 1), 1)) for x in langs] for kind in self.index}
        self.table = np.array([floors[k] for k in kinds], np.float32).reshape(len(kinds), len(langs))
        self.table[0] = 0.0
        for lang, kind, gram, n, total in rows:
            self.table[self.index[kind][gram], at[lang]] = np.log(n / total)

    def rows_of(self, word: str) -> list[int]:
        """The table's rows that speak for a word: its own, else those of its longest known n-grams, else row 0."""
        own = self.index[0].get(word)
        if own is not None:
            return [own]
        if word:
            marked = f"^{word}$"
            for n in LENGTHS:
                index = self.index[n]
                known = [k for i in range(len(marked) - n + 1) if (k := index.get(marked[i : i + n])) is not None]
                if known:
                    return known
        return [0]

    def vectors(self, words: list[str]) -> np.ndarray:
        """Relative log likelihood of each word in each language: the mean of its rows, at most zero."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        found = [self.rows_of(w) for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((k for own in found for k in own), np.int64, int(counts.sum()))
        means = np.add.reduceat(self.table[flat], np.cumsum(counts) - counts, axis=0) / counts[:, None]
        return means - means.max(axis=1, keepdims=True) if len(self.langs) else means


def train(docs: DataFrame, per_lang: int = 1500, longest: int = 20_000, langs: int = 200) -> Model:
    """Count a bounded sample; words and n-grams that it holds once only go into the totals."""
    counts = settle(gram_counts(sample_labelled(docs, per_lang, longest, langs)), "grams")
    totals = {(r["lang"], r["kind"]): r["total"] for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("total")).collect()}
    kept = counts.filter("n > 1").orderBy("lang", "kind", "gram").toArrow()
    release(counts)
    rows = [(lang, kind, gram, n, totals[lang, kind]) for lang, kind, gram, n in zip(*(kept.column(c).to_pylist() for c in ("lang", "kind", "gram", "n")), strict=True)]
    return Model(sorted({lang for lang, _ in totals}), rows)


class Judge:
    """Scores Arrow arrays of texts; keeps the vectors of the words that it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.width = model, len(model.langs)
        self.names = np.array([*model.langs, UNKNOWN], object)
        self.cache: dict[str, int] = {}
        self.vectors = np.zeros((1024, max(self.width, 1)), np.float32)

    def _places(self, words: list[str]) -> np.ndarray:
        if len(self.cache) + len(words) > _CACHE:
            self.cache.clear()
        cache, base = self.cache, len(self.cache)
        new = [w for w in words if w not in cache]
        cache.update(zip(new, range(base, base + len(new)), strict=True))
        while len(self.vectors) < len(cache):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[base : base + len(new), : self.width] = self.model.vectors(new)
        return np.fromiter(map(cache.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The predicted language and its probability for each text."""
        if not len(texts):
            return [], np.zeros(0)
        parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+")
        flat, starts = parts.flatten(), parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        coded = flat.dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        place = self._places(words)
        sums = np.add.reduceat(self.vectors[place[codes]], starts, axis=0, dtype=np.float64)
        letters = np.add.reduceat(np.array([bool(x) for x in words])[codes], starts, dtype=np.int64)
        spread = sums - sums.max(axis=1, keepdims=True)
        # Neighbouring words aren't independent: the evidence of long texts is tempered.
        sure = 1.0 / np.exp(spread / np.maximum(1.0, letters / 20.0)[:, None]).sum(axis=1)
        said = (letters > 0) & (self.width > 0)
        return self.names[np.where(said, sums.argmax(axis=1), self.width)].tolist(), np.where(said, sure, 0.0)


def verdict(spark: SparkSession, model: Model, text: Column) -> Column:
    """A struct (lang_pred, score) for a text column, made batch by batch in Arrow."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judged = Judge(sent.value)
        for texts in batches:
            made = [judged(x) for x in slices(texts)]
            names, scores = [n for x in made for n in x[0]], [s for x in made for s in x[1]]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return judge.asNondeterministic()(text.cast("string"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each document.

    lang_pred is `und` and score 0 where the text is null or has no letter, or where the model
    knows no language. Ties go to the language that sorts first. Repeated rows each get a row;
    an empty table gives none. Other columns are ignored.
    """
    chosen = docs.select("doc_id", verdict(docs.sparkSession, model, F.col("text")).alias("said"))
    return chosen.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), "said.lang_pred", "said.score")


def drop_unidentified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, with their own columns, whose language is found with at least that score; `und` goes."""
    names = docs.columns
    rows = docs.select(F.struct(*[docs[x] for x in names]).alias("row"), verdict(docs.sparkSession, model, F.col("text")).alias("said"))
    return rows.filter((F.col("said.lang_pred") != UNKNOWN) & (F.col("said.score") >= least)).select("row.*")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
