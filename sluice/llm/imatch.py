"""I-Match fingerprints: distinct terms of an inverse-document-frequency band, hashed over randomised lexicon subsets.

Everything is DataFrame expressions. The lexicon of the band reaches the rows as a bit map of fixed
size, a scalar subquery; a term whose hash meets another's bit counts as a lexicon term everywhere.
Each subset of the lexicon takes one residue class of other bits of the term's hash. Subsets of four
densities let short texts and long ones keep about one term in some of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import settle
from sluice.session import table

#: Bits of the lexicon's map (128 KB, which is copied beside each row that it tests).
MAP_BITS = 20
#: Randomised subsets of each density 1/64, 1/256, 1/1024 and 1/4096; the whole lexicon is one more.
PER_DENSITY, DENSITIES = 16, 4
#: Rows that one bucket of neighbours holds, about, and the most buckets there are.
BUCKET_ROWS, MOST_BUCKETS = 2000, 1 << 16
_FIRST = -(1 << 63)


def term_hashes(text: str) -> str:
    """SQL for the distinct hashed terms of a text: runs without white space or ASCII punctuation, in lower case."""
    return rf"array_distinct(transform(array_remove(split(lower({text}), '[\\s\\p{{Punct}}]+'), ''), w -> xxhash64(w)))"


def lexicon(docs: DataFrame, rarest: float, commonest: float) -> DataFrame:
    """(term, df): hashed terms held by a share of the documents between the two bounds.

    The terms of a share r or more are at most the mean number of distinct terms divided by r.
    """
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = texts.count()
    counts = texts.select(F.explode(F.expr(term_hashes("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counts.filter((F.col("df") >= max(2.0, total * rarest)) & (F.col("df") <= max(2.0, total * commonest)))


def bit_map(terms: DataFrame) -> DataFrame:
    """One row with the map as an array of longs: bit i is set if a term's lowest bits are i."""
    slot = F.col("term").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = terms.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    bits = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    spine = terms.sparkSession.range(1 << (MAP_BITS - 6)).withColumnRenamed("id", "word")
    full = spine.join(bits, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("map"))


def signature(text: str, known: Column) -> Column:
    """The hashes of the lexicon subsets of a text column, 0 for a subset without a term.

    A text without a term of the lexicon is taken by all its terms.
    """
    low = F.lit((1 << MAP_BITS) - 1)

    def inside(term: Column) -> Column:
        slot = term.bitwiseAND(low)
        return F.getbit(F.get(known, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1

    terms = F.expr(term_hashes(text))
    return F.transform(F.array(F.sort_array(F.filter(terms, inside))), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.sort_array(terms)))[0]


def subset_hashes(terms: str) -> Column:
    """The hash of all sorted terms and of each subset of them: the terms of a density first, then its classes."""
    groups = [f"array({terms})"]
    for g in range(DENSITIES):
        cls = f"(shiftrightunsigned(t, {24 + 10 * g}) & {(64 << (2 * g)) - 1})"
        own = f"filter({terms}, t -> {cls} < {PER_DENSITY})"
        groups.append(f"transform(array({own}), held -> transform(sequence(0, {PER_DENSITY - 1}), j -> filter(held, t -> {cls} = j)))[0]")
    return F.expr(f"transform(flatten(array({', '.join(groups)})), own -> if(size(own) = 0, 0L, xxhash64(own)))")


def likeness(a: str, b: str) -> Column:
    """Share of equal subset hashes among the subsets in which either text has a term; 1 if there are none."""
    both = f"zip_with({a}, {b}, (x, y) -> struct(x, y))"
    used = f"size(filter({both}, p -> p.x <> 0 or p.y <> 0))"
    same = f"size(filter({both}, p -> p.x = p.y and p.x <> 0))"
    return F.expr(f"if({used} = 0, 1.0D, cast({same} as double) / {used})")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key: a search in blocks of bounds, then inside one block."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    steps, all_bounds = F.lit(bounds[::step]), F.lit(bounds)
    block = F.size(F.filter(steps, lambda x: x <= key))
    inside = F.size(F.filter(F.slice(all_bounds, F.greatest(block - 1, F.lit(0)) * step + 1, F.lit(step)), lambda x: x <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside)


def with_next(docs: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Each row with next_<column> of the row that follows in ascending order; the last is followed by the first.

    Rows go to buckets of neighbouring keys, and the first row of each bucket goes to the one before
    as well, so the texts are shuffled once and no task sees more than a bucket.
    """
    keyed = docs.withColumn("__key", F.coalesce(F.col(order).cast("long"), F.lit(_FIRST)))
    n, least = keyed.agg(F.count("*"), F.min("__key")).first()
    buckets = min(MOST_BUCKETS, max(1, math.ceil(n / BUCKET_ROWS)))
    cuts = [k / buckets for k in range(1, buckets)]
    bounds: list[int] = []
    if cuts:
        bounds = sorted(set(keyed.agg(F.percentile_approx("__key", cuts, min(2_000_000, 20 * buckets)).alias("b")).first()["b"]) - {least})
    own = _bucket(F.col("__key"), bounds)
    opens = F.get(F.lit(bounds or [_FIRST]), own - 1) == F.col("__key")  # the first of its bucket
    before = F.when((own > 0) & opens, F.struct((own - 1).alias("bucket"), F.lit(1).alias("guest")))
    around = F.when(F.col("__key") == F.lit(least), F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(2).alias("guest")))
    homes = F.filter(F.array(F.struct(own.alias("bucket"), F.lit(0).alias("guest")), before, around), lambda x: x.isNotNull())
    spread = keyed.withColumn("__home", F.explode(homes))
    window = W.partitionBy("__home.bucket").orderBy((F.col("__home.guest") == 2).cast("int"), "__key", *columns)
    led = spread.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return led.filter("__home.guest = 0").drop("__home", "__key")


def fingerprints(docs: DataFrame, rarest: float = 1 / 1000, commonest: float = 1 / 10) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for each document.

    A null text is empty. Repeated ids follow each other by their texts; a null id comes before all
    others; a document alone is its own next one. n_chars is counted, whatever the table says. Equal
    texts have equal fingerprints. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = settle(bit_map(lexicon(docs, rarest, commonest)), "lexicon").scalar()

    def signed(df: DataFrame, text: str, name: str) -> DataFrame:
        marked = df.withColumn("__map", known).withColumn("__terms", signature(text, F.col("__map")))
        return marked.withColumn(name, subset_hashes("__terms")).drop("__terms", "__map")

    own = signed(texts, "text", "sig")
    led = with_next(own, "doc_id", ["text", "sig"])
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = led.select(
        "doc_id", "sig", "next_sig", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited")
    )
    both = signed(edited, "edited", "edited_sig")

    def shown(sig: str) -> Column:
        return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")

    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown("sig").alias("fingerprint"), shown("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"),
    )


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op9_imatch": op9_imatch}
ORACLES: dict[str, str] = {}
