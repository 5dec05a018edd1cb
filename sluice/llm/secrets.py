"""Secrets in text: three fixed patterns, and credential values that are hard to guess.

The patterns give the base spans. Beside them, every value that follows a credential word is cut
into words, dates, repeats, keyboard walks and brute-force characters at the least total guess
cost; a value whose cost reaches the threshold is added as a span of kind `guess`, whether or not
a base span holds it. The words are an attacker's dictionary: the corpus's most frequent words, as
Spark counts them over all documents, after a short list of common password words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import release, settle, slices, word_codes
from sluice.session import table

KINDS = ("assign", "access", "hex", "guess")
SPANS = "array<struct<kind:string,start:long,end:long,log10_guesses:double>>"
#: Values of so many guesses (as a power of ten) or more are secrets.
THRESHOLD = 10.0
#: Words of the attacker's dictionary that come from the corpus; what reaches driver and tasks is bounded by them.
DICTIONARY = 30_000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
_CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private)[_-]?key|credentials?|bearer|auth)["']?[\x20\t]*[:=][\x20\t]*["']?([^\s"'<>,;]{8,})""", re.I | re.A)
_CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")

#: Common password words, most common first; a word's guess cost is its rank.
WORDS = (
    "password", "admin", "welcome", "login", "letmein", "monkey", "dragon", "master", "hello", "freedom", "secret", "shadow",
    "sunshine", "princess", "football", "baseball", "superman", "batman", "trustno", "iloveyou", "love", "summer", "winter",
    "spring", "autumn", "test", "guest", "user", "root", "default", "changeme", "pass", "passwd", "token", "key", "api", "access",
    "server", "service", "database", "example", "sample", "demo", "temp", "public", "private", "company", "office", "computer",
    "internet", "the", "and", "you", "house", "horse", "correct", "battery", "staple", "blue", "green", "red", "black", "white",
    "january", "february", "march", "april", "june", "july", "august", "october", "november", "december", "monday", "friday",
)
#: Letters of a dictionary word.
SHORTEST, LONGEST = 3, 24
#: Characters of a unit that a repeat repeats.
UNIT = 16
#: Characters that one run of the programme covers; a longer value is the sum of its windows.
WINDOW = 512
_LEET = str.maketrans("0134578@$", "oleastbas")
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_KEYS = {c: (r, k) for r, row in enumerate(_ROWS) for k, c in enumerate(row)}
_NEXT = {a: {b for b, (r, k) in _KEYS.items() if b != a and abs(r - y) <= 1 and abs(k - x) <= 1} for a, (y, x) in _KEYS.items()}
#: (pattern, log10 of the dates that it can write).
_DATES = (
    (re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"), math.log10(366 * 120)),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d"), math.log10(366 * 120)),
    (re.compile(r"(?:19|20)\d\d"), math.log10(120)),
)
#: Each further segment of a guess doubles the ways to put the segments together.
_JOIN = math.log10(2)


class Guesser:
    """Least guess costs, as powers of ten, with a dictionary of words, most common first."""

    def __init__(self, words: Iterable[str] = ()) -> None:
        self.ranks: dict[str, float] = {}
        for word in (*WORDS, *words):
            if word not in self.ranks:
                self.ranks[word] = math.log10(len(self.ranks) + 2)
        self.window = lru_cache(maxsize=20_000)(self._window)

    def __reduce__(self) -> tuple:
        return Guesser, (tuple(self.ranks),)

    def matches(self, value: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, cost) of every word, date, repeat and walk, wherever it starts and ends."""
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)  # as many characters as the value
        plain = low.translate(_LEET)
        size, ranks = len(value), self.ranks
        for i in range(size):
            for j in range(i + SHORTEST, min(size, i + LONGEST) + 1):
                if (rank := ranks.get(low[i:j])) is not None:
                    yield i, j, rank + (0.0 if value[i:j] == low[i:j] else _JOIN)
                elif (rank := ranks.get(plain[i:j])) is not None:
                    yield i, j, rank + 2 * _JOIN
            for pattern, cost in _DATES:
                if m := pattern.match(low, i):
                    yield i, m.end(), cost
            j = i + 1
            while j < size and low[j] in _NEXT.get(low[j - 1], ()):
                j += 1
                if j - i >= 4:
                    yield i, j, math.log10(47 * (j - i)) + 0.4 * (j - i)
            for unit in range(1, min(UNIT, (size - i) // 2) + 1):
                own, j = value[i : i + unit], i + unit
                cost = None
                while value.startswith(own, j):
                    j += unit
                    if cost is None:
                        cost = self.window(own)
                    yield i, j, cost + math.log10((j - i) // unit)

    def _window(self, value: str) -> float:
        ends: dict[int, list[tuple[int, float]]] = {}
        for i, j, cost in self.matches(value):
            ends.setdefault(j, []).append((i, cost))
        # Least cost of the first k characters, ended by a match and ended by brute force.
        matched, brute = [0.0], [math.inf]
        for k in range(1, len(value) + 1):
            brute.append(min(brute[k - 1] + 1.0, matched[k - 1] + 1.0 + (_JOIN if k > 1 else 0.0)))
            best = math.inf
            for i, cost in ends.get(k, ()):
                best = min(best, min(matched[i], brute[i]) + cost + (_JOIN if i else 0.0))
            matched.append(best)
        return min(matched[-1], brute[-1])

    def log10_guesses(self, value: str) -> float:
        """Least cost over all segmentations: brute force costs one digit a character, each further segment a factor of two.

        A value longer than WINDOW characters is cut there, and costs what its windows cost.
        """
        if not value:
            return 0.0
        parts = [value[k : k + WINDOW] for k in range(0, len(value), WINDOW)]
        return sum(map(self.window, parts)) + _JOIN * (len(parts) - 1)


def secret_spans(text: str | None, guesser: Guesser, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, cost) of all spans of one text by start, then kind; offsets are code points, ends exclusive.

    The cost is that of the value: what an assign span assigns, the whole of any other span.
    """
    if not text:
        return []
    low, cost = text.lower(), guesser.log10_guesses
    found: list[tuple[str, int, int, float]] = []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end(), cost(m[2])) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), cost(m[0])) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), cost(m[0])) for m in _HEX.finditer(text)]
    if any(w in low for w in _CONTEXT_WORDS):
        found += [("guess", *m.span(1), dear) for m in _CONTEXT.finditer(text) if (dear := cost(m[1])) >= threshold]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def dictionary(docs: DataFrame, words: int = DICTIONARY) -> list[str]:
    """The corpus's most frequent words of SHORTEST to LONGEST letters, counted over all documents; ties by the word.

    Words are white-space runs in lower case, trimmed of punctuation, that hold letters only. At most `words` words reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: dict[str, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: dict[str, int] = {}
        for batch in batches:
            for texts in slices(batch.column(0)):
                distinct, codes, _ = word_codes(texts)
                for word, n in zip(distinct, np.bincount(codes, minlength=len(distinct)).tolist(), strict=True):
                    if SHORTEST <= len(word) <= LONGEST and word.isalpha():
                        held[word] = held.get(word, 0) + n
                if len(held) > 200_000:
                    yield made(held)
                    held = {}
        yield made(held)

    made = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    counts = settle(made.groupBy("word").agg(F.sum("n").alias("n")), "words")
    # Words of about one frequency are counted first, so that tasks sort hardly more words than are wanted.
    band = F.floor(F.log2("n") * 16)
    kept, least = 0, 0
    for r in sorted(counts.groupBy(band.alias("band")).count().collect(), key=lambda r: -r["band"]):
        kept, least = kept + r["count"], r["band"]
        if kept >= words:
            break
    top = counts.filter(band >= least).orderBy(F.desc("n"), "word").limit(words).select("word").collect()
    release(counts)
    return [r["word"] for r in top]


def spans_column(spark: SparkSession, text: Column, words: list[str], threshold: float = THRESHOLD) -> Column:
    """The spans of a text column as an array of structs; a null text has none."""
    sent = spark.sparkContext.broadcast(words)

    @F.arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        guesser = Guesser(sent.value)
        for texts in batches:
            made = [secret_spans(x, guesser, threshold) for part in slices(texts) for x in part.to_pylist()]
            yield pa.array(
                [[{"kind": k, "start": a, "end": b, "log10_guesses": round(g, 6)} for k, a, b, g in x] for x in made],
                pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())])),
            )

    return scan.asNondeterministic()(text.cast("string"))


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD, words: list[str] | None = None) -> DataFrame:
    """doc_id and the array of its secret spans (kind, start, end, log10_guesses).

    Without words the dictionary is that of these documents. Null and empty texts have an empty
    array, repeated rows each get a row, an empty table gives none; other columns are ignored.
    """
    known = dictionary(docs) if words is None else words
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), spans_column(docs.sparkSession, F.col("text"), known, threshold).alias("found"))


def redact(docs: DataFrame, threshold: float = THRESHOLD, words: list[str] | None = None) -> DataFrame:
    """The documents with every span replaced by `[secret]` (overlapping spans by one) and n_chars counted anew.

    Without words the dictionary is that of these documents. All rows and all other columns stay; a null text stays null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dictionary(docs) if words is None else words)

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        guesser = Guesser(sent.value)
        for texts in batches:
            made = []
            for part in slices(texts):
                for text in part.to_pylist():
                    at, kept = 0, []
                    for _, start, end, _ in secret_spans(text, guesser, threshold):
                        if start >= at:
                            kept += [text[at:start], "[secret]"]
                        at = max(at, end)
                    made.append("".join([*kept, text[at:]]) if kept else text)
            yield pa.array(made, pa.string())

    cleaned = docs.withColumn("text", clean.asNondeterministic()(F.col("text").cast("string")))
    counted = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
    return counted.select(*docs.columns)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"] != "guess")
    costs = F.array_join(F.transform("found", lambda s: F.format_string("%.1f", s["log10_guesses"])), ",")
    return found.select("doc_id", *[count(k) for k in KINDS[:-1]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), count("guess"), costs.alias("log10_guesses"))


QUERIES = {"op1_secrets": op1_secrets}
ORACLES: dict[str, str] = {}
