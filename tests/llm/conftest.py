"""Small tables for the corpus operators."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as extra columns of the input.
CLASHES = ("bits", "id", "said", "row", "component", "weight", "topic", "words", "seed", "n", "tokens", "__key", "label")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing extra columns."""
    from pyspark.sql import functions as F

    long = "the quick brown fox jumps over the lazy dog and runs far away " * 3000
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 44), (1, "the cat sat on the mat and looked at the dog", "en", "a", 44), (2, None, None, None, None),
        (3, "", "en", "a", 0), (4, " \n\t ", "en", None, 4), (5, long, "en", "b", len(long)), (None, "a text without an id that is long enough to be read", None, "a", 5), (6, "1234 ++ 5678", "de", "b", 12),
        (7, "der Hund und die Katze sind im Haus und der Garten ist groß", "de", "b", 60), (8, "\U0001f600 é \u00a0 x", "fr", "c", 7),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(7) for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
