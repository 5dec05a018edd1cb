"""The queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import collocations, decontaminate, imatch, langid, linededup, lmscore, mixing, secrets, simhash, toxicity, urlfilter, warc, whitening

MODULES = (secrets, lmscore, simhash, mixing, toxicity, langid, warc, urlfilter, imatch, decontaminate, collocations, linededup, whitening)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
