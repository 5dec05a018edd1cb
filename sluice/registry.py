"""All registered queries outside the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.plans import catalogues, ci, decoders, doctypes, documents, formats, ingest, logrules, logs, monitors, programs, security, series, sources, streams, structures, summaries, telemetry, transport, writes

CASES = [m.CASES for m in (monitors, series, structures, logs, telemetry, security, ci, formats, programs, ingest, streams, doctypes, decoders, sources, transport, summaries, documents, writes, catalogues, logrules)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for cases in CASES for name, query in cases.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for cases in CASES for name, sql in cases.oracles.items()}
