"""Canonical names of channels, systems and countries, dimension filters and sampling ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(name: Column) -> Column:
    """release, beta, aurora, nightly or esr by prefix, else Other."""
    low = F.lower(name)
    out = F.lit("Other")
    for known in ("esr", "nightly", "aurora", "beta", "release"):
        out = F.when(low.startswith(known), known).otherwise(out)
    return out


def system(name: Column) -> Column:
    """Windows, Mac or Linux found anywhere in the name, else Other."""
    low = F.lower(name)
    return F.when(low.contains("mac") | low.contains("darwin"), "Mac").when(low.contains("win"), "Windows").when(low.contains("linux") | low.contains("bsd"), "Linux").otherwise("Other")


def country(code: Column) -> Column:
    """Two letters in upper case, else Other."""
    return F.when(code.rlike("^[A-Za-z]{2}$"), F.upper(code)).otherwise("Other")


def dimension(value: Column, allowed: list | None = None, low: object = None, high: object = None, missing: str = "UNKNOWN") -> Column:
    """The value as text if it is allowed, OTHER if it isn't, `missing` if there is none."""
    fits = F.lit(True)
    if allowed is not None:
        fits = value.isin(allowed)
    if low is not None:
        fits = value.between(low, high)
    return F.when(value.isNull(), missing).when(fits, value.cast("string")).otherwise("OTHER")


def sample_id(identity: Column) -> Column:
    """crc32 of the id, modulo 100."""
    return (F.crc32(identity.cast("string").cast("binary")) % 100).cast("int")


def bounded(value: Column, kind: str, default: object) -> Column:
    """A cast that falls back where the text doesn't fit the type."""
    return F.coalesce(value.try_cast(kind), F.lit(default).cast(kind))


def printable(value: Column) -> Column:
    """Everything but printable ASCII becomes a question mark."""
    return F.regexp_replace(value, r"[^\x20-\x7e]", "?")
