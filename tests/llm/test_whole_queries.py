"""Registered queries whose results no SQL gives, against brute force over whole small tables."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import common, registry, toxicity

QUERIES = registry.queries()


def _words(text: str | None) -> list[str]:
    """White-space runs in lower case without the punctuation around them, of which nothing may be left."""
    return [w for w in (x.strip(common.PUNCTUATION) for x in (text or "").lower().split()) if w]


def _best_alignment(doc: np.ndarray, item: np.ndarray) -> int:
    """The best score of a local alignment: 2 for a word in both, -1 for another or a gap; cell by cell down the item, in rows along the document."""
    row, best = np.zeros(len(doc) + 1, np.int64), 0
    for word in item:
        fresh = np.maximum(0, np.maximum(row[:-1] + np.where(doc == word, 2, -1), row[1:] - 1))
        out = np.zeros_like(row)
        run = 0
        if fresh.any():
            # A gap in the document costs one a word, so a cell is the largest of those before it less their distance.
            steps = np.arange(1, len(row))
            out[1:] = np.maximum(fresh, np.maximum.accumulate(fresh + steps) - steps)
            run = int(out.max())
        row, best = out, max(best, run)
    return best


def _may_score(doc: np.ndarray, item: np.ndarray, least: float) -> bool:
    """False only if no alignment can score so much: it has that share of the item's words in a stretch of 2.2 times its length at most, since gaps cost what matches bring."""
    width = int(2.2 * len(item)) + 1
    inside = np.concatenate(([0], np.cumsum(np.isin(doc, item))))
    return len(doc) > 0 and (inside[np.minimum(np.arange(len(doc)) + width, len(doc))] - inside[:-1]).max() >= least * len(item)


def test_contamination_against_all_pairs(spark, sf):
    """Every document is aligned with every test item; what the query finds is exactly what scores 0.4 or more of the item's best."""
    docs = {r["doc_id"]: _words(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: _words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    codes: dict[str, int] = {}
    number = lambda words: np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    docs, items = {k: number(v) for k, v in docs.items()}, {k: number(v) for k, v in items.items()}
    wanted = {}
    for doc_id, doc in docs.items():
        for item_id, item in items.items():
            if len(item) >= 3 and _may_score(doc, item, 0.4):
                score = _best_alignment(doc, item) / (2 * len(item))
                if score >= 0.4:
                    wanted[doc_id, item_id] = round(score, 6)
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in QUERIES["op10_decontaminate"](spark, sf).collect()}
    assert found == pytest.approx(wanted) and wanted


def test_toxicity_scores_against_a_plain_fold(spark, sf):
    """The query's scores are those of a model fitted here on the same rows, a document's being its worst piece's on the logistic curve."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic in (0, 1)").collect()}
    held_out = lambda doc_id: zlib.crc32(str(doc_id).encode()) % 5 == 0
    fitted = [(text, labels[k]) for k, text in docs if k in labels and not held_out(k) and len(text or "") <= 20_000]
    model = toxicity.fit([t for t, _ in fitted], [y for _, y in fitted])
    encode, wanted = toxicity.Encoder(), {}
    for doc_id, text in docs:
        distinct, codes, _ = toxicity.units(pa.array([text or ""], pa.string()))
        rows, _ = encode([distinct[c] for c in sorted(set(codes.tolist()))])
        margin = model.margins(rows).max() if len(rows) else None
        wanted[doc_id] = (held_out(doc_id), margin)
    found = QUERIES["op5_toxicity"](spark, sf).collect()
    assert len(found) == len(docs)
    plain = min(r["score"] for r in found)
    for r in found:
        out, margin = wanted[r["doc_id"]]
        score = plain if margin is None else 1 / (1 + np.exp(-(model.slope * margin + model.offset)))
        assert r["held_out"] == out and r["predicted"] == int(r["score"] >= 0.5)
        assert r["score"] == pytest.approx(score, abs=1e-4), r["doc_id"]
