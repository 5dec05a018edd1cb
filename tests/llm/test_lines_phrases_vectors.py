"""Repeated lines, collocations and whitening against plain Python, on odd input and with planted cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sluice.llm import collocations, linededup, registry, whitening

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- repeated lines


def _plain_lines(rows, least=3, shortest=20):
    """(doc_id, text, n_lines, n_dropped) of (doc_id, text) rows."""
    key = lambda line: line.strip(" \t\n\v\f\r").translate(ASCII_LOWER)
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= shortest:
                held[key(line)].add(doc_id)
    keeper = {k: max(ids) for k, ids in held.items() if len(ids) >= least}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc_id is None or keeper.get(key(x), doc_id) == doc_id]
        out.append((doc_id, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return Counter(out)


def _line_rows():
    make = random.Random(5)
    pool = [" ".join(make.choice(["Alpha", "beta", "ÄÖ", "gamma", "x"]) for _ in range(make.randint(1, 9))) for _ in range(60)]
    rows = [(k, "\n".join(make.choice([" ", "", "\t"]) + make.choice(pool).swapcase() + make.choice(["", " \r", "\v"]) for _ in range(make.randint(0, 12)))) for k in range(80)]
    rows += rows[:3]  # repeated rows
    rows += [(3, "A line that is in no other place at all\n" + pool[0]), (90, None), (91, ""), (92, "\n\n"), (None, pool[1] + "\n" + pool[1]), (None, None)]
    return rows + [(93, "the same long line stands here again and again\n" * 3000), (94, "THE same long line stands here again and again"), (95, "the same long line stands here again and again  ")]


@pytest.mark.parametrize("bits", [linededup.MOST_BITS, 3, 10])
def test_lines_against_plain_python(spark, bits, monkeypatch):
    """A filter that is far too small suspects all lines; the result is the same."""
    monkeypatch.setattr(linededup, "LEAST_BITS", min(bits, linededup.LEAST_BITS))
    rows = _line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS drops", "2 AS n_lines", "3 AS `key`").repartition(5)
    got = linededup.drop_repeated_lines(docs, most_bits=bits).collect()
    assert Counter(map(tuple, got)) == _plain_lines(rows)
    assert max(r["n_dropped"] for r in got) == 3000


def test_two_documents_may_share_a_line(spark):
    line = "this line has more than twenty characters"
    docs = spark.createDataFrame([(1, line), (2, line)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in linededup.drop_repeated_lines(docs).collect()} == {1: 0, 2: 0}
    assert {r["doc_id"]: r["n_dropped"] for r in linededup.drop_repeated_lines(docs, least=2).collect()} == {1: 1, 2: 0}
    assert linededup.drop_repeated_lines(docs.limit(0)).collect() == []


def test_filters_suspect_few_lines(spark):
    """Of lines that differ everywhere at most one in forty is suspected; repeated ones always are."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('a line of its own, with number ', id, '\n', 'this line is in all of the documents') AS text").repartition(7)
    bits = linededup.filter_bits(docs)
    twice = spark.sparkContext.broadcast(linededup.twice_seen(docs, bits, 20))
    found = linededup.suspects(docs.selectExpr("doc_id", "doc_id AS row", "text"), bits, twice, 20)
    by_key = sorted((r["count"] for r in found.groupBy("key").count().collect()), reverse=True)
    assert by_key[0] == 4000 and len(by_key) < 100


# --- collocations


def _plain_phrases(rows, least, longest, most=2000):
    """The contract's report of (lang, text) rows, in exact whole numbers."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(ASCII_LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) >= 2}
        around = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], a)
        report = []
        for p, a in found.items():
            if p in around and 100 * around[p] >= 50 * a:
                continue
            score, _, cut = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, k) for k in range(1, len(p)))
            report.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(report)[:most], 1)]
    return out


def _phrase_rows():
    make = random.Random(9)
    words = ["New", "york", "çity", "of", "the", "a.b", "x", "Zürich see", "\x00", "ß", "of"]
    texts = ["".join(make.choice(words) + make.choice([" ", " ", " ", "\t", ", ", "\n", " . ", "  "]) for _ in range(make.randint(0, 60))) for _ in range(150)]
    rows = [(k, make.choice(["en", "de", None]), t) for k, t in enumerate(texts)] + [(None, "en", texts[0]), (1, "en", texts[1]), (1, "en", texts[1]), (200, None, None), (201, "fr", ""), (202, "de", " \t ")]
    return rows + [(203, "en", "over and over again " * 4000)]


@pytest.mark.parametrize(("sample", "longest"), [(4, 3), (1, 3), (10**9, 3), (3, 5)])
def test_phrases_against_plain_python(spark, sample, longest):
    """However poor the sample, even an empty one, the passes over its border find all."""
    rows = _phrase_rows()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "1 AS k", "2 AS n", "'p' AS phrase", "0 AS id").repartition(6)
    found = collocations.frequent_phrases(docs, 4, longest, sample)
    got = [tuple(r) for r in collocations.collocations(found).collect()]
    assert sorted(got) == sorted(_plain_phrases([r[1:] for r in rows], 4, longest)) and len(got) > 50


def test_phrases_of_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations.frequent_phrases(none).collect() == [] and collocations.collocations(collocations.frequent_phrases(none)).collect() == []


def test_scores_pass_64_bits_and_ranks_break_ties_by_bytes(spark):
    big = 3 * 10**12
    rows = [("en", "", 0, 10**14), ("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "é", 1, big), ("en", "z", 1, big), ("en", "a b", 2, big - 1), ("en", "a é", 2, 10), ("en", "a z", 2, 10), ("en", "z z", 2, 10)]
    found = spark.createDataFrame(rows, "lang string, phrase string, k int, n long")
    got = [(r["phrase"], r["rank"], r["score"]) for r in collocations.collocations(found).orderBy("rank").collect()]
    assert got == [("a b", 1, 1_000_000 * (big - 1) ** 2 // (big * (big + 1))), ("a z", 2, 0), ("a é", 3, 0), ("z z", 4, 0)]
    assert [r["phrase"] for r in collocations.collocations(found, most=2).orderBy("rank").collect()] == ["a b", "a z"]


# --- whitening


def _vectors():
    make = np.random.default_rng(3)
    base = (make.normal(size=(40, 6)) @ make.normal(size=(6, 6))).astype(np.float32)
    return [(k, base[k % 40 if k < 120 else 0].tolist()) for k in range(300)]  # one vector has more than half of all rows


def _spoiled():
    return [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5), (1004, [1.0, 2.0]), (1005, [])]


def _plain_whitening(rows, most=8):
    x = np.floor(1024 * np.array([v for _, v in rows], float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    around = (n * x - sums) / n
    values, axes = np.linalg.eigh(around.T @ around / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(axis=1), around @ axes[:, :most] / np.sqrt(values[:most]), values[:most] / values.sum()


def test_whitening_against_plain_python(spark):
    rows = _vectors()
    vectors = spark.createDataFrame(rows + _spoiled(), "vec_id long, embedding array<float>").selectExpr("*", "7 AS x", "8 AS n", "9 AS z", "10 AS w", "'l' AS label").repartition(5)
    made = whitening.whiten(vectors)
    assert {"vec_id", "label", "z", "n"} <= set(made.columns)
    got = sorted(whitening.by_component(made, "vec_id").collect(), key=lambda r: (r["vec_id"], r["component"]))
    n, deviation, z, explained = _plain_whitening(rows)
    assert len(got) == 6 * n and {r["n"] for r in got} == {n}
    assert [r["deviation"] for r in got] == np.repeat(deviation, 6).tolist()
    mine = np.array([r["whitened"] for r in got]).reshape(n, 6)
    assert np.abs(mine * np.sign((mine * z).sum(axis=0)) - z).max() < 1e-9
    assert np.allclose([r["explained"] for r in got[:6]], explained, rtol=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10
    own = np.cov(mine.T, bias=True)
    assert abs(np.abs(own - np.eye(6)).max() - got[0]["identity_error"]) < 1e-10


def test_fit_weights_of_one_count_distinct_vectors(spark):
    rows = _vectors()
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    once = list({tuple(v): (k, v) for k, v in rows}.values())
    _, _, z, explained = _plain_whitening(once)
    made = {r["vec_id"]: r for r in whitening.whiten(vectors, weights="one").collect()}
    assert made[0]["n"] == 40 and np.allclose(made[0]["explained"], explained, rtol=1e-9)
    assert np.allclose(np.abs([made[k]["z"] for k, _ in once]), np.abs(z), atol=1e-9)


def test_vectors_without_variance_and_large_ones(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], kind)).collect()
    assert [(r["z"], r["deviation"], r["n"]) for r in one] == [([], 0, 3)] * 3
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], kind)).collect()
    assert {len(r["z"]) for r in flat} == {1}
    huge = sorted(whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.5, 0.0])], kind)).collect(), key=lambda r: r["vec_id"])
    assert [(r["deviation"], len(r["z"])) for r in huge][:2] == [(None, 1)] * 2  # the second direction is below what doubles resolve
    wide = whitening.whiten(spark.createDataFrame([(1, [1e4]), (2, [-1e4]), (2, [1e4])], kind)).collect()
    x = [10_240_000 + 100_000, -10_240_000 + 100_000, 10_240_000 + 100_000]
    assert sorted(r["deviation"] for r in wide) == sorted((3 * v - sum(x)) ** 2 for v in x)


def test_whitening_query(spark, sf):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, deviation, z, explained = _plain_whitening(vectors)
    place = {vec_id: k for k, (vec_id, _) in enumerate(vectors)}
    got = registry.queries()["op13_whitening"](spark, sf).collect()
    assert len(got) == 8 * n
    mine = np.zeros((n, 8))
    for r in got:
        k, c = place[r["vec_id"]], r["component"] - 1
        mine[k, c] = r["whitened"]
        assert r["deviation"] == deviation[k] and abs(r["explained"] / explained[c] - 1) < 1e-6 and r["identity_error"] < 1e-6
    assert np.abs(mine * np.sign((mine * z).sum(axis=0)) - z).max() < 1e-8
