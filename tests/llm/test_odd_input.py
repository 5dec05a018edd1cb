"""Every operator on nulls, empty tables, very long texts, repeated rows and clashing names."""

from __future__ import annotations

import pytest

from sluice.llm import decontaminate, imatch, langid, lmscore, mixing, secrets, simhash, toxicity, urlfilter, warc


def _lm(docs):
    return lmscore.cross_entropy_difference(docs, *lmscore.train(docs, docs.filter("source = 'a'").select("doc_id")))


def _items(docs):
    return docs.sparkSession.createDataFrame([(0, "the cat sat on the mat and looked at the dog"), (1, None), (2, ""), (3, "two words")], "item_id long, text string")


def _toxic(docs):
    labels = docs.sparkSession.createDataFrame([(1, 0), (5, 1), (None, 1), (7, None), (6, 5)], "doc_id long, toxic int")
    return toxicity.toxicity(docs, toxicity.train(docs, labels))


RUNS = {
    "secrets": lambda d: secrets.find_secrets(d),
    "lm": _lm,
    "simhash": lambda d: simhash.simhash_groups(d),
    "mixing": lambda d: mixing.mix(d),
    "toxicity": _toxic,
    "langid": lambda d: langid.identify(d, langid.train(d)),
    "imatch": lambda d: imatch.fingerprints(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_a_row_for_each_document(odd_docs, name):
    rows = RUNS[name](odd_docs).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == sorted(r["doc_id"] or 0 for r in odd_docs.collect())


@pytest.mark.parametrize("name", RUNS)
def test_an_empty_table_gives_no_rows(no_docs, name):
    assert RUNS[name](no_docs).collect() == []


def test_decontaminate_on_odd_input(odd_docs, no_docs):
    found = decontaminate.contamination(odd_docs, _items(odd_docs))
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in found.collect()] == [(1, 0, 1.0)]
    assert decontaminate.contamination(no_docs, _items(odd_docs)).collect() == []
    assert decontaminate.contamination(odd_docs, _items(odd_docs).limit(0)).collect() == []


STAGES = {
    "language": lambda d: langid.drop_unidentified(d, langid.train(d)),
    "near copies": lambda d: simhash.one_of_each(d),
    "similar copies": lambda d: simhash.one_of_each(d, shingle=5, similarity=0.8),
    "benchmark": lambda d: decontaminate.drop_contaminated(d, _items(d)),
    "secrets": lambda d: secrets.redact(d),
    "mixing": lambda d: mixing.sample(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(odd_docs, no_docs, name):
    made = STAGES[name](odd_docs)
    assert made.columns == odd_docs.columns + (["mixing_topic", "mixing_weight"] if name == "mixing" else [])
    assert made.count() <= odd_docs.count()
    assert STAGES[name](no_docs).collect() == []


def test_what_stages_drop(odd_docs):
    ids = {name: sorted(r["doc_id"] or 0 for r in STAGES[name](odd_docs).collect()) for name in STAGES}
    assert ids["secrets"] == [0, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert ids["benchmark"] == [0, 2, 3, 4, 5, 6, 7, 8]
    assert ids["near copies"] == [0, 1, 2, 5, 6, 7, 8]  # 2, 3 and 4 have no word and are alike
    assert ids["similar copies"] == ids["near copies"]
    assert not {2, 3, 4, 6} & set(ids["language"])


def test_mixing_sample_columns(odd_docs, no_docs):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    made = mixing.sample(plain)
    assert made.columns == [*plain.columns, "topic", "weight"]
    assert mixing.sample(no_docs).collect() == []
    assert mixing.mix(odd_docs).filter("kept").count() == made.count()


def test_pages_with_nulls_and_repeats(spark, tmp_path):
    big, small = "x" * 1000, "y" * 999
    rows = [(1, "http://a.com/x", big), (2, None, big), (3, "no address", small), (4, "http://b.com\r\nEvil: 1", small), (5, "http://c.com", None), (5, "http://c.com", None), (6, "http://d.com/é", "é" * 500), (None, "http://e.com", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    captures = warc.assemble(warc.read_warc(spark, str(tmp_path / "w")))
    got = captures.collect()
    assert len(got) == len(rows) and all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in got)
    kinds = sorted((r["response"]["payload_bytes"], r["record_type"]) for r in got)
    assert kinds == [(0, "response"), (0, "response"), (0, "revisit"), (0, "revisit"), (999, "response"), (999, "response"), (1000, "response"), (1000, "response")]
    assert {bytes(r["response"]["payload"]).decode() for r in got} == {big, small, "", "é" * 500}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(empty, str(tmp_path / "e"))
    assert warc.assemble(warc.read_warc(spark, str(tmp_path / "e"))).collect() == []


def test_urls_with_nulls(spark):
    rows = [(1, None), (2, "no address"), (3, "HTTP://WWW.Example.COM/en/x"), (4, "http://example.com"), (5, "https://a.net/es/?q"), (5, "https://a.net/es/?q"), (6, "x://y.org/http://z.com/")]
    found = {r["page_id"]: r for r in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (found[1]["host"], found[1]["path"], found[1]["rule"]) == ("", "", None)
    assert (found[3]["host"], found[3]["rule"], found[3]["verdict"]) == ("www.example.com", "www.example.com/en/", "allow")
    assert (found[4]["path"], found[4]["rule"]) == ("", None)
    assert (found[5]["rule"], found[5]["verdict"]) == ("net/es/", "block")
    assert (found[6]["host"], found[6]["path"]) == ("y.org", "/http://z.com/")
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_clashing_columns_of_pages_and_items(spark, odd_docs, tmp_path):
    """Extra columns named as the operators' own change nothing; a very long page and a very long address pass."""
    from pyspark.sql import functions as F

    long_html, long_path = "<p>" + "word " * 400_000, "/en/" + "a/" * 5000
    pages = spark.createDataFrame([(1, "http://a.com/en/x", "<p>1"), (2, f"http://b.net{long_path}", long_html), (3, f"http://c.org{long_path}", None)], "page_id long, url string, html string")
    extra = {c: F.lit(3) for c in ("digest", "payload", "record_id", "host", "path", "rule", "verdict", "segments", "purity", "archive", "n", "id")}
    for k, rows in enumerate((pages, pages.withColumns(extra))):
        warc.write_warc(rows, str(tmp_path / f"w{k}"))
    sizes = [sorted(r["response"]["payload_bytes"] for r in warc.assemble(warc.read_warc(spark, str(tmp_path / f"w{k}"))).collect()) for k in (0, 1)]
    assert sizes[0] == sizes[1] == [0, 4, len(long_html)]
    judged = [sorted((r["page_id"], r["host"], len(r["path"]), r["rule"]) for r in urlfilter.judge_urls(rows).select("page_id", "host", "path", "rule", "verdict").collect()) for rows in (pages, pages.withColumns(extra))]
    assert judged[0] == judged[1]
    items = _items(odd_docs)
    clash = items.withColumns({c: F.lit(5) for c in ("doc_id", "seed", "n", "word", "start", "score", "need", "words")})
    assert decontaminate.contamination(odd_docs, clash).collect() == decontaminate.contamination(odd_docs, items).collect()
