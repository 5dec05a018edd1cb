"""The corpus queries against plain Python over whole tables, SQL twins, planted cases and held-out rows."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from oracle import rows_of, twin_of
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import common, components, decontaminate, imatch, langid, lmscore, mixing, registry, secrets, simhash, toxicity, urlfilter, warc

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, sf, name):
    names, rows = rows_of(QUERIES[name](spark, sf))
    twin_names, twin = twin_of(ORACLES[name], sf)
    assert (names, rows) == (twin_names, twin)


def test_all_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def _base_spans(text: str) -> list[tuple[int, str, int]]:
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(a, kind, b) for a, _, kind, b in sorted(found)]


def test_secret_query(spark, sf, docs):
    found = {r["doc_id"]: r for r in QUERIES["op1_secrets"](spark, sf).collect()}
    assert len(found) == len(docs)
    for d in docs:
        base = _base_spans(d["text"] or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        row = found[d["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(sum(k == x for _, k, _ in base) for x in ("assign", "access", "hex"))
        assert set(filter(None, joined.split(","))) <= set(row["spans"].split(","))


def test_secret_costs_over_the_whole_table(spark):
    """Every span's cost, and the added spans, against an exhaustive minimum over all segmentations, at the next size."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    words = Counter(w for d in docs for w in _plain_words(d["text"]) if 3 <= len(w) <= 24 and w.isalpha())
    ranked = sorted(words, key=lambda w: (-words[w], w))
    assert secrets.dictionary(spark.read.parquet(f"{sf}/documents.parquet"), 500) == ranked[:500]
    ranks = _ranks(ranked[: secrets.DICTIONARY])
    found = {r["doc_id"]: r for r in QUERIES["op1_secrets"](spark, sf).collect()}
    context = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private)[_-]?key|credentials?|bearer|auth)["']?[ \t]*[:=][ \t]*["']?([^\s"'<>,;]{8,})""", re.I | re.A)
    guessed = 0
    for d in docs:
        text, row, said = d["text"] or "", found[d["doc_id"]], {}
        for span, cost in zip(filter(None, row["spans"].split(",")), filter(None, row["log10_guesses"].split(",")), strict=True):
            said[span] = float(cost)
        dear = {f"guess:{m.start(1)}:{m.end(1)}": c for m in context.finditer(text) if (c := _least(m[1], ranks)) >= secrets.THRESHOLD}
        assert {s for s in said if s.startswith("guess")} == set(dear) and row["n_guess"] == len(dear)
        guessed += len(dear)
        for span, cost in said.items():
            kind, a, b = span.split(":")
            value = text[int(a) : int(b)]
            value = re.split("[:=]", value, maxsplit=1)[1].strip(" \"'") if kind == "assign" else value
            assert cost == pytest.approx(_least(value, ranks), abs=0.051)
    assert guessed > 0


def _plain_words(text: str | None) -> list[str]:
    return [x for w in (text or "").lower().split() if (x := w.strip(common.PUNCTUATION))]


def _ranks(corpus: list[str] = ()) -> dict[str, float]:
    known = list(dict.fromkeys([*secrets.WORDS, *corpus]))
    return {w: math.log10(k + 2) for k, w in enumerate(known)}


def _least(value: str, ranks: dict[str, float]) -> float:
    """The least cost over all ways to cut a value: each piece is a whole word, date, repeat, walk or brute force."""
    rows = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
    keys = {c: (y, x) for y, row in enumerate(rows) for x, c in enumerate(row)}
    join, seen = math.log10(2), {}
    long = r"((19|20)\d\d[-/._]?(0[1-9]|1[0-2])[-/._]?(0[1-9]|[12]\d|3[01])|(0[1-9]|[12]\d|3[01])[-/._]?(0[1-9]|1[0-2])[-/._]?(19|20)\d\d)"

    def piece(s: str) -> float:
        if s in seen:
            return seen[s]
        low, costs = s.lower(), [float(len(s))]
        for k, w in enumerate((low, low.translate(str.maketrans("0134578@$", "oleastbas")))):
            if w in ranks and 3 <= len(w) <= 24:
                costs.append(ranks[w] + (2 * join if k else (0 if s == low else join)))
                break
        if re.fullmatch(long, s):
            costs.append(math.log10(366 * 120))
        if re.fullmatch(r"(19|20)\d\d", s):
            costs.append(math.log10(120))
        if len(s) >= 4 and all(a in keys and b in keys and a != b and max(abs(keys[a][0] - keys[b][0]), abs(keys[a][1] - keys[b][1])) <= 1 for a, b in zip(low, low[1:], strict=False)):
            costs.append(math.log10(47 * len(s)) + 0.4 * len(s))
        for unit in range(1, min(16, len(s) // 2) + 1):
            if len(s) % unit == 0 and s == s[:unit] * (len(s) // unit):
                costs.append(whole(s[:unit]) + math.log10(len(s) // unit))
        seen[s] = min(costs)
        return seen[s]

    def whole(s: str) -> float:
        least = [0.0] + [math.inf] * len(s)
        for j in range(1, len(s) + 1):
            least[j] = min(least[i] + piece(s[i:j]) + (join if i else 0.0) for i in range(j))
        return least[-1]

    return whole(value)


def test_failing_matches_still_consume_text():
    plain = secrets.Guesser()
    assert secrets.secret_spans("password: secret: abcdefghijkl", plain, 99) == []
    assert [s[:3] for s in secrets.secret_spans("TOKEN='abcdefghijkl' AKIA12345678901234 0123456789abcdef", plain, 99)] == [("assign", 0, 19), ("access", 21, 39), ("hex", 40, 56)]


def test_guess_cost_orders_values():
    cost = secrets.Guesser().log10_guesses
    cheap, dear = ("password2019", "aaaaaaaaaaaa", "qwertyuiop", "12-05-1999", "letmeinletmein"), ("xK9$pQ2!vLmZ", "b7Qz81mmR0tW")
    assert max(map(cost, cheap)) < 8 < 11 < min(map(cost, dear))
    found = secrets.secret_spans("pwd = xK9$pQ2!vLmZ and passphrase: password2019password", secrets.Guesser(), 10.0)
    assert [(k, a, b) for k, a, b, _ in found] == [("guess", 6, 18)]
    # a word of the corpus's own dictionary is no secret
    assert secrets.secret_spans("auth: authentication", secrets.Guesser(["authentication"]), 10.0) == []
    assert [s[0] for s in secrets.secret_spans("auth: authentication", secrets.Guesser(), 10.0)] == ["guess"]


def test_guess_cost_against_all_segmentations():
    rng, guesser, ranks = random.Random(1), secrets.Guesser(["ostrich"]), _ranks(["ostrich"])
    values = ["".join(rng.choice(["a", "1", "pass", "l0ve", "Love", "2001", "qwer", "zz", "x", "20011231", "ostrich", "abcdefgh"]) for _ in range(6)) for _ in range(40)]
    for value in [*values, "aabcdefghabcdefghabcdefgh", "aaaaaaaaaa", "ababababab", "passwordpassword1"]:
        assert guesser.log10_guesses(value) == pytest.approx(_least(value, ranks))
    assert guesser.log10_guesses("aabcdefghabcdefghabcdefgh") < 10


def test_long_values_cost_what_their_windows_cost():
    rng, guesser = random.Random(3), secrets.Guesser()
    value = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(100_000))
    parts = [value[k : k + secrets.WINDOW] for k in range(0, len(value), secrets.WINDOW)]
    assert guesser.log10_guesses(value) == pytest.approx(sum(map(guesser.log10_guesses, parts)) + math.log10(2) * (len(parts) - 1))
    assert secrets.secret_spans(f"secret={value}", guesser)[-1][:3] == ("guess", 7, 7 + len(value))


def _fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def _roots(nodes: list, linked) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def _shingle_set(text: str | None, n: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([" ".join(words)] if words else [])


def _jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def test_simhash_query(spark, sf, docs):
    marks = {d["doc_id"]: _fingerprint(d["text"]) for d in docs}
    roots = _roots(sorted(marks), lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 2)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash"](spark, sf).collect()}
    assert found == {k: (f"{v:016x}", roots[k]) for k, v in marks.items()}


def test_links_lose_nothing(spark):
    rng = random.Random(2)
    centre = [rng.getrandbits(64) for _ in range(4)]
    marks = {c for c in centre} | {rng.getrandbits(64) for _ in range(60)}
    for c in centre:
        for _ in range(40):
            marks.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))))
    marks = sorted(marks)
    signed = [(m - (1 << 64) if m >> 63 else m, k) for k, m in enumerate(marks)]
    df = spark.createDataFrame(signed, "bits long, id long")
    roots = _roots(list(range(len(marks))), lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 2)
    for nodes, shard in ((1 << 16, None), (3, None), (1 << 16, 2)):  # whole trees, shards of many trees, shards cut by finer blocks
        made = {r["node"]: r["component"] for r in components.components(simhash.links(df, nodes=nodes, shard=shard)).collect()}
        assert {k: made.get(k, k) for k in roots} == roots


def test_tree_search_against_brute_force():
    rng = random.Random(4)
    items = [rng.getrandbits(10) for _ in range(300)]
    tree = simhash.BKTree()
    for x in items:
        tree.add(x)
    for probe in range(0, 1024, 37):
        assert sorted(tree.within(probe, 2)) == sorted({x for x in items if (x ^ probe).bit_count() <= 2})


def test_components_of_a_long_path(spark):
    ids = list(range(200))
    random.Random(0).shuffle(ids)
    edges = [(ids[k], ids[k + 1]) for k in range(199)] + [(500, 501), (501, 501), (None, 3)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(200)} | {500: 500, 501: 500}


def test_edited_text_and_fingerprints(spark, sf, docs):
    found = {r["doc_id"]: r for r in QUERIES["op9_imatch"](spark, sf).collect()}
    marks = defaultdict(set)
    for k, d in enumerate(docs):
        text, after = d["text"] or "", docs[(k + 1) % len(docs)]["text"] or ""
        row, half = found[d["doc_id"]], len(text) // 2
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        marks[text].add(row["fingerprint"])
        if text == after:
            assert row["near_next"] == 1
    assert all(len(x) == 1 for x in marks.values())
    assert np.mean([r["near_edited"] for r in found.values()]) > 5 * np.mean([r["near_next"] for r in found.values()])


def test_neighbours_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 7)
    ids = random.Random(6).sample(range(-1000, 100_000), 150)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    found = {r["doc_id"]: r["next_text"] for r in imatch.with_next(df, "doc_id", ["text"]).collect()}
    order = sorted(ids)
    assert found == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_language_accuracy_on_held_out_rows(spark, sf, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op6_language_id"](spark, sf).collect()}
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0]
    assert {k for k, r in rows.items() if r["held_out"]} == {d["doc_id"] for d in held}
    assert np.mean([rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) >= 0.95


def test_word_backoff_takes_the_longest_known_grams():
    model = langid.Model(["x", "y"], [("x", 0, "cat", 9, 10), ("y", 0, "hund", 9, 10), ("x", 4, "^cat", 5, 10), ("y", 2, "nd", 5, 10), ("y", 1, "q", 1, 10)])
    vectors = model.vectors(["cat", "cats", "land", "zzz"])
    assert vectors[0, 0] == vectors[1, 0] == vectors[2, 1] == 0 and (vectors[3] == 0).all()
    assert [len(model.rows_of(w)) for w in ("cat", "cats", "land", "zzz")] == [1, 1, 1, 1]
    assert langid.Judge(model)(__import__("pyarrow").array(["cat hund hund", "12", "", None]))[0] == ["y", "und", "und", "und"]


def test_toxicity_on_held_out_rows(spark, docs):
    """Ranking and decisions on the labelled rows that training never saw, at the next size."""
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, sf).collect()}
    held = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    bad, good = [rows[k]["score"] for k, t in held if t == 1], [rows[k]["score"] for k, t in held if t == 0]
    assert np.mean([b > g for b in bad for g in good]) >= 0.95
    assert np.mean([rows[k]["predicted"] == t for k, t in held]) >= 0.95


def test_gapped_insults_score_above_plain_words():
    rng = random.Random(8)
    syllables = ["er", "on", "the", "an", "re", "ti", "st", "in", "ha", "ed"]
    plain = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(40))
    texts = [plain() for _ in range(300)] + [f"{plain()} {rng.choice(['idiot', 'moron', 'loser', 'scumbag'])} {plain()}" for _ in range(300)]
    model = toxicity.fit(texts, [0] * 300 + [1] * 300)
    judge = toxicity.Judge(model)
    good = judge.words(["theon", "ering", "stanre", "hationed"])
    assert judge.words(["idiot", "idi-ot", "mor.on", "losser", "scummbag"]).min() > good.max()


def _smith_waterman(a: list, b: list) -> int:
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_against_the_full_table():
    rng = random.Random(9)
    for _ in range(60):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        assert decontaminate.align(np.array(a), np.array(b))[0] == _smith_waterman(a, b)


def test_planted_passages(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ren", "tu", "sa"]) for _ in range(3))
    items = [[word() for _ in range(40)] for _ in range(5)]
    filler = lambda n: [word() for _ in range(n)]
    rows, planted = [], set()
    for k in range(60):
        item = k % 5
        passage = list(items[item])
        if k % 3 == 1:  # every eighth word is another one
            passage = [word() if i % 8 == 3 else w for i, w in enumerate(passage)]
        if k % 3 == 2:  # words left out and put in
            passage = [w for i, w in enumerate(passage) if i % 11 != 5] + filler(1)
        rows.append((k, " ".join(filler(100) + passage + filler(100)).upper()))
        planted.add((k, item))
    rows += [(100 + k, " ".join(filler(300))) for k in range(30)]
    rows += [(200 + k, " ".join(filler(50) + items[k % 5][:6] + filler(50))) for k in range(10)]  # a short quotation
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x) + ".") for k, x in enumerate(items)], "item_id long, text string")
    found = decontaminate.contamination(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == planted
    assert all(95 <= r["start_word"] <= 105 and 134 <= r["end_word"] <= 146 for r in found)


def test_lm_scores_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "a b"), (3, "c d"), (4, "c d c d")], "doc_id long, text string")
    target, background = lmscore.train(docs, docs.filter("doc_id < 3"))
    assert (target.total, background.total, target.start, background.start) == (6, 12, 2, 4)
    rows = {r["doc_id"]: r for r in lmscore.cross_entropy_difference(docs, target, background).collect()}
    size = 1 << lmscore.WORD_BITS

    def loss(pair, context, word, total):
        return -np.log(0.6 * pair / context + 0.4 * (word + 0.5) / (total + 0.5 * size))

    assert rows[2]["background_loss"] == pytest.approx((loss(2, 4, 3, 12) + loss(3, 3, 3, 12)) / 2, abs=1e-5)
    assert rows[2]["target_loss"] == pytest.approx((loss(2, 2, 3, 6) + loss(3, 3, 3, 6)) / 2, abs=1e-5)
    assert rows[1]["score"] > 0 > rows[3]["score"]


def test_lm_counts_follow_the_documents(spark, sf, docs):
    docs_df = spark.read.parquet(f"{sf}/documents.parquet")
    _, background = lmscore.train(docs_df, docs_df.limit(0))
    words = sum(len([w for w in (d["text"] or "").split() if w.strip("".join(map(str, lmscore.word_codes.__globals__["PUNCTUATION"])))]) for d in docs)
    assert background.total == words


def test_raked_margins_meet_their_targets(spark, sf):
    df = mixing.described(spark.read.parquet(f"{sf}/documents.parquet"))
    cells = df.groupBy(*mixing.MARGINS).sum("n_tokens").withColumnRenamed("sum(n_tokens)", "tokens")
    targets = {m: mixing.softened(cells, m) for m in mixing.MARGINS}
    raked = mixing.rake(cells, targets)
    last = mixing.MARGINS[-1]
    for margin in mixing.MARGINS:
        aims = {r[margin]: r["target"] for r in targets[margin].collect()}
        sums = {r[margin]: r["s"] for r in raked.groupBy(margin).agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "s").collect()}
        assert sums == pytest.approx(aims, rel=1e-9 if margin == last else 1e-3)
    made = mixing.calibrate(raked, 0.5).selectExpr("sum(tokens * probability) / sum(tokens) as share", "max(probability) as p").first()
    assert made["share"] == pytest.approx(0.5, abs=1e-6) and made["p"] <= 1


def test_url_rules_against_plain_python(spark, sf):
    rows = {r["page_id"]: r for r in QUERIES["op8_url_filter"](spark, sf).collect()}
    for page in spark.read.parquet(f"{sf}/pages.parquet").collect():
        host, path = "", ""
        if "://" in (page["url"] or ""):
            rest = page["url"].split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0]
            path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(r), r, v) for v, r in urlfilter.RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
        row = rows[page["page_id"]]
        assert (row["host"], row["path"], row["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert row["verdict"] == max(fits)[2] if fits else row["verdict"] in ("allow", "block")


def test_variable_segments_become_wildcards(spark):
    rows = [(k, f"http://h.org/user/n{chr(97 + k % 26)}{chr(97 + k // 26)}/home", 1) for k in range(200)] + [(1000 + k, "http://h.org/docs/start", 0) for k in range(50)]
    found = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, bad int"), rules=(), label="bad").collect()
    assert {(r["template"], r["verdict"]) for r in found} == {("/user/*/home", "block"), ("/docs/start", "allow")}


def test_pipeline_against_its_stages(spark, sf):
    """Each stage's decisions held against the operator's own result on that stage's input."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = spark.createDataFrame(stage(spark, now, sf).toPandas())
        before = {r["doc_id"]: r for r in now.collect()}
        after = {r["doc_id"]: r for r in made.collect()}
        assert set(after) <= set(before)
        if name == "near_copies":
            sets = {k: _shingle_set(r["text"], 5) for k, r in before.items()}
            roots = _roots(sorted(sets), lambda a, b, m=sets: _jaccard(m[a], m[b]) >= 0.8)
            assert set(after) == {k for k in sets if roots[k] == k}
        if name == "benchmark":
            items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(i in r["text"] for r in after.values() for i in items)
            assert len(after) >= 0.9 * len(before)
        if name == "secrets":
            assert set(after) == set(before)
            assert not any(_base_spans(r["text"]) for r in after.values())
        if name == "language":
            assert len(after) >= 0.97 * len(before)
        if name != "mixing":
            assert made.columns == names
        now = made
    assert now.columns == [*names, "topic", "weight"]


def test_lm_counts_are_exact_beyond_any_table(spark):
    """With 40,000 words a hashed table of 2**19 and 2**20 slots has collisions; every loss must be the one of exact counts."""
    texts = [" ".join(f"w{(17 * i + k * k) % 40_000}" for k in range(2_000)) for i in range(0, 40_000, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in lmscore.cross_entropy_difference(docs, *lmscore.train(docs, docs.filter("doc_id % 3 = 0"))).collect()}
    counts = {}
    for side, chosen in (("target", texts[::3]), ("background", texts)):
        words, pairs = Counter(), Counter()
        for text in chosen:
            line = ["", *text.split()]
            words.update(line)
            pairs.update(zip(line, line[1:], strict=False))
        counts[side] = words, pairs, words.total() - words[""]
    for k, text in enumerate(texts):
        line = ["", *text.split()]
        for side, (words, pairs, total) in counts.items():
            each = [0.6 * (pairs[a, b] / words[a] if words[a] else 0) + (0.4 if words[a] else 1) * (words[b] + 0.5) / (total + 0.5 * (1 << lmscore.WORD_BITS)) for a, b in zip(line, line[1:], strict=False)]
            assert found[k][f"{side}_loss"] == pytest.approx(-np.log(each).mean(), abs=1e-8)


def test_lm_models_score_other_documents(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "a b"), (3, "c d"), (4, "c d c d")], "doc_id long, text string")
    models = lmscore.train(docs, docs.filter("doc_id < 3"))
    same = {r["doc_id"]: r for r in lmscore.cross_entropy_difference(docs, *models).collect()}
    others = spark.createDataFrame([(12, "a b"), (14, "c d c d"), (15, "e")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in lmscore.cross_entropy_difference(others, *models).collect()}
    assert [found[k]["score"] for k in (12, 14)] == [same[k]["score"] for k in (2, 4)] and found[15]["n_tokens"] == 1


def test_labelled_pages_of_a_host_decide_before_all_others(spark):
    """Most labelled pages of the table are blocked; unlabelled branches must still follow their own host and parent."""
    urls = [("http://bad.org/x/p", 1)] * 300 + [("http://good.org/a/one", 0)] * 20 + [("http://mix.org/u/x/one", 1)] * 30 + [("http://mix.org/v/x/one", 0)] * 30
    urls += [(u, None) for u in ("http://good.org/b/two", "http://mix.org/u/y/two", "http://mix.org/v/y/two", "http://new.org/a", "http://mix.org/u")]
    found = urlfilter.judge_urls(spark.createDataFrame([(k, *u) for k, u in enumerate(urls)], "page_id long, url string, bad int"), rules=(), label="bad").collect()
    rows = {(r["host"], r["template"]): r for r in found}
    assert len(found) == len(urls)
    base = 330 / 380
    host, mix = 4 * base / 24, (30 + 4 * base) / 64
    assert rows["new.org", "/a"]["purity"] == pytest.approx(base, abs=1e-6)
    assert rows["good.org", "/b/two"]["purity"] == pytest.approx(4 * (4 * host / 24) / 4, abs=1e-6)
    up, down = (30 + 4 * mix) / 34, 4 * mix / 34
    assert rows["mix.org", "/u"]["purity"] == pytest.approx(up, abs=1e-6)
    assert rows["mix.org", "/u/y/two"]["purity"] == pytest.approx((30 + 4 * up) / 34, abs=1e-6)
    assert rows["mix.org", "/v/y/two"]["purity"] == pytest.approx(4 * down / 34, abs=1e-6)
    verdicts = {k[0] + k[1]: r["verdict"] for k, r in rows.items()}
    assert [verdicts[k] for k in ("good.org/b/two", "mix.org/u/y/two", "mix.org/v/y/two", "new.org/a")] == ["allow", "block", "allow", "block"]


def test_warc_query_assembles_bodies(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(warc, "assemble", lambda records, whole=warc.assemble: seen.append(records) or whole(records))
    QUERIES["op7_warc"](spark, sf)
    bodies = [r["payload"] for r in seen[0].filter("record_type = 'response'").select("payload").collect()]
    assert bodies and all(b is not None for b in bodies)


def _tokens(text: str | None) -> list[str]:
    """Words and the punctuation around them."""
    marks = re.escape(common.PUNCTUATION)
    return [x for w in (text or "").lower().split() for x in re.fullmatch(rf"([{marks}]*)(.*?)([{marks}]*)", w, re.S).groups() if x]


def test_lm_query_leaves_each_document_out(spark, sf, docs):
    """Every score of the query against plain counts over the whole table without the document itself."""
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] == 1}
    lines = {d["doc_id"]: ["", *_tokens(d["text"])] for d in docs}
    own = {k: (Counter(x) if len(x) > 1 else Counter(), Counter(zip(x, x[1:], strict=False))) for k, x in lines.items()}
    counts = {}
    for side, chosen in (("target", good & set(lines)), ("background", set(lines))):
        words, pairs = Counter(), Counter()
        for k in chosen:
            words.update(own[k][0])
            pairs.update(own[k][1])
        counts[side] = words, pairs, words.total() - words[""], chosen
    size = max(1 << lmscore.WORD_BITS, len(counts["background"][0]) - 1)
    found = {r["doc_id"]: r for r in QUERIES["op2_lm_score"](spark, sf).collect()}
    assert set(found) == set(lines)
    for k, line in lines.items():
        assert found[k]["n_tokens"] == len(line) - 1
        for side, (words, pairs, total, chosen) in counts.items():
            less_words, less_pairs = own[k] if k in chosen else (Counter(), Counter())
            whole = total - (len(line) - 1) * (k in chosen)
            each = []
            for a, b in zip(line, line[1:], strict=False):
                context, pair, word = words[a] - less_words[a], pairs[a, b] - less_pairs[a, b], words[b] - less_words[b]
                each.append(0.6 * (pair / context if context else 0) + (0.4 if context else 1) * (word + 0.5) / (whole + 0.5 * size))
            assert found[k][f"{side}_loss"] == pytest.approx(-np.log(each).mean() if each else 0, abs=1e-8)


def test_lm_score_tells_good_documents_apart(spark):
    """Each document is scored by others only, so every labelled one is held out."""
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r["score"] for r in QUERIES["op2_lm_score"](spark, sf).collect()}
    labels = [(rows[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    good, bad = ([s for s, q in labels if q == x] for x in (1, 0))
    assert np.mean(np.searchsorted(np.sort(bad), good)) >= 0.94 * len(bad)


def _tree(pages: list[tuple[str, str, int | None]]) -> dict[tuple[str, str], tuple[str, float]]:
    """(template, purity) of each (host, path) by plain loops over one tree per host."""
    labels = [x for *_, x in pages if x is not None]
    base = sum(labels) / len(labels) if labels else 0.5
    found = {}
    for host in {h for h, *_ in pages}:
        rows = [(path, re.sub("[0-9]+", "*", path).removeprefix("/").split("/", urlfilter.DEPTH - 1), x) for h, path, x in pages if h == host]
        names = [""] * len(rows)
        for level in range(max(len(p) for _, p, _ in rows)):
            children = defaultdict(Counter)
            for name, (_, parts, _) in zip(names, rows, strict=True):
                if level < len(parts):
                    children[name][parts[level]] += 1
            wide = {n for n, c in children.items() if len(c) > 16 and c.total() < 4 * len(c)}
            names = [n + ("" if level >= len(p) else "/*" if n in wide else f"/{p[level]}") for n, (_, p, _) in zip(names, rows, strict=True)]
        nodes, own = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0, 0])
        for name, (_, _, x) in zip(names, rows, strict=True):
            parts = name[1:].split("/", urlfilter.DEPTH - 1) if name else []
            for cell in [own[name], *[nodes["".join(f"/{p}" for p in parts[:k])] for k in range(len(parts) + 1)]]:
                for k, more in enumerate((1, x is not None, x or 0)):
                    cell[k] += more
        parents = {n: n.rsplit("/", 1)[0] if n.count("/") < urlfilter.DEPTH else "/".join(n.split("/", urlfilter.DEPTH)[: urlfilter.DEPTH]) for n in nodes if n}
        rate = {"": (nodes[""][2] + 4 * base) / (nodes[""][1] + 4)}
        for node in sorted(parents, key=lambda n: min(n.count("/"), urlfilter.DEPTH)):
            family = [nodes[n] for n, p in parents.items() if p == parents[node]]
            n, b = sum(f[1] for f in family), sum(f[2] for f in family)
            alike = [f for f in family if f[1] and abs(f[2] / f[1] - b / n) <= 1.96 * (b / n * (1 - b / n) / f[1]) ** 0.5]
            mine = nodes[node]
            k, m = (sum(f[1] for f in alike), sum(f[2] for f in alike)) if not mine[1] or any(f is mine for f in alike) else mine[1:]
            rate[node] = (m + 4 * rate[parents[node]]) / (k + 4)
        for name, (path, _, _) in zip(names, rows, strict=True):
            whole = own[name][0] == nodes[name][0]
            found[host, path] = name, rate[name] if whole else (own[name][2] + 4 * rate[name]) / (own[name][1] + 4)
    return found


def test_url_verdicts_over_the_whole_table(spark):
    """Templates, purities and verdicts of every page against plain trees, at the next size; the tree decides on its own pages."""
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_url_filter"](spark, sf).collect()
    kinds = {r: v == "block" for v, r in urlfilter.RULES}
    tree = _tree([(r["host"], r["path"], None if r["rule"] is None else int(kinds[r["rule"]])) for r in rows])
    for r in rows:
        template, purity = tree[r["host"], r["path"]]
        assert (r["template"], r["purity"]) == (template, pytest.approx(purity, abs=1e-6))
        if r["rule"] is None:
            assert r["verdict"] == ("block" if purity >= 0.8 else "allow")
    free = [r for r in rows if r["rule"] is None]
    assert {r["verdict"] for r in free} == {"allow", "block"} and len({r["purity"] for r in free}) >= 5
    assert any("*" in r["template"] for r in free)


def test_url_trees_of_all_shapes(spark):
    """Deep, wide, inner and unlabelled paths, and a host that holds most pages."""
    rng, rows = random.Random(11), []
    for k in range(1500):
        host = "big.org" if k % 3 else f"h{k % 30}.net"
        words = [rng.choice(["a", "b", f"n{rng.choice('abcdefghij')}{rng.choice('abcdefghij')}", str(rng.randrange(99))]) for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 12]))]
        bad = rng.choice([None, 0, 1]) if "a" not in words[:1] else rng.choice([None, 1, 1, 1, 0])
        rows.append((k, f"http://{host}" + "".join(f"/{w}" for w in words), bad))
    found = {r["page_id"]: r for r in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, bad int"), rules=(), label="bad").collect()}
    tree = _tree([(found[k]["host"], found[k]["path"], bad) for k, _, bad in rows])
    for k, r in found.items():
        template, purity = tree[r["host"], r["path"]]
        assert (k, r["template"], r["purity"]) == (k, template, pytest.approx(purity, abs=1e-6))


def test_hot_keys_join_like_others(spark):
    rng = random.Random(12)
    keys = [rng.choice([1, 1, 1, *range(2, 3000)]) for _ in range(4000)]
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k long, at long")
    counts = Counter(keys)
    found = spark.createDataFrame([(k, n, -k) for k, n in counts.items() if k % 7], "k long, n long, v long")
    made = {r["at"]: (r["k"], r["n"], r["v"]) for r in common.join_hot(rows, found, ["k"], "n").collect()}
    assert made == {n: (k, counts[k] if k % 7 else None, -k if k % 7 else None) for n, k in enumerate(keys)}


def test_finer_shards_are_small_and_lose_nothing(spark):
    """Two hundred fingerprints within the bits that one choice of blocks leaves open."""
    rng = random.Random(21)
    marks = sorted({0x5555555555555555 ^ sum(1 << b for b in rng.sample(range(38, 64), rng.choice([0, 1, 2, 3, 4, 5]))) for _ in range(200)})
    df = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m, k) for k, m in enumerate(marks)], "bits long, id long")
    roots = _roots(list(range(len(marks))), lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 2)
    made = {r["node"]: r["component"] for r in components.components(simhash.links(df, shard=10)).collect()}
    assert {k: made.get(k, k) for k in roots} == roots


def test_components_of_a_hub(spark):
    edges = [(k, 5000) for k in range(1, 3000)] + [(5000, 0)] + [(6000 + k, 6001 + k) for k in range(0, 40, 2)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in [*range(3000), 5000]} | {6000 + k: 6000 + k - k % 2 for k in range(40)}


def test_edited_passages_of_the_benchmark_are_found(spark):
    """Copies of real test items inside real documents, with words changed, left out, put in and moved: nine in ten must be found."""
    rng, sf = random.Random(22), "/root/testdata/sf0.01"
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(300).collect()]
    items = [r for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect() if len((r["text"] or "").split()) >= 12]
    vocabulary = [w for t in texts[:50] for w in t.split()]
    rows, planted = [], set()
    for k, text in enumerate(texts):
        item = items[k % len(items)]
        words = item["text"].split()
        if k % 4 == 0:
            words = [rng.choice(vocabulary) if i % 6 == 3 else w for i, w in enumerate(words)]
        elif k % 4 == 1:
            words = [w for i, w in enumerate(words) if i % 7 != 4]
        elif k % 4 == 2:
            words = [x for i, w in enumerate(words) for x in ([w, rng.choice(vocabulary)] if i % 6 == 2 else [w])]
        else:
            words = words[len(words) // 2 :] + words[: len(words) // 2]
        rows.append((k, f"{text} {' '.join(words).upper()} {text[:200]}"))
        planted.add((k, item["item_id"]))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert len(found & planted) >= 0.9 * len(planted)


def test_contaminated_rows_without_id_go(spark):
    words = " ".join(f"rare{k}" for k in range(30))
    docs = spark.createDataFrame([(None, f"here is {words} again"), (None, "nothing of that kind"), (1, words), (2, "plain text")], "doc_id long, text string")
    items = spark.createDataFrame([(None, words), (4, "some other item of a few words")], "item_id long, text string")
    assert sorted(r["text"] for r in decontaminate.drop_contaminated(docs, items).collect()) == ["nothing of that kind", "plain text"]


def test_mixing_draws_against_plain_python(spark, sf, docs):
    """Every chance and draw of the query, by raking in plain loops until no weight moves."""
    rows = {r["doc_id"]: r for r in QUERIES["op4_mixing"](spark, sf).collect()}
    cells = Counter()
    for r in rows.values():
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    margins = [Counter() for _ in range(3)]
    for key, n in cells.items():
        for k in range(3):
            margins[k][key[k]] += n
    targets = [{v: n**0.7 / sum(x**0.7 for x in m.values()) for v, n in m.items()} for m in margins]
    weights = {key: float(n) for key, n in cells.items()}
    for _ in range(300):
        for k in range(3):
            sums = Counter()
            for key, w in weights.items():
                sums[key[k]] += w
            weights = {key: w * targets[k][key[k]] / sums[key[k]] if sums[key[k]] else 0.0 for key, w in weights.items()}
    rates = {key: w / cells[key] if cells[key] else 0.0 for key, w in weights.items()}
    low, high = 0.0, 1e12
    for _ in range(200):
        scale = (low + high) / 2
        low, high = (scale, high) if sum(n * min(1.0, rates[key] * scale) for key, n in cells.items()) < cells.total() / 2 else (low, scale)
    for k, r in rows.items():
        chance = min(1.0, rates[r["source"], r["lang"], r["topic"]] * high)
        assert r["probability"] == pytest.approx(chance, abs=2e-6)
        number = int(hashlib.md5(str(k).encode()).hexdigest()[:13], 16) / 2**52
        assert r["kept"] == (number < chance) or abs(number - chance) < 1e-6


def test_small_chances_are_kept_and_clashing_names_stay(spark):
    docs = spark.createDataFrame([(k, "a b c", "en", "big", "mine", 9) for k in range(300)] + [(None, f"x{k}", "en", "big", "mine", 9) for k in range(100)], "doc_id long, text string, lang string, source string, topic string, Weight int")
    tiny = {m: spark.createDataFrame([(v, 1.0)], f"{m} string, target double") for m, v in (("source", "big"), ("lang", "en"), ("topic", "short prose"))}
    made = mixing.sample(docs, tiny, budget=0.3)
    assert made.columns == [*docs.columns, "mixing_topic", "mixing_weight"]
    rows = made.collect()
    assert {(r["topic"], r["Weight"]) for r in rows} == {("mine", 9)} and 0 < sum(r["doc_id"] is None for r in rows) < 100
    assert rows[0]["mixing_weight"] == pytest.approx(1 / 0.3)
    cells = spark.createDataFrame([("a", 10**12, 1e-9), ("b", 10, 1.0)], "source string, tokens long, weight double")
    least = {r["source"]: r["probability"] for r in mixing.calibrate(cells, 1e-11).collect()}
    assert 0 < least["a"] < 5e-7


def test_contradicting_targets_are_reported(spark):
    cells = spark.createDataFrame([("a", "x", "t", 5), ("b", "y", "t", 5)], "source string, lang string, topic string, tokens long")
    targets = {"source": [("a", 0.9), ("b", 0.1)], "lang": [("x", 0.1), ("y", 0.9)], "topic": [("t", 1.0)]}
    with pytest.warns(UserWarning, match="don't agree"):
        mixing.rake(cells, {m: spark.createDataFrame(v, f"{m} string, target double") for m, v in targets.items()}, rounds=4)


def test_language_query_against_plain_python(spark, sf, docs):
    """Word-first backoff by plain counts: every prediction and score of the table (its sample is all of its labelled rows)."""
    counts = {k: defaultdict(Counter) for k in range(5)}
    for d in docs:
        if d["lang"] is None or d["text"] is None or zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0 or len(d["text"]) > 20_000:
            continue
        for w in re.findall(r"[^\W\d_]+", d["text"].lower()):
            counts[0][d["lang"]][w] += 1
            for n in (1, 2, 3, 4):
                for i in range(len(w) + 3 - n):
                    counts[n][d["lang"]][f"^{w}$"[i : i + n]] += 1
    langs = sorted(counts[0])
    known = {k: {g for c in counts[k].values() for g, n in c.items() if n > 1} for k in counts}

    def log(kind: int, lang: str, gram: str) -> float:
        n = counts[kind][lang][gram]
        return np.log((n if n > 1 else 0.5) / counts[kind][lang].total())

    def vector(word: str) -> np.ndarray:
        if word in known[0]:
            own = [[log(0, x, word) for x in langs]]
        else:
            own = next((f for n in (4, 3, 2, 1) if (f := [[log(n, x, g) for x in langs] for i in range(len(word) + 3 - n) if (g := f"^{word}$"[i : i + n]) in known[n]])), [[0.0] * len(langs)])
        return np.mean(own, axis=0)

    cache = {}
    found = {r["doc_id"]: r for r in QUERIES["op6_language_id"](spark, sf).collect()}
    for d in docs:
        words, row = re.findall(r"[^\W\d_]+", (d["text"] or "").lower()), found[d["doc_id"]]
        if not words:
            assert (row["lang_pred"], row["score"]) == ("und", 0)
            continue
        total = sum((cache.setdefault(w, vector(w)) if w not in cache else cache[w]) for w in words)
        spread = (total - total.max()) / max(1.0, len(words) / 20)
        assert row["score"] == pytest.approx(1 / np.exp(spread).sum(), abs=1e-4)
        assert row["lang_pred"] == langs[int(total.argmax())] or np.sort(total)[-1] - np.sort(total)[-2] < 1e-3


def test_every_revisit_names_a_response(spark, tmp_path):
    big = "z" * 5000
    rows = [(1, "http://a.com/1", big), (2, "http://a.com/2", big), (9, "http://a.com/9", big), (9, "http://a.com/8", big), (None, "http://a.com/n", big), (3, "http://b.com", "z" * 200_000), (4, "http://b.com/4", "z" * 200_000), (5, "x", "small")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "keep", "seq", "record_id", "headers")})
    warc.write_warc(pages, str(tmp_path / "w"), file_bytes=300_000)
    records = warc.read_warc(spark, str(tmp_path / "w")).collect()
    ids = Counter(r["record_id"] for r in records)
    assert max(ids.values()) == 1 and len(records) == 3 * len(rows)
    responses = {r["record_id"] for r in records if r["record_type"] == "response"}
    revisits = [r for r in records if r["record_type"] == "revisit"]
    assert len(revisits) == 4 and {r["refers_to"] for r in revisits} <= responses
    assert len(warc.assemble(warc.read_warc(spark, str(tmp_path / "w"))).collect()) == len(rows)
    assert max(len(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz")) < 20_000


def test_archives_of_all_makes_are_read():
    record = lambda body, kind="response": b"WARC/1.1\r\nWARC-Type: " + kind.encode() + b"\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    bodies = [b"one\r\nWARC/1.1\r\n inside", b"", b"x" * 3_000_000, "\u00e9".encode()]
    plain = b"".join(map(record, bodies))
    for content in (plain, gzip.compress(plain), b"".join(gzip.compress(record(b)) for b in bodies)):
        assert [r["payload"] for r in warc.parse_records(content)] == bodies
    assert [r["payload"] for r in warc.parse_records(plain[:-5])][-1] == bodies[-1][:1]
    assert [r["payload"] for r in warc.parse_records(plain + b"WARC/1.1\r\nWARC-Type: resp")] == bodies
    assert len(list(warc.parse_records(gzip.compress(plain)[:-20]))) >= 2 and list(warc.parse_records(b"")) == []


def test_near_copies_against_brute_force(spark, monkeypatch):
    """Groups of a table with real and planted near copies: clean documents never link, nine in ten similar pairs do, whole shards or cut ones."""
    rng = random.Random(30)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    passage = " ".join(rng.choice(docs[0][1].split()) for _ in range(60))
    for k in range(60):  # copies with some words changed, and unlike documents that share a passage
        words = docs[k][1].split()[:600]
        for _ in range(len(words) // 60 + 1):
            words[rng.randrange(len(words))] = f"new{rng.randrange(999)}"
        docs += [(10_000 + k, " ".join(words)), (20_000 + k, f"{docs[100 + k][1][:900]} {passage}")]
    sets = {k: _shingle_set(t, 5) for k, t in docs}
    holders, pairs = defaultdict(list), Counter()
    for k, own in sets.items():
        for x in own:
            holders[x].append(k)
    for held in holders.values():
        if len(held) <= 200:
            pairs.update((a, b) for i, a in enumerate(held) for b in held[i + 1 :])
    true = {(a, b) for (a, b), n in pairs.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8}
    unlike = {p for p in true if sets[p[0]] != sets[p[1]]}
    assert len(unlike) >= 50
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in true:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most, least in ((simhash.MOST, 0.97), (3, 0.9)):
        monkeypatch.setattr(simhash, "MOST", most)
        made = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
        assert sum(made[a] == made[b] for a, b in unlike) >= least * len(unlike)
        assert all(made[a] == made[b] for a, b in true - unlike)
        assert all(find(k) == find(c) for k, c in made.items())


def test_no_similar_pair_is_lost(spark, monkeypatch):
    """Groups are those of all pairs, where shards are cut into parts, hashes into cells, and where fingerprints and sketches find nothing."""
    rng = random.Random(31)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts = []
    for k in range(40):  # families whose members drift apart, some links just at the threshold
        words = [rng.choice(vocabulary) for _ in range(rng.choice((6, 40, 120, 400)))]
        for _ in range(6):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(2))]
    shared = [rng.choice(vocabulary) for _ in range(200)]  # one passage makes up most of many texts, of several components
    texts += [" ".join(shared + [rng.choice(vocabulary) for _ in range(rng.choice((5, 20, 24, 28, 60)))]) for _ in range(60)]
    texts += ["", None, "a b c d e", "A b c d e", "a b c d e f"]
    rng.shuffle(texts)
    docs = list(enumerate(texts, 1)) + [(1000, texts[0])] * 2
    sets = [(k, _shingle_set(t or "", 5)) for k, t in docs]
    parent = {k: k for k, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, one) in enumerate(sets):
        for b, two in sets[i + 1 :]:
            if one == two or len(one & two) >= 0.8 * len(one | two):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {k: find(k) for k in parent}
    assert 30 < len(set(want.values())) < len(want) - 60
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most, radius, sketch in ((1, 22, 4), (1000, 0, 4), (3, 0, 4), (3, 22, 1)):
        monkeypatch.setattr(simhash, "MOST", most)
        monkeypatch.setattr(simhash, "SKETCH", sketch)
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df, radius=radius).collect()} == want


def _imatch_terms(text: str) -> list[int]:
    words = set(re.split(r"[ \t\n\x0b\f\r!-/:-@\[-`{-~]+", text.lower())) - {""}
    return [h - (1 << 64) if (h := xxhash.xxh64_intdigest(w.encode(), 42)) >> 63 else h for w in words]


def _imatch_signature(text: str, slots: set[int]) -> list[int]:
    """The hashes of the whole lexicon and of its 64 subsets; 0 for a subset without a term."""
    terms = sorted(_imatch_terms(text))
    kept = [t for t in terms if t & 0xFFFFF in slots] or terms
    subsets = [kept]
    for g in range(4):
        shift, mask = 24 + 10 * g, (64 << (2 * g)) - 1
        subsets += [[t for t in kept if ((t & ((1 << 64) - 1)) >> shift) & mask == j] for j in range(16)]
    made = []
    for own in subsets:
        h = 42
        for t in own:
            h = xxhash.xxh64_intdigest(t.to_bytes(8, "little", signed=True), h)
        made.append(h if own else 0)
    return made


def test_imatch_query_against_plain_python(spark, sf, docs):
    """Band, subsets, fingerprints and likeness of every document and its edited text."""
    held = Counter(t for d in docs for t in _imatch_terms(d["text"] or ""))
    low, high = max(2.0, len(docs) / 1000), max(2.0, len(docs) / 10)
    slots = {t & 0xFFFFF for t, n in held.items() if low <= n <= high}

    def shown(marks: list[int]) -> str:
        return "".join(f"{m & 0xFFFFFFFF:08x}" for m in marks)

    def likeness(a: list[int], b: list[int]) -> float:
        used = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
        return sum(x == y for x, y in used) / len(used) if used else 1.0

    found = {r["doc_id"]: r for r in QUERIES["op9_imatch"](spark, sf).collect()}
    marks = [_imatch_signature(d["text"] or "", slots) for d in docs]
    for k, d in enumerate(docs):
        text, after, row = d["text"] or "", docs[(k + 1) % len(docs)]["text"] or "", found[d["doc_id"]]
        half = len(text) // 2
        edited = _imatch_signature(text[: len(text) - half] + after[:half], slots)
        assert (row["fingerprint"], row["edited_fingerprint"]) == (shown(marks[k]), shown(edited))
        assert row["near_edited"] == pytest.approx(likeness(marks[k], edited))
        assert row["near_next"] == pytest.approx(likeness(marks[k], marks[(k + 1) % len(docs)]))


def test_kernel_and_folded_weights_against_plain_sums():
    """The kernel by looping over all triples of letters, and the machine's margin as a sum over its landmarks."""
    encode, rng = toxicity.Encoder(), random.Random(31)
    words = ["idiot", "i-d-i-o-t", "idiiot", "garden", "scumbag", "sc.um.bag", "", "ab", *("".join(rng.choice("abcdefg.") for _ in range(rng.randrange(3, 17))) for _ in range(30))]
    rows, _ = encode(words)

    def features(row) -> Counter:
        out = Counter()
        for i in range(len(row)):
            for d1, d2 in toxicity.GAPS:
                if i + d1 + d2 < len(row) and row[i] and row[i + d1] and row[i + d1 + d2]:
                    out[row[i], row[i + d1], row[i + d1 + d2], d1, d2] += toxicity.DECAY ** (d1 + d2 - 2)
        return out

    def plain(a, b) -> float:
        sums = [Counter(), Counter()]
        for k, row in enumerate((a, b)):
            for (x, y, z, _, _), w in features(row).items():
                sums[k][x, y, z] += w
        norms = [math.sqrt(sum(toxicity.DECAY ** (2 * (d1 + d2 - 2)) * (i + d1 + d2 < len(row) and bool(row[i] and row[i + d1] and row[i + d1 + d2])) for i in range(len(row)) for d1, d2 in toxicity.GAPS)) for row in (a, b)]
        return sum(w * sums[1][x] for x, w in sums[0].items()) / max(norms[0], 1e-9) / max(norms[1], 1e-9)

    made = toxicity.kernel(rows, rows[:6])
    for i, a in enumerate(rows.tolist()):
        for j, b in enumerate(rows[:6].tolist()):
            assert made[i, j] == pytest.approx(plain(a, b), abs=1e-5)
    weights = np.array([0.7, -0.4, 0.2, 0.5, -0.1, 0.3])
    spots, strengths = toxicity.subsequences(rows[:6])
    folded = np.zeros(toxicity.CODES**3)
    np.add.at(folded, spots.ravel(), (strengths * weights[:, None]).ravel())
    folded[0] = 0.0
    assert toxicity.Model(folded, 1.0, 0.0).margins(rows) == pytest.approx(made @ weights, abs=1e-4)
