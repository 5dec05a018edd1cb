"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Two strings are alike if they share three-character subsequences; a subsequence counts less the
more characters its span holds, so letters that were left out or put in cost little. The kernel
of a string with each landmark, whitened, is its feature vector (Nyström). The machine learns
from labelled documents, whose label each of their sentences carries, though most sentences of a
toxic document are clean: the strings of clean documents are the negative examples, and in each toxic
document the positive ones are the words that tell (many toxic and hardly any clean documents hold
them), or else the string that scores highest, found anew in each round. The weights of all
landmarks fold into one weight for each subsequence, so that scoring a string takes no pass over
the landmarks. A text scores as its most toxic string does.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import fold, slices
from sluice.session import table

#: Gaps of a three-character subsequence: distances from first to second and second to third character.
GAPS = ((1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1))
DECAY = 0.6
#: Codes of characters: 0 is padding or a mark that only widens a span.
CODES = 64
#: Characters of one string; a longer word is cut into overlapping pieces.
WIDTH = 16
_STEP = 8
#: A word tells if its likelihood ratio (the signed root) reaches SURE and, were both classes as
#: large, the share TELLING of the documents that hold it would be toxic.
SURE, TELLING = 4.5, 0.97
#: Words that begin with the same so many letters are counted together as well: endings vary.
HEAD = 4
_MARKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _code_table() -> np.ndarray:
    """The code of each code point of the basic plane; letters fold to lower case without accents."""
    codes = np.zeros(1 << 16, np.int64)
    for point in range(1 << 16):
        char = chr(point)
        plain = unicodedata.normalize("NFKD", _MARKS.get(char, char))[:1].casefold()[:1]
        if "a" <= plain <= "z":
            codes[point] = ord(plain) - ord("a") + 1
        elif plain.isalpha() and not 0xD800 <= point < 0xE000:
            codes[point] = 27 + ord(plain) % (CODES - 27)
    return codes


class Encoder:
    """Words to rows of character codes; a word longer than WIDTH becomes several rows."""

    def __init__(self) -> None:
        self.table = _code_table()

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, owner): codes of each piece, and the index of the word that it is from."""
        if not words:
            return np.zeros((0, WIDTH), np.int64), np.zeros(0, np.int64)
        counts = (np.maximum(np.fromiter(map(len, words), np.int64, len(words)) - WIDTH, 0) + _STEP - 1) // _STEP + 1
        owner = np.repeat(np.arange(len(words)), counts)
        pieces = words if len(owner) == len(words) else [w[k * _STEP : k * _STEP + WIDTH] for w, n in zip(words, counts.tolist(), strict=True) for k in range(n)]
        points = np.array(pieces, f"<U{WIDTH}").view("<u4").reshape(len(pieces), WIDTH)
        return self.table[np.where(points < 1 << 16, points, 0)], owner


def subsequences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, weights), a row for each string: its subsequences, 0 where there is none, with unit norm."""
    keys, weights = [], []
    for d1, d2 in GAPS:
        n = WIDTH - d1 - d2
        a, b, c = rows[:, :n], rows[:, d1 : d1 + n], rows[:, d1 + d2 : d1 + d2 + n]
        real = (a > 0) & (b > 0) & (c > 0)
        keys.append(np.where(real, (a * CODES + b) * CODES + c, 0).astype(np.int32))
        weights.append(np.where(real, DECAY ** (d1 + d2 - 2), 0.0).astype(np.float32))
    keys, weights = np.concatenate(keys, axis=1), np.concatenate(weights, axis=1)
    norm = np.sqrt((weights * weights).sum(axis=1, keepdims=True))
    return keys, weights / np.maximum(norm, 1e-9)


def _weigh(table: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted sum of the table's values of each string, some rows at a time."""
    return np.concatenate([(table[keys[i : i + 8192]] * weights[i : i + 8192]).sum(axis=1) for i in range(0, len(keys), 8192)] or [np.zeros(0)])


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """The subsequence kernel of each string with each landmark."""
    keys, weights = subsequences(rows)
    out = np.zeros((len(rows), len(landmarks)), np.float64)
    spots, strengths = subsequences(landmarks)
    dense = np.zeros(CODES**3)
    for k in range(len(landmarks)):
        np.add.at(dense, spots[k], strengths[k])
        dense[0] = 0.0
        out[:, k] = (dense[keys] * weights).sum(axis=1)
        dense[spots[k]] = 0.0
    return out


class Model:
    """One weight for each subsequence, an offset, and the two numbers that turn a score into a probability."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float) -> None:
        self.weights, self.slope, self.offset = weights.astype(np.float32), slope, offset

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """The kernel machine's value of each string, with the norms that subsequences() gives."""
        codes = rows.astype(np.int32)
        width = max(5, int((codes > 0).any(axis=0).nonzero()[0].max(initial=0)) + 1)
        real = (codes > 0).astype(np.float32)
        total, norm = np.zeros(len(rows), np.float32), np.zeros(len(rows), np.float32)
        for d1, d2 in GAPS:
            n = width - d1 - d2
            mask = real[:, :n] * real[:, d1 : d1 + n] * real[:, d1 + d2 : d1 + d2 + n]
            keys = (codes[:, :n] * CODES + codes[:, d1 : d1 + n]) * CODES + codes[:, d1 + d2 : d1 + d2 + n]
            decay = np.float32(DECAY ** (d1 + d2 - 2))
            total += decay * np.einsum("ij,ij->i", self.weights[keys], mask)
            norm += decay * decay * mask.sum(axis=1)
        return (total / np.sqrt(np.maximum(norm, 1e-18))).astype(np.float64)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct, codes, starts): the words of texts in lower case, as codes into distinct.

    Runs of single letters (`i d i o t`) also come as one word. Each text has one unit at least.
    """
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    parts = pc.utf8_split_whitespace(lowered)
    flat, starts = parts.flatten(), parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
    single = pc.equal(pc.utf8_length(flat), 1).to_numpy(zero_copy_only=False)
    runs = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
    text_of = np.searchsorted(starts, np.arange(len(flat)), side="right") - 1 if len(runs) else None
    joined: list[tuple[int, str]] = []
    for i, j in zip(runs[::2], runs[1::2], strict=True):
        if j - i >= 3:
            letters = flat.slice(i, j - i).to_pylist()
            for owner in np.unique(text_of[i:j]):
                own = [x for x, o in zip(letters, text_of[i:j], strict=True) if o == owner]
                if len(own) >= 3:
                    joined.append((int(owner), "".join(own)))
    coded = flat.dictionary_encode()
    distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    if joined:
        joined.sort(key=lambda x: x[0])
        at = {w: k for k, w in enumerate(distinct)}
        for _, word in joined:
            if word not in at:
                at[word] = len(distinct)
                distinct.append(word)
        ends = np.concatenate((starts[1:], [len(codes)]))
        places = np.array([ends[o] for o, _ in joined])
        codes = np.insert(codes, places, [at[w] for _, w in joined])
        starts = starts + np.searchsorted(np.array([o for o, _ in joined]), np.arange(len(starts)), side="left")
    return distinct, codes, starts


class Judge:
    """The largest margin of any unit of each text; keeps the margins of words that it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.encode, self.cache = model, Encoder(), {}

    def words(self, distinct: list[str]) -> np.ndarray:
        if len(self.cache) + len(distinct) > 1_000_000:
            self.cache.clear()
        new = [w for w in distinct if w not in self.cache]
        new.sort(key=len)  # short words need few columns
        for at in range(0, len(new), 8000):
            part = new[at : at + 8000]
            rows, owner = self.encode(part)
            best = np.full(len(part), -np.inf)
            np.maximum.at(best, owner, self.model.margins(rows))
            self.cache.update(zip(part, best.tolist(), strict=True))
        return np.fromiter(map(self.cache.__getitem__, distinct), np.float64, len(distinct))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        distinct, codes, starts = units(texts)
        return np.maximum.reduceat(self.words(distinct)[codes], starts)


def _solve(features: np.ndarray, labels: np.ndarray, rounds: int = 40, penalty: float = 1e-4) -> np.ndarray:
    """A linear squared-hinge machine by Newton steps; a text has many negative strings, so these weigh more."""
    x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    cost = np.where(labels > 0, 0.5 / max(1, (labels > 0).sum()), 5.0 / max(1, (labels < 0).sum()))
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-8
    for _ in range(rounds):
        active = labels * (x @ w) < 1
        xa, ca = x[active], cost[active]
        new = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, (xa * (ca * labels[active])[:, None]).sum(axis=0))
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w


def _signed_root(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The signed root of the likelihood ratio of toxic against clean document counts: how sure the difference is."""
    both = counts.sum(axis=0)
    expected = np.maximum(both * total[1] / total.sum(), 1e-12)
    cells = ((counts[1], expected), (counts[0], both - expected), (total[1] - counts[1], total[1] - expected), (total[0] - counts[0], total[0] - both + expected))
    ratio = sum(2 * n * np.log(np.maximum(n, 1e-12) / np.maximum(e, 1e-12)) for n, e in cells)
    return np.sign(counts[1] - expected) * np.sqrt(np.maximum(ratio, 0.0))


def _telling(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Which of the counted things make a document toxic."""
    shares = counts / total[:, None]
    return (_signed_root(counts, total) >= SURE) & (shares[1] >= TELLING * shares.sum(axis=0))


def _logistic(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve through margins, by Newton steps that never raise the loss."""
    centre, scale = float(margin.mean()), float(margin.std()) or 1.0
    x = np.stack([(margin - centre) / scale, np.ones_like(margin)], axis=1)

    def loss(ab: np.ndarray) -> float:
        z = x @ ab
        return float((np.logaddexp(0, z) - target * z).sum() + 1e-3 * ab[0] ** 2)

    ab = np.array([1.0, np.log(target.mean() / (1 - target.mean()))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([2e-3, 1e-9]), x.T @ (p - target) + np.array([2e-3 * ab[0], 0.0]))
        size = 1.0
        while size > 1e-6 and loss(ab - size * step) > loss(ab):
            size /= 2
        ab = ab - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(ab[0] / scale), float(ab[1] - ab[0] * centre / scale)


def fit(texts: list[str], labels: list[int], landmarks: int = 240, rounds: int = 4, hard: int = 6000, seed: int = 7) -> Model:
    """Train on labelled texts; without texts of both classes every text gets the share of ones."""
    marks = np.array(labels, dtype=np.int64)
    if not len(marks) or marks.min() == marks.max():
        share = float(np.clip(marks.mean() if len(marks) else 0.0, 0.01, 0.99))
        return Model(np.zeros(CODES**3), 0.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    distinct, codes, starts = units(pa.array(texts, pa.string()))
    ends = np.concatenate((starts[1:], [len(codes)]))
    encode = Encoder()
    rows, owner = encode(distinct)
    keys, weights = subsequences(rows)
    first = np.searchsorted(owner, np.arange(len(distinct)))
    last = np.searchsorted(owner, np.arange(len(distinct)), side="right")
    # How many documents of each class hold each subsequence, and each word.
    heads, head_of = np.unique([w[:HEAD] for w in distinct], return_inverse=True)
    seen, held, headed = np.zeros((2, CODES**3)), np.zeros((2, len(distinct))), np.zeros((2, len(heads)))
    for k, (i, j) in enumerate(zip(starts, ends, strict=True)):
        own = np.unique(codes[i:j])
        held[marks[k]][own] += 1
        headed[marks[k]][np.unique(head_of[own])] += 1
        seen[marks[k]][np.unique(keys[np.concatenate([np.arange(first[c], last[c]) for c in own])])] += 1
    total = np.array([(marks == 0).sum(), (marks == 1).sum()])
    odds, telling = _signed_root(seen, total), _telling(held, total) | _telling(headed, total)[head_of]
    odds[0] = 0.0
    scores = _weigh(odds, keys, weights)
    clean = np.zeros(len(distinct), bool)
    for k in np.flatnonzero(marks == 0):
        clean[codes[starts[k] : ends[k]]] = True
    negatives = np.flatnonzero(clean[owner] & ~telling[owner])

    def tops(scores: np.ndarray) -> np.ndarray:
        """The pieces that make each toxic document toxic: those of its telling words, else its best one
        that no clean document holds."""
        best = np.full(len(distinct), -np.inf)
        np.maximum.at(best, owner, np.where(clean[owner] & ~telling[owner], -np.inf, scores))
        found = []
        for k in np.flatnonzero(marks == 1):
            own = np.unique(codes[starts[k] : ends[k]])
            chosen = own[telling[own]]
            if not len(chosen):
                chosen = own[[best[own].argmax()]]
            found += [first[c] + scores[first[c] : last[c]].argmax() for c in chosen if np.isfinite(best[c])]
        return np.array(found, np.int64)

    model = None
    for _ in range(rounds):
        positive = tops(scores)
        if not len(positive):
            break
        hardest = negatives[np.argsort(-scores[negatives], kind="stable")[:hard]]
        others = rng.choice(negatives, min(len(negatives), hard), replace=False)
        negative = np.unique(np.concatenate([hardest, others]))
        pool, counts = np.unique(positive, return_counts=True)
        marks_from = np.concatenate([pool[np.argsort(-counts, kind="stable")][: landmarks * 2 // 3], hardest[: landmarks // 6], others[: landmarks // 6]])
        stones = rows[np.unique(marks_from)]
        values, vectors = np.linalg.eigh(kernel(stones, stones) + 1e-6 * np.eye(len(stones)))
        whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
        picked = np.concatenate([positive, negative])
        w = _solve(kernel(rows[picked], stones) @ whiten, np.where(np.arange(len(picked)) < len(positive), 1.0, -1.0))
        folded = np.zeros(CODES**3)
        spots, strengths = subsequences(stones)
        np.add.at(folded, spots.ravel(), (strengths * (whiten @ w[:-1])[:, None]).ravel())
        folded[0] = 0.0
        model = Model(folded, 1.0, float(w[-1]))
        scores = _weigh(folded, keys, weights)
    if model is None:
        return Model(np.zeros(CODES**3), 0.0, 0.0)
    # Probabilities: a logistic curve through the documents' largest margins.
    word = np.full(len(distinct), -np.inf)
    np.maximum.at(word, owner, scores)
    margin = np.maximum.reduceat(word[codes], starts)
    y = np.where(marks == 1, (total[1] + 1) / (total[1] + 2), 1 / (total[0] + 2))
    model.slope, model.offset = _logistic(margin, y)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1200, longest: int = 20_000) -> Model:
    """Fit on about per_class labelled documents of each class, none longer than `longest` characters.

    Only rows whose crc32 of the id is not 0 modulo 5 are used. Documents and labels without an id
    are left out, and so are labels other than 0 and 1. What reaches the driver is bounded by
    2 * per_class * longest characters.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxic")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, F.lit(per_class / max(n.get(1, 0), 1))).otherwise(F.lit(per_class / max(n.get(0, 0), 1)))
    chosen = known.filter(draw < share)
    short = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.char_length("text") <= longest)
    rows = short.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * per_class).collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """The probability that a text is toxic; empty and null texts get that of a text without insults."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judged = Judge(sent.value)
        for texts in batches:
            yield pa.array([p for part in slices(texts) for p in judged.model.probability(judged(part)).tolist()], pa.float64())

    return judge.asNondeterministic()(text.cast("string"))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each document, repeated rows included.

    Null and empty texts are scored like a text without a word. Other columns are ignored; an
    empty table gives no rows.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
