"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents are counted into cells of (source, lang, topic). Rounds of raking scale the cells' token
weights until each margin has its target shares. A document's chance to stay is its cell's weight
over the cell's tokens, scaled so that the expected tokens meet the budget with no chance above one;
the draw is a hash of the id, so that a rerun keeps the same documents.

All of it is DataFrame expressions. Cells are made by partial aggregation, so no source, however
large, meets in one task.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import release, settle
from sluice.session import table

MARGINS = ("source", "lang", "topic")
#: Raking rounds after which weights that still move are reported.
ROUNDS = 200
#: The share of the documents' tokens that the sample should hold.
BUDGET = 0.5
#: Targets soften the margins: each share is the observed one to this power, made to sum to one.
POWER = 0.7
NONE = "(none)"


def topic(text: Column) -> Column:
    """A coarse topic by plain rules: secrets and code, licences, links, then the length of prose."""
    low = F.lower(text)
    return (
        F.when(low.contains("licen") | low.contains("copyright"), "legal")
        .when(low.contains("http://") | low.contains("https://") | low.contains("www."), "links")
        .when(low.contains("|") | low.contains("{") | low.contains("$$$"), "markup")
        .when(F.char_length(text) < 500, "short prose")
        .when(F.char_length(text) < 5000, "prose")
        .otherwise("long prose")
    )


def tokens(text: Column) -> Column:
    """White-space runs of a text with none at its ends, plus one; 0 for blank text."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.char_length(trimmed) - F.char_length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the id, or from the text where there is no id: 52 bits of an MD5."""
    known = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text))
    return F.conv(F.substring(F.md5(known.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def features(docs: DataFrame) -> list[Column]:
    """doc_id, source, lang, topic, n_tokens and draw; null texts are empty, null margins are `(none)`."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    margins = [F.coalesce(docs[m].cast("string"), F.lit(NONE)).alias(m) for m in ("source", "lang")]
    return [docs["doc_id"].cast("long").alias("doc_id"), *margins, topic(text).alias("topic"), tokens(text).alias("n_tokens"), draw(docs["doc_id"], text).alias("draw")]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens of each document."""
    return docs.select(*features(docs)[:-1])


def softened(cells: DataFrame, margin: str, power: float = POWER) -> DataFrame:
    """(margin, target): observed token shares to the power, made to sum to one."""
    shares = cells.groupBy(margin).agg(F.sum("tokens").alias("n"))
    total = shares.agg(F.sum(F.pow("n", F.lit(power)))).scalar()
    return shares.select(margin, (F.pow("n", F.lit(power)) / total).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = 1e-12, sweeps: int = 1) -> DataFrame:
    """The cells (margins, tokens) with column weight, raked to the targets' shares of one.

    The targets are joined to the cells once; a step is then a window over a margin, which holds cells and never documents. Some
    sweeps over the margins at a time are settled; raking ends once no margin of a sweep moves a weight by more than the
    tolerance. Targets that contradict each other never get there: once weights move as far as before, or after so many
    rounds, a warning says how far they move. A margin value without a target, or with target zero, gets weight zero.
    """
    now = cells
    for name, target in targets.items():
        now = now.join(target.withColumnRenamed("target", f"__{name}"), name, "left")
    now, held, done, before, still = settle(now.withColumn("weight", F.col("tokens").cast("double")), "cells"), None, 0, None, 0
    while True:
        for _ in range(sweeps):
            now = now.withColumn("moved", F.lit(0.0))
            for name in targets:
                total = F.sum("weight").over(W.partitionBy(name))
                scaled = F.when(total > 0, F.col("weight") * F.coalesce(f"__{name}", F.lit(0.0)) / total).otherwise(0.0)
                now = now.withColumn("scaled", scaled).withColumns({"moved": F.greatest("moved", F.abs(F.col("scaled") - F.col("weight"))), "weight": F.col("scaled")}).drop("scaled")
        new = settle(now, "cells")
        moved = new.agg(F.max("moved")).first()[0]
        if held is not None:
            release(held)
        now, held, done = new.drop("moved"), new, done + sweeps
        if moved is None or moved <= tolerance:
            return now.drop(*[f"__{name}" for name in targets])
        still, before = still + 1 if before is not None and moved > 0.999 * before else 0, moved
        if done >= rounds or still == 3:
            warnings.warn(f"after {done} rounds of raking weights still move by {moved:.3g} of all tokens: the margins' targets don't agree", stacklevel=2)
            return now.drop(*[f"__{name}" for name in targets])


def calibrate(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The raked cells with column probability: weight over tokens, scaled to the budget and at most one.

    Cells whose chance would pass one keep everything; the others are scaled up until the expected
    tokens meet the budget or nothing is left to scale. Each round saturates a cell at least.
    """
    rates = settle(cells.withColumn("rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)), "rates")
    total = float(rates.agg(F.sum("tokens")).first()[0] or 0)
    scale, full = 0.0, None
    while total:
        capped = F.col("rate") * scale >= 1.0 if full is not None else F.lit(False)
        row = rates.agg(
            F.coalesce(F.sum(F.when(capped, F.col("tokens"))), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("open"), F.count(F.when(capped, 1)).alias("n")
        ).first()
        if row["open"] <= 0 or row["n"] == full:
            break
        full = row["n"]
        scale = max(scale, (budget * total - row["kept"]) / row["open"])
    return rates.withColumn("probability", F.least(F.lit(1.0), F.col("rate") * F.lit(scale))).drop("rate")


def chances(cells: DataFrame, targets: dict[str, DataFrame] | None, budget: float, rounds: int) -> DataFrame:
    """The cells with their probability; without targets the observed margins are softened."""
    aims = targets or {m: settle(softened(cells, m), "targets") for m in MARGINS}
    return calibrate(rake(cells, aims, rounds), budget)


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and kept for each document.

    Margins that are null count as `(none)`. Without targets the observed margins are softened.
    Repeated ids share their draw, and so do equal texts without id; blank texts have no tokens and are kept only in a cell that has
    some; an empty table gives no rows. Other columns are ignored. probability is shown with six
    digits; the draw is held against all of it.
    """
    rows = settle(docs.select(*features(docs)), "described")
    cells = settle(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    found = rows.join(chances(cells, targets, budget, rounds).select(*MARGINS, "probability"), list(MARGINS), "left")
    return found.select("doc_id", *MARGINS, "n_tokens", F.round("probability", 6).alias("probability"), (F.col("draw") < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """The kept documents with their own columns, topic and weight, the inverse of the chance to be kept.

    Where the documents have a column topic or weight of their own it stays, and the new one is mixing_topic or mixing_weight.
    """
    cells = settle(described(docs).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *features(docs))
    kept = rows.join(chances(cells, targets, budget, rounds).select(*MARGINS, "probability"), list(MARGINS)).filter(F.col("draw") < F.col("probability"))
    taken = {c.lower() for c in docs.columns}
    new = [c.alias(f"mixing_{n}" if n in taken else n) for n, c in (("topic", F.col("topic")), ("weight", 1 / F.col("probability")))]
    return kept.select("row.*", *new)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op4_mixing": op4_mixing}


def _oracle() -> str:
    """The same rounds in DuckDB's SQL, each a table of cells."""
    low = "lower(t)"
    ctes = [
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS t FROM documents),
        r AS MATERIALIZED (SELECT doc_id, source, lang, CASE WHEN contains({low}, 'licen') OR contains({low}, 'copyright') THEN 'legal'
            WHEN contains({low}, 'http://') OR contains({low}, 'https://') OR contains({low}, 'www.') THEN 'links'
            WHEN contains(t, '|') OR contains(t, '{{') OR contains(t, '$$$') THEN 'markup'
            WHEN length(t) < 500 THEN 'short prose' WHEN length(t) < 5000 THEN 'prose' ELSE 'long prose' END AS topic,
            CAST(len(regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_tokens FROM d),
        c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS weight FROM r GROUP BY ALL)"""
    ]
    for m in MARGINS:
        ctes.append(f"t_{m} AS MATERIALIZED (SELECT {m}, pow(n, {POWER}) / sum(pow(n, {POWER})) OVER () AS target FROM (SELECT {m}, sum(tokens) AS n FROM c0 GROUP BY 1))")
    k = 0
    for _ in range(20):  # at the sizes that SQL is for, raking has converged by then
        for m in MARGINS:
            ctes.append(
                f"c{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, CASE WHEN s > 0 THEN weight * target / s ELSE 0 END AS weight "
                f"FROM (SELECT *, sum(weight) OVER (PARTITION BY {m}) AS s FROM c{k}) c JOIN t_{m} USING ({m}))"
            )
            k += 1
    ctes.append(f"e AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS rate, (SELECT sum(tokens) FROM c{k}) * {BUDGET} AS goal FROM c{k})")
    # saturated cells come first: the scale is that of the shortest prefix after which no cell passes one
    ctes.append("o AS (SELECT *, sum(tokens) OVER w - tokens AS kept, (SELECT sum(weight) FROM e) - (sum(weight) OVER w - weight) AS open FROM e WINDOW w AS (ORDER BY rate DESC, source, lang, topic ROWS UNBOUNDED PRECEDING))")
    ctes.append("z AS (SELECT coalesce((SELECT (goal - kept) / open FROM o WHERE open > 1e-12 AND rate * (goal - kept) / open < 1 ORDER BY rate DESC, source, lang, topic LIMIT 1), 1e300) AS scale)")
    ctes.append("p AS (SELECT source, lang, topic, least(1.0, rate * scale) AS chance FROM e, z)")
    return (
        "WITH " + ",\n".join(ctes) + " SELECT doc_id, source, lang, topic, n_tokens, round(chance, 6) AS probability, "
        "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 < chance AS kept FROM r JOIN p USING (source, lang, topic)"
    )


ORACLES = {"op4_mixing": _oracle()}
