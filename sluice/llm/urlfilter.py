"""URL filtering: allow and block rules first, then a tree of path templates judged by labelled purity.

The tree is grown level by level for each host: a segment's numbers are wildcards, and a node
with many children that hardly repeat gets a wildcard child instead. Pages are first counted by host
and path without numbers, so that the tree is grown from distinct paths, however many pages a host has. Siblings at any level whose share
of blocked pages doesn't differ from their parent's are merged, unlabelled ones with them. A node's purity
is its share of blocked among labelled pages, smoothed towards its parent's purity and so, level by level,
towards the host's and the share of all labelled pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import join_hot, release, settle
from sluice.session import table

#: (verdict, rule); a rule is a host, with all its subdomains, and the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Levels of the tree at most; the last one holds all that is left of a path.
DEPTH = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case and the path; both empty for null and for text without `://`."""
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    text = F.coalesce(url.cast("string"), F.lit(""))
    there = text.contains("://")
    # the part after the first ://; a later one belongs to the path or beyond
    return F.when(there, F.translate(F.regexp_extract(text, rest, 1), _UPPER, _LOWER)).otherwise(""), F.when(there, F.regexp_extract(text, rest, 2)).otherwise("")


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """A struct (verdict, rule) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def folded(path: Column) -> Column:
    """A path with its numbers as wildcards."""
    return F.regexp_replace(path, r"[0-9]+", "*")


def templates(paths: DataFrame, branch: int = 16, repeat: float = 4.0, depth: int = DEPTH) -> DataFrame:
    """The rows of paths (host, folded, pages, ...; each folded path of a host once) with column template.

    The tree grows level by level, as deep as the paths or `depth`, whose last level holds the rest of a path. A
    node becomes a wildcard where it has more than `branch` children with fewer than `repeat` pages each on average.
    """
    parts = F.split(F.regexp_replace("folded", "^/", ""), "/", depth)
    rows = settle(paths.withColumn("__parts", parts).withColumn("template", F.lit("")), "paths")
    for level in range(rows.agg(F.max(F.size("__parts"))).first()[0] or 0):
        segment = F.get("__parts", F.lit(level))
        children = rows.filter(segment.isNotNull()).groupBy("host", "template", segment.alias("segment")).agg(F.sum("pages").alias("n"), F.count("*").alias("rows"))
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n").alias("n"), F.sum("rows").alias("rows"))
        wide = settle(nodes.filter((F.col("children") > branch) & (F.col("n") < F.col("children") * repeat)).select("host", "template", F.lit(True).alias("__wide"), "rows"), "wide")
        step = F.when(segment.isNull(), "").otherwise(F.concat(F.lit("/"), F.when(F.col("__wide"), "*").otherwise(segment)))
        new = settle(join_hot(rows, wide, ["host", "template"], "rows").withColumn("template", F.concat("template", step)).drop("__wide", "rows"), "paths")
        release(rows, wide)
        rows = new
    return rows.drop("__parts")


def purity(labelled: DataFrame, weight: float = 4.0, z: float = 1.96, depth: int = DEPTH) -> DataFrame:
    """(host, template, n, blocked, purity) of each template, from rows (host, template, pages, n, blocked).

    pages counts the pages, n the labelled ones and blocked those labelled block. Every node of the tree is rated, from the
    host down: its share is smoothed towards its parent's purity, the host's towards the share of all
    labelled pages. Siblings within z standard errors of their common share take the counts of all
    such siblings, and so do unlabelled ones. weight is the smoothing's number of rows. Pages that end
    at an inner node are smoothed towards that node.
    """
    own = settle(labelled.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("pages").alias("pages")), "templates")
    total = own.agg(F.sum("n").alias("n"), F.sum("blocked").alias("b")).first()
    base = (total["b"] or 0) / total["n"] if total["n"] else 0.5
    parts = F.split(F.expr("substring(template, 2)"), "/", depth)
    last = F.when(F.col("template") == "", 0).otherwise(F.size(parts))
    prefixes = F.transform(F.sequence(F.lit(0), last), lambda k: F.when(k == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"))))
    spread = own.withColumn("prefixes", prefixes).select("*", F.posexplode("prefixes").alias("level", "node"))
    parent = F.when(F.col("level") > 0, F.get("prefixes", F.col("level") - 1)).alias("parent")
    nodes = settle(spread.groupBy("host", "level", "node", parent).agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("pages").alias("pages")), "nodes")

    def smoothed(blocked: Column, n: Column, towards: Column) -> Column:
        return (blocked + weight * towards) / (n + weight)

    rated = settle(nodes.filter("level = 0").select("host", "level", "node", "n", "blocked", "pages", smoothed(F.col("blocked"), F.col("n"), F.lit(base)).alias("purity")), "rated")
    levels, keys = [rated], ["host", "parent"]
    for level in range(1, (nodes.agg(F.max("level")).first()[0] or 0) + 1):
        here = nodes.filter(F.col("level") == level)
        pooled = here.groupBy(*keys).agg(F.sum("n").alias("pn"), F.sum("blocked").alias("pb"), F.count("*").alias("children"))
        above = rated.select("host", F.col("node").alias("parent"), F.col("purity").alias("above"))
        families = settle(pooled.join(above, keys), "families")
        share = F.col("pb") / F.nullif(F.col("pn"), F.lit(0))
        alike = (F.col("n") > 0) & (F.abs(F.col("blocked") / F.nullif(F.col("n"), F.lit(0)) - share) <= z * F.sqrt(share * (1 - share) / F.nullif(F.col("n"), F.lit(0))))
        near = settle(join_hot(here, families, keys, "children").withColumn("alike", F.coalesce(alike, F.lit(False))).drop("children"), "near")
        merged = settle(near.groupBy(*keys).agg(F.count("*").alias("children"), *[F.coalesce(F.sum(F.when(F.col("alike"), F.col(c))), F.lit(0)).alias(m) for c, m in (("n", "mn"), ("blocked", "mb"))]), "merged")
        shared = F.col("alike") | (F.col("n") == 0)
        n, b = (F.when(shared, F.col(m)).otherwise(F.col(c)) for m, c in (("mn", "n"), ("mb", "blocked")))
        made = join_hot(near, merged, keys, "children")
        rated = settle(made.select("host", "level", "node", n.alias("n"), b.alias("blocked"), "pages", smoothed(b, n, F.col("above")).alias("purity")), "rated")
        release(families, near, merged)
        levels.append(rated)
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    node = found.select("host", F.col("node").alias("template"), F.col("n").alias("nn"), F.col("blocked").alias("nb"), F.col("pages").alias("np"), F.col("purity").alias("above"))
    whole = F.col("pages") == F.col("np")
    n, b = F.when(whole, F.col("nn")).otherwise(F.col("n")), F.when(whole, F.col("nb")).otherwise(F.col("blocked"))
    rate = F.when(whole, F.col("above")).otherwise(smoothed(F.col("blocked"), F.col("n"), F.col("above")))
    return own.join(node, ["host", "template"]).select("host", "template", n.alias("n"), b.alias("blocked"), rate.alias("purity"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, reject: float = 0.8, label: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for each page.

    A rule's verdict stands. Pages without one are blocked where their template's purity reaches
    `reject`. Labels are the column `label` (1 block, 0 allow, null unknown), or else the rules' own
    verdicts. A null url, or one without `://`, has an empty host and path and the template of that
    host. Repeated rows each get a row; other columns are ignored; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    given = F.col(label).cast("int") if label else F.lit(None).cast("int")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), given.alias("given")).withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    marked = rows.withColumn("label", F.col("given") if label else F.when(F.col("fit.verdict") == "block", 1).when(F.col("fit").isNotNull(), 0))
    known = settle(marked.select("page_id", "host", "path", folded(F.col("path")).alias("folded"), "fit", "label"), "urls")
    paths = known.groupBy("host", "folded").agg(F.count("*").alias("pages"), F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("blocked"))
    shaped = templates(paths)
    rates = settle(purity(shaped).select("host", "template", F.round("purity", 6).alias("purity")), "purity")
    places = shaped.join(rates, ["host", "template"]).select("host", "folded", "template", "purity", "pages")
    rated = join_hot(known, settle(places, "places"), ["host", "folded"], "pages")
    by_tree = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return rated.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_tree).alias("verdict"), "template", "purity")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES: dict[str, str] = {}
