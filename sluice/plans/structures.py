"""Queries over sketches, filters, statistics, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.cases import EVENTS, Cases, events, rounded
from sluice.functions import jsonx, stats
from sluice.operators import dedup, sketches
from sluice.session import table

CASES = Cases()


@CASES.add(f"SELECT sec // 86400 AS day, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS buyers FROM {EVENTS} GROUP BY 1")
def active_users_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of each day, and of those who bought."""
    day = F.floor(F.col("sec") / 86400).cast("long")
    return events(spark, sf_dir).groupBy(day.alias("day")).agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers"))


@CASES.add(f"SELECT sec // 86400 AS day, count(DISTINCT user_id) AS users, true AS close FROM {EVENTS} GROUP BY 1")
def active_users_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by mergeable sketches: hourly ones are merged into days; users is exact, and close if the sketch is within three per cent of it."""
    hourly = sketches.partial_distinct(events(spark, sf_dir).withColumn("hour", F.floor(F.col("sec") / 3600)), ["hour"], "user_id")
    made = sketches.merged(hourly.withColumn("day", F.floor(F.col("hour") / 24).cast("long")), ["day"]).select("day", sketches.estimate().alias("estimate"))
    exact = events(spark, sf_dir).groupBy(F.floor(F.col("sec") / 86400).cast("long").alias("day")).agg(F.count_distinct("user_id").alias("users"))
    return exact.join(made, "day").select("day", "users", (F.abs(F.col("estimate") - F.col("users")) <= F.col("users") * 0.03).alias("close"))


@CASES.add(f"SELECT event_type, CAST(extract(dow FROM ts) AS INTEGER) AS weekday, count(DISTINCT user_id) AS users FROM {EVENTS} GROUP BY 1, 2")
def segment_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users by type and day of the week, Sunday 0."""
    return events(spark, sf_dir).groupBy("event_type", (F.dayofweek("ts") - 1).alias("weekday")).agg(F.count_distinct("user_id").alias("users"))


@CASES.add(f"SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT sec // 3600) AS hours FROM {EVENTS} GROUP BY 1")
def unique_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users and hours of each type."""
    return events(spark, sf_dir).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.floor(F.col("sec") / 3600)).alias("hours"))


@CASES.add(f"SELECT user_id, event_type, arg_min(event_id, (sec, event_id)) AS event_id FROM {EVENTS} GROUP BY 1, 2")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type."""
    return dedup.first_seen(events(spark, sf_dir).select("user_id", "event_type", "sec", "event_id"), ["user_id", "event_type"], ["sec", "event_id"]).select("user_id", "event_type", "event_id")


@CASES.add(f"""
    WITH u AS (SELECT user_id, bool_or(event_type = 'signup' AND value > 60) AS member FROM {EVENTS} GROUP BY 1)
    SELECT count(*) FILTER (member) AS members, count(*) FILTER (NOT member) AS others, 0 AS missed, true AS few_false FROM u""")
def bloom_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users looked up in a filter that holds some of them: no member is missed, and at most one in a hundred others is taken for one."""
    rows = events(spark, sf_dir)
    bits, hashes = sketches.bloom_bits(100_000, 0.001)
    held = sketches.bloom_filter(rows.filter("event_type = 'signup' and value > 60"), "user_id", bits, hashes)
    found = sketches.bloom_query(rows, "user_id", held, bits, hashes)
    users = rows.groupBy("user_id").agg(F.bool_or((F.col("event_type") == "signup") & (F.col("value") > 60)).alias("member")).join(found, "user_id")
    counts = users.agg(F.count_if("member").alias("members"), F.count_if(~F.col("member")).alias("others"), F.count_if(F.col("member") & ~F.col("maybe")).cast("int").alias("missed"), F.count_if(~F.col("member") & F.col("maybe")).alias("false"))
    return counts.select("members", "others", "missed", (F.col("false") * 100 <= F.col("others")).alias("few_false"))


@CASES.add(f"""
    WITH s AS (SELECT user_id, event_type = 'signup' AS added, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) AS place, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id) AS adds
        FROM {EVENTS} WHERE event_type IN ('signup', 'error'))
    SELECT user_id, adds FROM s WHERE place = 1 AND added""")
def cuckoo_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys added by one type and deleted by another that are still there, and how often they were added."""
    rows = events(spark, sf_dir).filter("event_type in ('signup', 'error')").withColumn("added", F.col("event_type") == "signup")
    return dedup.members(rows, ["user_id"], "added", ["sec", "event_id"])


@CASES.add(f"""
    SELECT event_id, coalesce(d IS NULL OR d >= 256, true) AS added, CASE WHEN d < 256 THEN d END AS delta
    FROM (SELECT event_id, sec // 120 - lag(sec // 120) OVER (PARTITION BY user_id, event_type ORDER BY sec, event_id) AS d FROM {EVENTS})""")
def dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats within 256 intervals of two minutes, with the intervals since the last sighting."""
    return dedup.ttl_marks(events(spark, sf_dir), ["user_id", "event_type"], "sec", "event_id", 120).select("event_id", "added", "delta")


@CASES.add(f"""
    WITH v AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM {EVENTS})
    SELECT event_type, count(v) AS n, round(sum(v), 6) AS sum, round(avg(v), 6) AS avg, min(v) AS min, max(v) AS max, round(var_pop(v), 6) AS variance, round(stddev_pop(v), 6) AS sd FROM v GROUP BY 1""")
def nan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics that skip NaN; every seventh value is one."""
    rows = events(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")))
    return rows.groupBy("event_type").agg(*stats.summary("v"))


@CASES.add("""
    WITH a AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS q FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, q[2:4] AS p FROM a)
    SELECT l_orderkey, CAST(len(p) AS BIGINT) AS n, round(coalesce(list_sum(p), 0), 6) AS sum, round(coalesce(list_avg(p), 0), 6) AS avg FROM s""")
def array_slice_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and mean of the second to fourth quantity of each order."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    arrays = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(order)).alias("q"))
    return arrays.select("l_orderkey", stats.array_summary(F.col("q.l_quantity"), 2, 4).alias("s")).select("l_orderkey", "s.*")


@CASES.add(f"""
    WITH v AS (SELECT value AS v, event_type = 'purchase' AS x FROM {EVENTS} WHERE event_type IN ('purchase', 'click')),
    r AS (SELECT x, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM v)
    SELECT count(*) FILTER (x) AS n1, count(*) FILTER (NOT x) AS n2, CAST(sum(k) FILTER (x) - count(*) FILTER (x) * (count(*) FILTER (x) + 1) / 2.0 AS DOUBLE) AS u FROM r""")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank-sum statistic of purchase values against click values."""
    rows = events(spark, sf_dir).filter("event_type in ('purchase', 'click')").withColumn("x", F.col("event_type") == "purchase")
    return stats.mann_whitney(rows, "value", "x").select("n1", "n2", F.col("u").cast("double").alias("u"))


#: DuckDB: the normal distribution function by its power series over odd factorials; beyond eight it is 0 or 1.
NDTR = "(CASE WHEN {x} < -8 THEN 0.0 WHEN {x} > 8 THEN 1.0 ELSE 0.5 + exp(-{x} * {x} / 2) / 2.5066282746310002 * list_sum(list_transform(generate_series(0, 120), lambda k: {x} * pow({x} * {x}, k) / exp(lgamma(2 * k + 2) - lgamma(k + 1) - k * ln(2)))) END)"


@CASES.add(f"""
    WITH v AS (SELECT value, event_type = 'purchase' AS x FROM {EVENTS} WHERE event_type IN ('purchase', 'click') AND NOT isnan(value)),
    r AS (SELECT x, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS place FROM v),
    s AS (SELECT count(*) FILTER (x)::DOUBLE AS n1, count(*) FILTER (NOT x)::DOUBLE AS n2, sum(place) FILTER (x)::DOUBLE AS r1 FROM r), t AS (SELECT sum(pow(n, 3) - n) AS ties FROM (SELECT count(*)::DOUBLE AS n FROM v GROUP BY value)),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s, t),
    z AS (SELECT (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt((1 - ties / (pow(n, 3) - n)) * n1 * n2 * (n + 1) / 12) AS z FROM u)
    SELECT round(z, 6) AS z, round(1 - {NDTR.format(x='z')}, 6) AS p FROM z""")
def mann_whitney_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same test with its z and one-sided p."""
    rows = events(spark, sf_dir).filter("event_type in ('purchase', 'click')").withColumn("x", F.col("event_type") == "purchase")
    return stats.mann_whitney(rows, "value", "x").select(rounded(F.col("z"), "z"), rounded(F.col("p"), "p"))


@CASES.add(f"WITH e AS (SELECT round((value - 50) / 25, 1) AS z FROM {EVENTS}), c AS (SELECT z, count(*) AS n FROM e GROUP BY 1) SELECT z, n, round({NDTR.format(x='z')}, 7) AS p FROM c")
def ndtr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal distribution function at each event's standardised value, to a tenth."""
    z = F.round((F.col("value") - 50) / 25, 1)
    return events(spark, sf_dir).groupBy(z.alias("z")).agg(F.count("*").alias("n")).select("z", "n", F.round(stats.ndtr(F.col("z")), 7).alias("p"))


@CASES.add(f"""
    SELECT user_id, '{{' || string_agg('"' || event_type || '":' || total, ',' ORDER BY event_type) || '}}' AS totals
    FROM (SELECT user_id, event_type, CAST(sum(json_extract(props, '$.k')::BIGINT) AS BIGINT) AS total FROM {EVENTS} GROUP BY 1, 2) GROUP BY 1""")
def merge_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object per user in which equal names are summed."""
    rows = events(spark, sf_dir).select("user_id", F.create_map("event_type", jsonx.find("props", "k").cast("long")).alias("totals"))
    return jsonx.merge_counts(rows, ["user_id"], "totals").withColumn("totals", F.to_json("totals"))


@CASES.add(f"SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_type AS head_kind, value AS head_size FROM {EVENTS}")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested document parsed and flattened into columns."""
    text = F.to_json(F.struct(F.struct(F.col("event_type").alias("kind"), F.col("value").alias("size")).alias("head"), jsonx.find("props", "k").cast("long").alias("k")))
    parsed = events(spark, sf_dir).select("event_id", F.from_json(text, "head struct<kind:string,size:double>, k long").alias("doc"))
    return jsonx.flatten(parsed, "doc", "_")


@CASES.add(f"SELECT event_id, event_type AS kind, CAST(round(value) AS BIGINT) AS size, json_extract_string(props, '$.k') AS key FROM {EVENTS} WHERE value IS NOT NULL")
def json_map_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields renamed and cast by a mapping."""
    mapping = {"kind": ("event_type", "string"), "size": ("value", "long"), "key": ("k", "string")}
    rows = events(spark, sf_dir).withColumn("k", jsonx.find("props", "k")).withColumn("value", F.round("value"))
    return rows.select("event_id", *[F.col(source).try_cast(kind).alias(name) for name, (source, kind) in mapping.items()])


@CASES.add(f"""
    SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k,
        CASE WHEN event_id % 11 = 0 THEN 'json' WHEN json_extract_string(props, '$.k')::BIGINT >= 90 THEN 'range' END AS error
    FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END AS props FROM {EVENTS})""")
def json_validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the rule that they break; every eleventh is cut off."""
    text = F.when(F.col("event_id") % 11 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    rows = events(spark, sf_dir).select("event_id", text.alias("doc"))
    found = rows.select("event_id", jsonx.checked("doc", "k long", {"range": lambda v: v["k"] < 90}).alias("c"))
    return found.select("event_id", F.when(~F.coalesce(F.col("c.error") == "json", F.lit(False)), F.col("c.value.k")).alias("k"), F.col("c.error").alias("error"))


@CASES.add(f"SELECT event_type, CAST(sum(json_extract(props, '$.k')::BIGINT) AS BIGINT) AS total, count(json_extract(props, '$.missing')) AS missing FROM {EVENTS} GROUP BY 1")
def json_path_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path that is there and one that is not."""
    return events(spark, sf_dir).groupBy("event_type").agg(F.sum(jsonx.find("props", "k").cast("long")).alias("total"), F.count(jsonx.find("props", "missing")).alias("missing"))


@CASES.add(f"""
    SELECT event_type, f.name, count(*) AS present, f.kind, count(*) = any_value(total) AS required FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS total FROM {EVENTS}) e,
        (VALUES ('k', 'integer'), ('value', 'double')) f(name, kind) WHERE f.name = 'value' OR event_id % 3 <> 0 GROUP BY 1, 2, 4""")
def schema_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fields each type's messages have, with kind and whether all have them; a third lack one."""
    fields = F.array(
        F.when(F.col("event_id") % 3 != 0, F.struct(F.lit("k").alias("name"), F.schema_of_variant(F.variant_get(F.parse_json("props"), "$.k", "variant")).alias("type"))),
        F.struct(F.lit("value").alias("name"), F.lit("DOUBLE").alias("type")),
    )
    rows = events(spark, sf_dir)
    seen = rows.select("event_type", F.explode(F.filter(fields, lambda f: f.isNotNull())).alias("f")).groupBy("event_type", "f.name").agg(F.count("*").alias("present"), F.min("f.type").alias("lo"), F.max("f.type").alias("hi"))
    kind = F.when(F.col("lo") != F.col("hi"), "mismatch").when(F.col("lo") == "BIGINT", "integer").when(F.col("lo") == "DOUBLE", "double").otherwise("string")
    totals = rows.groupBy("event_type").agg(F.count("*").alias("total"))
    return seen.join(totals, "event_type").select("event_type", "name", "present", kind.alias("kind"), (F.col("present") == F.col("total")).alias("required"))


@CASES.add("SELECT conv_id, CAST(len(list(role)) AS BIGINT) AS turns, array_to_string(list(role ORDER BY turn), ',') AS roles, max(turn) AS last FROM conversations GROUP BY 1")
def ordered_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered arrays of a conversation's roles."""
    made = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return made.select("conv_id", F.size("t").cast("long").alias("turns"), F.array_join("t.role", ",").alias("roles"), F.array_max("t.turn").alias("last"))


@CASES.add("SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE event_type IN ('click', 'view') AND event_id % 100 < 3 AND value IS NOT NULL GROUP BY 1")
def matcher_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matcher: two types, a sample of the ids, a field that must be there."""
    rows = events(spark, sf_dir).filter("event_type in ('click', 'view') and event_id % 100 < 3 and value is not null")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), rounded(F.sum("value"), "total"))


@CASES.add("SELECT c_custkey, md5(c_name) AS md5, sha256(c_name) AS sha256, substr(sha1(c_name), 1, 8) AS sha1 FROM customer")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of names."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.md5("c_name").alias("md5"), F.sha2("c_name", 256).alias("sha256"), F.substring(F.sha1("c_name"), 1, 8).alias("sha1"))


@CASES.add("SELECT 16 AS buckets, count(DISTINCT event_id) AS ids, count(*) AS n, true AS even FROM events")
def hash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How evenly a 64-bit hash deals events to sixteen buckets: even if none is five standard deviations off its share."""
    bucket = F.pmod(F.xxhash64("event_id"), F.lit(16)).cast("int")
    dealt = events(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count_distinct("event_id").alias("ids"), F.count("*").alias("n"))
    share = F.sum("ids") / 16
    even = F.max("ids") <= share + 5 * F.sqrt(share)
    return dealt.agg(F.count("*").cast("int").alias("buckets"), F.sum("ids").alias("ids"), F.sum("n").alias("n"), (even & (F.min("ids") >= share - 5 * F.sqrt(share))).alias("even"))


@CASES.add(f"""
    SELECT event_type, 'message ' || event_type || ' {{' || ' ' || CASE WHEN event_type = 'view' THEN 'optional' ELSE 'required' END || ' int64 k; required double value; }}' AS declaration FROM {EVENTS} GROUP BY 1""")
def schema_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's fields written as a declaration: required if all of its messages have them."""
    k = F.when((F.col("event_type") != "view") | (F.col("event_id") % 2 == 0), jsonx.find("props", "k"))
    fields = F.array(F.struct(F.lit("k").alias("name"), F.lit("int64").alias("kind"), k.isNotNull().alias("there")), F.struct(F.lit("value").alias("name"), F.lit("double").alias("kind"), F.col("value").isNotNull().alias("there")))
    counts = events(spark, sf_dir).select("event_type", F.explode(fields).alias("f")).groupBy("event_type", "f.name", "f.kind").agg(F.bool_and("f.there").alias("all"))
    line = F.concat(F.when(F.col("all"), "required ").otherwise("optional "), F.col("kind"), F.lit(" "), F.col("name"), F.lit(";"))
    made = counts.groupBy("event_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"]), " ").alias("body"))
    return made.select("event_type", F.concat(F.lit("message "), F.col("event_type"), F.lit(" { "), F.col("body"), F.lit(" }")).alias("declaration"))


@CASES.add("""
    WITH t AS (SELECT DISTINCT conv_id, role FROM conversations), n AS (SELECT role, count(*) AS n FROM conversations GROUP BY 1)
    SELECT role, n.n AS turns, count(conv_id) AS conversations FROM n JOIN t USING (role) GROUP BY 1, 2""")
def role_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and conversations of each role."""
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"))


@CASES.add("""
    SELECT label, count(*) AS n, round(avg(embedding[1]), 6) AS first, round(max(list_sum(list_transform(embedding, lambda x: x * x))), 4) AS norm FROM embeddings GROUP BY 1""")
def vector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by label: the first coordinate's mean and the largest squared norm."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), rounded(F.avg(F.get("embedding", F.lit(0)).cast("double")), "first"), rounded(F.max(norm), "norm", 4))
