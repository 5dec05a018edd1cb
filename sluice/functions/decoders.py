"""Grammars of web servers, databases and packet filters, and what messages need before they are analysed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.grammar import ADDRESS, Grammar, literal

_QUOTED = r'(?:[^"\\]|\\.)*'
#: Apache's format letters: name, type and pattern. Fixed values.
APACHE = {
    "a": ("remote_addr", "string", ADDRESS), "A": ("server_addr", "string", ADDRESS), "B": ("body_bytes_sent", "long", r"\d+"), "b": ("body_bytes_sent", "long", r"\d+|-"), "D": ("request_time", "long", r"\d+"), "f": ("request_filename", "string", r"\S+"),
    "h": ("remote_addr", "string", r"\S+"), "H": ("server_protocol", "string", r"\S+"), "k": ("connection_requests", "long", r"\d+"), "l": ("remote_ident", "string", r"\S+"), "L": ("request_log_id", "string", r"\S+"), "m": ("request_method", "string", r"[A-Z]+"),
    "p": ("server_port", "int", r"\d+"), "P": ("pid", "int", r"\d+"), "q": ("query_string", "string", r"\S*"), "r": ("request", "string", _QUOTED), "R": ("request_handler", "string", r"\S+"), "s": ("status", "int", r"\d{3}"), "t": ("time", "string", r"\[[^\]]+\]"),
    "T": ("request_seconds", "long", r"\d+"), "u": ("remote_user", "string", r"\S+"), "U": ("uri", "string", r"[^?\s]*"), "v": ("server_name", "string", r"\S+"), "V": ("server_name", "string", r"\S+"), "X": ("connection_status", "string", r"[-+X]"),
    "I": ("bytes_received", "long", r"\d+"), "O": ("bytes_sent", "long", r"\d+"),
}


def apache_log(template: str) -> Grammar:
    """The grammar of an access log format with %letters; %{Name}i and %{Name}o are headers."""
    out, at = [], 0
    for m in re.finditer(r"%(?:[<>!,\d]*)(?:\{([^}]+)\})?([A-Za-z%])", template):
        out.append(literal(template[at : m.start()]))
        if m[2] == "%":
            out.append(literal("%"))
        elif m[1]:
            out.append((f"{m[1].lower().replace('-', '_')}", "string", _QUOTED))
        else:
            out.append(APACHE[m[2]])
        at = m.end()
    return [*out, literal(template[at:])]


#: Levels of a web server's error log by severity: fixed values.
LEVELS = ("emerg", "alert", "crit", "error", "warn", "notice", "info", "debug")


def nginx_error() -> Grammar:
    """time [level] pid#tid: *connection message"""
    return [
        ("time", "string", r"\d{4}/\d\d/\d\d \d\d:\d\d:\d\d"), literal(" ["), ("level", "string", "|".join(LEVELS)), literal("] "), ("pid", "int", r"\d+"), literal("#"), ("tid", "int", r"\d+"), literal(": "),
        (None, "string", r"(?:\*"), ("connection", "long", r"\d+"), (None, "string", r" )?"), ("message", "string", r".*"),
    ]


#: Properties of a log daemon's templates: name, type and pattern. Fixed values.
PROPERTIES = {
    "PRI": ("pri", "int", r"\d{1,3}"), "TIMESTAMP": ("time", "string", r"[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d|\d{4}-\d\d-\d\dT\S+"), "timegenerated": ("time", "string", r"[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d|\d{4}-\d\d-\d\dT\S+"),
    "HOSTNAME": ("host", "string", r"\S+"), "FROMHOST": ("host", "string", r"\S+"), "syslogtag": ("tag", "string", r"[^\s:]+:?"), "programname": ("program", "string", r"[^\s\[:]+"), "procid": ("pid", "string", r"\d+|-"), "app-name": ("program", "string", r"\S+"),
    "syslogseverity": ("severity", "int", r"\d"), "syslogseverity-text": ("severity_name", "string", r"[a-z]+"), "syslogfacility": ("facility", "int", r"\d+"), "syslogfacility-text": ("facility_name", "string", r"[a-z0-9]+"), "msg": ("message", "string", r".*"), "rawmsg": ("message", "string", r".*"),
}


def daemon_template(template: str) -> Grammar:
    """The grammar of a log daemon's template, of %property:options% and literals."""
    out, at = [], 0
    for m in re.finditer(r"%([\w-]+)(?::[^%]*)?%", template):
        out.append(literal(template[at : m.start()]))
        out.append(PROPERTIES.get(m[1], (m[1].replace("-", "_"), "string", r"\S*")))
        at = m.end()
    return [*out, literal(template[at:])]


def yearless_time(text: Column, year: Column) -> Column:
    """A time such as `May  1 10:00:00`, which has no year, in that year."""
    return F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), F.regexp_replace(text, r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))


def packet_filter(line: Column) -> Column:
    """A struct of a packet filter's comma-separated line; the parts that a version or protocol lacks are null."""
    part = F.split(line, ",")
    at = lambda k: F.get(part, F.lit(k))
    v4 = at(8) == "4"
    pick = lambda four, six: F.when(v4, at(four)).otherwise(at(six))
    protocol = pick(16, 12)
    ported = protocol.isin("tcp", "udp")
    port = lambda k: F.when(ported, pick(20 + k, 17 + k).try_cast("int"))
    return F.when(
        (F.size(part) >= 9) & at(6).isin("pass", "block") & at(7).isin("in", "out") & at(8).isin("4", "6"),
        F.struct(
            at(0).try_cast("int").alias("rule_number"), F.nullif(at(2), F.lit("")).alias("anchor"), at(3).try_cast("long").alias("tracker"), at(4).alias("interface"), at(5).alias("reason"), at(6).alias("action"), at(7).alias("direction"),
            at(8).try_cast("int").alias("ip_version"), protocol.alias("protocol"), pick(17, 14).try_cast("int").alias("length"), pick(18, 15).alias("source"), pick(19, 16).alias("destination"),
            port(0).alias("source_port"), port(1).alias("destination_port"), F.when(protocol == "tcp", pick(23, 20)).alias("tcp_flags"),
        ),
    )


def mariadb_slow_query() -> Grammar:
    """A slow query record with thread and scan marks; the user line may be missing."""
    blank = (None, "string", r"\s+")
    return [
        (None, "string", r"(?:# User@Host: "), ("user", "string", r"[^\[\s]+"), (None, "string", r"\[[^\]]*\] @ "), ("host", "string", r"\S*"), (None, "string", r" \[[^\]]*\]\n)?"),
        literal("# Thread_id: "), ("thread_id", "long", r"\d+"), (None, "string", r"\s+Schema: "), ("schema", "string", r"\S*"), (None, "string", r"\s+QC_hit: "), ("qc_hit", "string", r"Yes|No"), (None, "string", r"\n"),
        literal("# Query_time: "), ("query_time", "double", r"[\d.]+"), blank, literal("Lock_time: "), ("lock_time", "double", r"[\d.]+"), blank, literal("Rows_sent: "), ("rows_sent", "long", r"\d+"), blank,
        literal("Rows_examined: "), ("rows_examined", "long", r"\d+"), (None, "string", r"\n(?:# Full_scan: "), ("full_scan", "string", r"Yes|No"), (None, "string", r"[^\n]*\n)?(?:use [^\n]*\n)?SET timestamp="), ("timestamp", "long", r"\d+"), literal(";\n"), ("statement", "string", r".*"),
    ]


_V6_PART = r"[0-9a-fA-F]{1,4}"
_V6 = rf"^(?:(?:{_V6_PART}:){{7}}{_V6_PART}|(?=(?:[^:]*:){{2,7}}[^:]*$)(?:{_V6_PART}(?::{_V6_PART})*)?::(?:{_V6_PART}(?::{_V6_PART})*)?)$"
_V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"
_HOST = r"^(?=.{1,253}$)(?!.*\.\d+$)(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$"


def address_kind(text: Column) -> Column:
    """ipv4, ipv6 or hostname, null for text that is none of them."""
    return F.when(text.rlike(_V4), "ipv4").when(text.rlike(_V6), "ipv6").when(text.rlike(_HOST), "hostname")


def ipv6_full(text: Column) -> Column:
    """The eight groups of four digits of an address, in lower case; null for other text."""
    halves = F.split(F.lower(text), "::")
    groups = lambda k: F.filter(F.split(F.coalesce(F.get(halves, F.lit(k)), F.lit("")), ":"), lambda g: g != "")
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(groups(0)) - F.size(groups(1)))
    return F.when(text.rlike(_V6), F.array_join(F.transform(F.concat(groups(0), zeros, groups(1)), lambda g: F.lpad(g, 4, "0")), ":"))


def principal(categories: list[tuple[str, str, str, str, str, str, dict[str, str]]], document: Column) -> Column:
    """A struct (category, subject, object, source) of the first category whose field matches; null where one of the three is missing.

    A category: name, paths of the selecting field, its pattern, the subject, the object and the source, and other names of subjects. An object that isn't a path is fixed.
    """
    read = lambda path: F.get_json_object(document, path) if path.startswith("$") else F.lit(path)
    out = F.lit(None).cast("struct<category:string,subject:string,object:string,source:string>")
    for name, field, pattern, subject, target, source, names in reversed(categories):
        who = read(subject)
        for old, new in names.items():
            who = F.when(read(subject) == old, new).otherwise(who)
        found = F.struct(F.lit(name).alias("category"), who.alias("subject"), read(target).alias("object"), read(source).alias("source"))
        whole = F.when(who.isNotNull() & read(target).isNotNull() & read(source).isNotNull(), found)
        out = F.when(F.coalesce(read(field).rlike(pattern), F.lit(False)), whole).otherwise(out)
    return out


def mutate(df: DataFrame, rename: dict[str, str] | None = None, drop: list[str] | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """Columns renamed, scrubbed and given defaults where they are null or missing."""
    made = df.withColumnsRenamed(rename or {}).drop(*(drop or []))
    for name, value in (defaults or {}).items():
        made = made.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in made.columns else F.lit(value))
    return made


#: Types of a message schema's text by Spark type: fixed values.
KINDS = {"boolean": T.BooleanType(), "int32": T.IntegerType(), "int64": T.LongType(), "int96": T.TimestampType(), "float": T.FloatType(), "double": T.DoubleType(), "binary": T.BinaryType(), "fixed_len_byte_array": T.BinaryType()}
ANNOTATIONS = {"UTF8": T.StringType(), "JSON": T.StringType(), "ENUM": T.StringType(), "DATE": T.DateType(), "TIMESTAMP_MILLIS": T.TimestampType(), "TIMESTAMP_MICROS": T.TimestampType(), "INT_8": T.ByteType(), "INT_16": T.ShortType()}


def message_schema(text: str) -> T.StructType:
    """The Spark schema of `message name { required int64 id; optional group g { ... } repeated ... }`."""
    words = re.findall(r"[{};]|\([^)]*\)|[^\s{};()]+", text)
    at = 0

    def group() -> T.StructType:
        nonlocal at
        fields = []
        while words[at] != "}":
            rule, kind, at = words[at], words[at + 1], at + 2
            if kind == "group":
                name, at = words[at], at + 1
                while words[at] != "{":
                    at += 1
                at += 1
                made = group()
                at += 1
            else:
                name, at = words[at], at + 1
                made = KINDS[kind]
                while words[at] != ";":
                    made, at = ANNOTATIONS.get(words[at].strip("()"), made), at + 1
                at += 1
            fields.append(T.StructField(name, T.ArrayType(made) if rule == "repeated" else made, rule == "optional"))
        return T.StructType(fields)

    if words[:1] != ["message"] or words[2] != "{":
        raise ValueError("a schema begins with `message name {`")
    at = 3
    return group()


def hours(seconds: Column) -> Column:
    """A session's length in hours; 0 unless it is between a second and 180 days."""
    return F.when((seconds >= 1) & (seconds < 180 * 86400), seconds / 3600.0).otherwise(0.0)


#: Times as programs write them, without the day of the week: fixed values.
TIMES = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "dd/MMM/yyyy:HH:mm:ss Z", "dd MMM yyyy HH:mm:ss Z", "MMM d HH:mm:ss yyyy", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyMMdd H:mm:ss", "yyyy/MM/dd HH:mm:ss",
)


def any_time(text: Column) -> Column:
    """The first of the known formats that a text fits; the name of a day and a zone's name are left out."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Z][a-z]{2},? +", ""), r" (?:GMT|UTC)$", "")
    spaced = F.regexp_replace(plain, r" +", " ")
    return F.coalesce(*[F.try_to_timestamp(spaced, F.lit(t)) for t in TIMES], F.try_to_timestamp(F.concat(spaced, F.lit(" +0000")), F.lit("dd MMM yyyy HH:mm:ss Z")))


def unescape_c(text: Column) -> Column:
    r"""Text whose escapes (\\n, \\t, \\x41, \\101) are written out; bytes are read as UTF-8."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)\\x[0-9A-Fa-f]{2}|\\[0-3][0-7]{2}|\\.|[^\\]+"), 0)
    named = {"n": "0A", "t": "09", "r": "0D", "0": "00", "a": "07", "b": "08", "f": "0C", "v": "0B"}

    def byte(t: Column) -> Column:
        out = F.hex(F.encode(F.when(t.startswith("\\"), F.substring(t, 2, 1)).otherwise(t), "UTF-8"))
        for letter, code in named.items():
            out = F.when(t == "\\" + letter, code).otherwise(out)
        out = F.when(t.rlike(r"^\\[0-3][0-7]{2}$"), F.lpad(F.conv(F.substring(t, 2, 3), 8, 16), 2, "0")).otherwise(out)
        return F.when(t.rlike(r"^\\x[0-9A-Fa-f]{2}$"), F.substring(t, 3, 2)).otherwise(out)

    return F.decode(F.unhex(F.array_join(F.transform(tokens, byte), "")), "UTF-8")


def ping(document: Column | str) -> Column:
    """A struct of what a client's document says about itself, null where it doesn't: build, channel, system, locale, default browser, days of the profile and add-ons."""
    read = lambda path: F.get_json_object(document, path)
    return F.struct(
        read("$.environment.build.buildId").alias("build_id"), read("$.environment.settings.update.channel").alias("channel"), read("$.environment.system.os.name").alias("os"), read("$.environment.settings.locale").alias("locale"),
        read("$.environment.settings.isDefaultBrowser").try_cast("boolean").alias("is_default"), read("$.environment.profile.creationDate").try_cast("long").alias("profile_day"),
        F.coalesce(F.size(F.json_object_keys(read("$.environment.addons.activeAddons"))), F.lit(0)).alias("addons"), hours(F.coalesce(read("$.payload.info.subsessionLength").try_cast("long"), F.lit(0))).alias("hours"),
    )


def user_name(*columns: str) -> Column:
    """The user's name out of the first column that has one: what stands before the @ of an address, also within a directory entry, else the last part of a role's path."""
    found = []
    for name in columns:
        address, role = F.regexp_extract(name, r"(?:^|[=<,;\s])([^@=<,;\s]+)@[^@\s]+", 1), F.regexp_extract(name, r"^arn:[^/]*/(?:.*/)?([^/]+)$", 1)
        found += [F.nullif(address, F.lit("")), F.nullif(role, F.lit(""))]
    return F.coalesce(*found)


def set_headers(df: DataFrame, rules: dict[str, tuple]) -> DataFrame:
    """df with header columns set by rules, all from the columns as they were before.

    ("value", x) sets a constant, ("field", name) another column, ("first", [names], default) the first that isn't null, and ("template",
    text) a text in which %{name} stands for a column, empty where that is null.
    """

    def made(kind: str, *rest: object) -> Column:
        if kind == "value":
            return F.lit(rest[0])
        if kind == "field":
            return F.col(str(rest[0]))
        if kind == "first":
            return F.coalesce(*[F.col(c) for c in rest[0]], *[F.lit(d) for d in rest[1:]])
        if kind == "template":
            parts = re.split(r"%\{([^}]*)\}", str(rest[0]))
            return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])
        raise ValueError(f"no such rule: {kind}")

    return df.withColumns({name: made(*rule) for name, rule in rules.items()})
