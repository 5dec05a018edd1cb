"""Grammars of log lines as regular expressions that are built when the plan is made.

A grammar is a list of (name, type, pattern); `parse` turns it into one struct of typed fields, null
where the line doesn't match. Ordered alternatives are tried first to last.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of printf conversions.
_CONVERSIONS = {"d": (r"[-+]?\d+", "long"), "i": (r"[-+]?\d+", "long"), "u": (r"\d+", "long"), "x": (r"[0-9a-fA-F]+", "string"), "f": (r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", "double"), "g": (r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", "double"), "c": (".", "string"), "s": (r".*?", "string")}
#: Patterns of the variables of an access log format; others are text without the next literal.
_ACCESS = {
    "remote_addr": (r"[0-9a-fA-F.:]+", "string"), "remote_user": (r"\S+", "string"), "status": (r"\d{3}", "int"), "body_bytes_sent": (r"\d+|-", "long"), "bytes_sent": (r"\d+|-", "long"),
    "request_time": (r"\d+\.\d+", "double"), "time_local": (r"[^\]]+", "string"), "request": (r'(?:[^"\\]|\\.)*', "string"), "http_referer": (r'(?:[^"\\]|\\.)*', "string"), "http_user_agent": (r'(?:[^"\\]|\\.)*', "string"),
}
#: Conversions of these names hold an address of either version and not any text.
ADDRESS = r"[0-9a-fA-F.:]*[.:][0-9a-fA-F.:]+(?:%\w+)?"
_ADDRESSES = ("ip", "src", "dst")
Grammar = list[tuple[str | None, str, str]]
_MARK, _BREAK = "\x02", "\x01"


def literal(text: str) -> tuple[None, str, str]:
    return None, "string", re.escape(text)


def printf(template: str, names: list[str]) -> Grammar:
    """The grammar of what a printf template writes; names are its conversions in order."""
    out, at, left = [], 0, list(names)
    for m in re.finditer(r"%(%|([-+ 0#]*\d*)(?:\.\d+)?(?:l|ll|h|z)?([diuxfgcs]))", template):
        out.append(literal(template[at : m.start()]))
        if m[1] == "%":
            out.append(literal("%"))
        else:
            name, (pattern, kind) = left.pop(0), _CONVERSIONS[m[3]]
            if kind == "string":
                pattern = ADDRESS if name in _ADDRESSES else pattern
                out.append((name, kind, pattern))
            else:  # numbers may be padded to their width
                pad = (None, "string", r"\x20*")
                out += [pad, (name, kind, pattern), pad] if m[2] else [(name, kind, pattern)]
        at = m.end()
    return [*out, literal(template[at:])]


def access_log(template: str) -> Grammar:
    """The grammar of an access log format with $variables."""
    out, at = [], 0
    for m in re.finditer(r"\$(\w+)", template):
        out.append(literal(template[at : m.start()]))
        pattern, kind = _ACCESS.get(m[1], (r"\S*", "string"))
        out.append((m[1], kind, pattern))
        at = m.end()
    return [*out, literal(template[at:])]


def syslog() -> Grammar:
    """<pri>time host program[pid]: message"""
    return [
        literal("<"), ("pri", "int", r"\d{1,3}"), literal(">"), ("time", "string", r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[-+]\d\d:?\d\d)?"), literal(" "), ("host", "string", r"\S+"), literal(" "),
        ("program", "string", r"[^\s\[:]+"), (None, "string", r"(?:\["), ("pid", "int", r"\d+"), (None, "string", r"\])?: "), ("message", "string", r".*"),
    ]


def pattern(grammar: Grammar) -> str:
    return "^" + "".join(f"({p})" if name else p for name, _, p in grammar) + "$"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed a single time however often it is used."""
    return F.transform(F.array(value), use)[0]


def parse(line: Column, grammar: Grammar) -> Column:
    """A struct of the named fields, null where the line doesn't match.

    One pass of the pattern writes the fields behind a mark; lines that hold the mark or the
    separator themselves don't match.
    """
    named = [(name, kind) for name, kind, _ in grammar if name]
    marked = F.regexp_replace(line, f"(?s){pattern(grammar)}", _MARK + _BREAK.join(f"${k + 1}" for k in range(len(named))))

    def fields(parts: Column) -> Column:
        texts = [F.get(parts, F.lit(k)) for k in range(len(named))]
        if texts:
            texts[0] = F.substring(texts[0], F.lit(2), F.char_length(texts[0]))
        made = F.struct(*[t.try_cast(kind).alias(name) for t, (name, kind) in zip(texts, named, strict=True)]) if named else F.struct(F.lit(True).alias("matched"))
        return F.when(F.get(parts, F.lit(0)).startswith(_MARK) & ~line.contains(_MARK) & ~line.contains(_BREAK), made)

    return once(F.split(marked, _BREAK), fields)


def first_match(line: Column, grammars: list[tuple[str, Grammar]], names: list[str]) -> Column:
    """A struct (rule, fields as a map of text) of the first grammar that matches, else null."""
    out = F.lit(None).cast("struct<rule:string,fields:map<string,string>>")
    for rule, grammar in reversed(grammars):
        own = [n for n, _, _ in grammar if n and n in names]

        def chosen(made: Column, rule: str = rule, own: list[str] = own) -> Column:
            fields = F.create_map(*[x for n in own for x in (F.lit(n), made[n].cast("string"))]) if own else F.create_map().cast("map<string,string>")
            return F.when(made.isNotNull(), F.struct(F.lit(rule).alias("rule"), fields.alias("fields")))

        out = F.coalesce(once(parse(line, grammar), _single(chosen)), out)
    return out


def _single(use: Callable[..., Column]) -> Callable[[Column], Column]:
    """A function of one column, as transform tells them by their parameters."""
    return lambda value: use(value)


def last_wins(entries: Column) -> Column:
    """A map of an array of structs (k, v); of repeated keys the last counts, null keys are left out."""
    known = F.filter(F.reverse(entries), lambda e: e["k"].isNotNull())
    mapped = lambda e: F.map_from_arrays(F.array_distinct(e["k"]), F.transform(F.array_distinct(e["k"]), lambda k: F.get(e["v"], (F.array_position(e["k"], k) - 1).cast("int"))))
    return once(known, mapped)


def logfmt(line: Column) -> Column:
    """key=value pairs as a map: values plain or quoted with JSON's escapes, `true` for bare keys; of repeated keys the last counts."""
    tokens = F.regexp_extract_all(line, F.lit(r'([^\s="]+)(?:=("(?:[^"\\]|\\.)*"|[^\s"]*))?'), 0)

    def value(text: Column) -> Column:
        plain = F.regexp_replace(F.substring(text, F.lit(2), F.char_length(text) - 2), r"\\(.)", "$1")
        return F.when(text.startswith('"'), F.coalesce(F.get_json_object(F.concat(F.lit('{"t":'), text, F.lit("}")), "$.t"), plain)).otherwise(text)

    pair = lambda t: F.struct(F.regexp_extract(t, "^[^=]+", 0).alias("k"), F.when(t.contains("="), value(F.regexp_extract(t, "(?s)^[^=]+=(.*)$", 1))).otherwise("true").alias("v"))
    return last_wins(F.transform(tokens, pair))


def query_map(url: Column) -> Column:
    """The query string as a map of decoded values; of repeated names the last counts."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("="))
    pair = lambda p: F.struct(F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), F.try_url_decode(F.regexp_extract(p, "(?s)^[^=]*=?(.*)$", 1)).alias("v"))
    return last_wins(F.transform(pairs, pair))


#: What agents call themselves: (pattern of the version, name); the first that is there wins. Fixed values.
BROWSERS = (
    (r"Opera Mini.*Version/(\d+)", "Opera Mini"), (r"Opera Mobi.*Version/(\d+)", "Opera Mobi"), (r"Opera.*Version/(\d+)", "Opera"), (r"(?:OPR|Opera)/(\d+)", "Opera"), (r"(?:Edge|Edg|EdgA)/(\d+)", "Edge"),
    (r"AndroidSync (\d+)", "FxSync"), (r"iOS-Sync/(\d+)", "FxSync"), (r"MSIE (\d+)", "MSIE"), (r"MSIE()", "MSIE"), (r"Trident/.*rv:(\d+)", "MSIE"), (r"Chrome/(\d+)", "Chrome"), (r"Firefox/(\d+)", "Firefox"), (r"Safari/(\d+)", "Safari"),
)
#: Systems by what names them, in this order: fixed values.
SYSTEMS = (
    ("Windows NT 10.0", "Windows 10"), ("Windows NT 6.3", "Windows 8.1"), ("Windows NT 6.2", "Windows 8"), ("Windows NT 6.1", "Windows 7"), ("Windows NT 6.0", "Windows Vista"), ("Windows NT 5.1", "Windows XP"), ("Windows", "Windows"),
    ("iPad", "iPad"), ("iPhone", "iPhone"), ("iPod", "iPod"), ("iOS-Sync", "iOS"), ("Android", "Android"), ("Macintosh", "Macintosh"), ("Mobile; rv:", "FirefoxOS"), ("Tablet; rv:", "FirefoxOS"), ("Linux", "Linux"),
)


def user_agent(text: Column) -> Column:
    """A struct (browser, version, os), each null where the text doesn't say.

    The first name of each table that is there wins; its pattern alone reads the version.
    """
    browser, version = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, name in reversed(BROWSERS):
        # A pattern's own words are looked for before the pattern is tried: most agents lack most of them.
        word = re.match(r"[\w -]+|\(\?:(\w+)", pattern)
        plain = text.contains(word[0]) if word and not word[1] else F.lit(True)
        found = plain & text.rlike(pattern)
        browser, version = F.when(found, name).otherwise(browser), F.when(found, F.regexp_extract(text, pattern, 1)).otherwise(version)
    system = F.lit(None).cast("string")
    for mark, name in reversed(SYSTEMS):
        system = F.when(text.contains(mark), name).otherwise(system)
    return F.struct(browser.alias("browser"), version.try_cast("int").alias("version"), system.alias("os"))


def hive_name(name: str) -> str:
    """A column name in lower case with underscores between words; other characters become underscores."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return re.sub(r"[^a-z0-9_]", "_", spaced.lower())
