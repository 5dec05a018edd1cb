"""Injection into queries and pages: parameters are cut into tokens, and shapes of tokens, not words alone, decide.

A parameter may be pasted into a statement as it is, inside single quotes or inside double ones; each way is looked at. What a
shape needs is what an attack needs to work: a condition of its own after a closed quote, a second statement, a joined one, a comment
that cuts off the rest, or a call that waits. For pages it is a tag that runs code, an attribute that does, or an address that does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of words of a query language, one letter each: fixed values. Other words are names (n).
WORDS = {
    "U": "union intersect except", "S": "select insert update delete drop alter create truncate exec execute declare merge replace grant shutdown", "L": "or and xor not having where rlike like between in is regexp",
    "F": "sleep benchmark waitfor pg_sleep load_file char concat group_concat substring ascii extractvalue updatexml xp_cmdshell version database user", "K": "from into outfile dumpfile values set table order group by limit all distinct null as case when then else end delay",
}
_TOKEN = r"""'(?:[^'\\]|\\.|'')*'?|"(?:[^"\\]|\\.)*"?|/\*(?s:.*?)(?:\*/|$)|--[^\n]*|#[^\n]*|0x[0-9a-f]+|\d+(?:\.\d+)?|@*[\p{L}_][\w.$]*|\|\||&&|[<>=!|&^~*/%+-]+|[(),;]|\S"""
#: Shapes of token classes: s text, 1 number, n name, o operator, c comment, and the letters above. Fixed values of this detector.
VALUE = r"\(*[s1nF](?:\([^)]*\))?\)*"
SHAPES = (
    rf"^{VALUE}(?:[L]|o){VALUE}?L*\(*[s1nF]", rf"^[s1]\)*L+\(*[s1nFS]", r"U[K]*\(*S(?:[1sKFo(]|n[,(oK])", r";S(?:[KF]|n(?:[(;,oc]|$))", r";F", rf"^[s1n]\)*(?:[;K1n,]*)c$", r"[oL(,;=]F\(", rf"^[s1]\)*[oL]+\(+S", r"^[s1]\)*K{2}[1,n]+c", r"[SK]K?n*KKs", r"^[s1]\)*F[K(]",
)
_RUNS = "script|iframe|object|embed|applet|base|form|meta|link|svg|math|frame|frameset|style|xml|import|isindex|video|audio|img|body|input|details|marquee|template"
_CODE = r"(?:javascript|vbscript|livescript|data\s*:\s*text/html)\s*:?"


def plain(text: Column) -> Column:
    """A parameter's text, decoded twice, in lower case, without characters that browsers and servers skip."""
    once = F.coalesce(F.try_url_decode(text), text)
    twice = F.coalesce(F.try_url_decode(once), once)
    return F.regexp_replace(F.lower(twice), r"[\x00​]", "")


def shape(text: Column) -> Column:
    """The classes of a text's tokens, one letter each."""
    tokens = F.regexp_extract_all(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), F.lit(_TOKEN), 0)

    def kind(token: Column) -> Column:
        out = F.when(token.rlike("^['\"]"), "s").when(token.rlike(r"^(/\*|--|#)"), "c").when(token.rlike(r"^(0x|\d)"), "1")
        for letter, words in WORDS.items():
            out = out.when(token.isin(*words.split()), letter)
        return out.when(token.isin("||", "&&"), "L").when(token.rlike(r"^[<>=!|&^~*/%+-]"), "o").when(token.rlike(r"^[(),;]$"), token).when(token.rlike(r"^[@\p{L}_]"), "n").otherwise("?")

    return F.regexp_replace(F.array_join(F.transform(tokens, kind), ""), "s{2,}", "s")


def sql_injection(text: Column) -> Column:
    """Whether a parameter would change the statement that it is pasted into."""

    def check(low: Column) -> Column:
        ways = [low] + [F.when(low.contains(quote), F.concat(F.lit(quote), low)) for quote in ("'", '"')]
        hit = F.lit(False)
        for k, way in enumerate(ways):
            own = F.transform(F.array(shape(way)), lambda s: F.array(*[s.rlike(p) for p in (SHAPES[2:5] + SHAPES[6:8] + SHAPES[9:10] if not k else SHAPES)]))[0]
            bare = shape(way).rlike(r"^1\)*L+\(*[1sn]o\(*[1sn]") if not k else F.lit(False)
            hit = hit | F.coalesce(F.exists(own, lambda x: x), F.lit(False)) | F.coalesce(bare, F.lit(False))
        return hit

    return F.coalesce(F.transform(F.array(plain(text)), check)[0], F.lit(False))


def script_injection(text: Column) -> Column:
    """Whether a parameter would run code in a page that shows it: as text, in a quoted attribute, or as an address."""

    def check(low: Column) -> Column:
        seen = F.regexp_replace(F.regexp_replace(low, r"&#x?0*(?:9|a|d|10|13);?|[\t\r\n\f]", ""), "/\\*.*?\\*/", "")
        entity = F.regexp_replace(F.regexp_replace(seen, r"&#x0*3a;?|&#0*58;?|&colon;", ":"), r"&lt;?", "<")
        tag = entity.rlike(rf"<[/!?]*\s*(?:{_RUNS})\b") & (entity.rlike(rf"<\s*(?:script|iframe|object|embed|applet|base|svg|frame|frameset|import|isindex|meta|link|style|xml|template)\b[^<]*(?:>|/|\s|$)") | entity.rlike(r"<[^>]*[\s/\"']on[a-z]{3,}\s*="))
        attribute = entity.rlike(r"[\"'`][\s/]*(?:[\w-]+\s*=\s*[\"']?[^\"'>]*[\"'\s/]+)*on[a-z]{3,}\s*=\s*[^\s=]") | entity.rlike(r"^\s*on[a-z]{3,}\s*=.*[(`]") | entity.rlike(r"[\"'`][\s/]*style\s*=.*(?:expression|url)\s*\(")
        address = entity.rlike(rf"(?:^\s*|=\s*[\"']?\s*|url\(\s*[\"']?){_CODE}") & entity.rlike(r"[:(]")
        return tag | attribute | address | entity.rlike(r"<!\[cdata\[|<!entity|<\?xml-stylesheet")

    return F.coalesce(F.transform(F.array(plain(text)), check)[0], F.lit(False))


def kind(text: Column) -> Column:
    """`xss` or `sqli` for a parameter that looks like one, else null."""
    return F.when(script_injection(text), "xss").when(sql_injection(text), "sqli")
