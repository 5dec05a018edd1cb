"""Grammars of what common system programs log, tried in order; each is a printf template with named fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.grammar import Grammar, first_match, literal, printf

#: What all of a mail transport's delivery agents write.
_DELIVERY = [
    ("delivery", "%s: to=<%s>, orig_to=<%s>, relay=%s, delay=%f, delays=%s, dsn=%s, status=%s (%s)", ["queue", "to", "orig_to", "relay", "delay", "delays", "dsn", "status", "reason"]),
    ("delivery", "%s: to=<%s>, relay=%s, delay=%f, delays=%s, dsn=%s, status=%s (%s)", ["queue", "to", "relay", "delay", "delays", "dsn", "status", "reason"]),
]
#: program -> (rule, template, names); fixed values, the messages' own words.
TEMPLATES: dict[str, list[tuple[str, str, list[str]]]] = {
    "sshd": [
        ("accepted", "Accepted %s for %s from %s port %d ssh2", ["method", "user", "ip", "port"]),
        ("accepted", "Accepted %s for %s from %s port %d ssh2: %s %s", ["method", "user", "ip", "port", "key_type", "fingerprint"]),
        ("failed_invalid", "Failed %s for invalid user %s from %s port %d ssh2", ["method", "user", "ip", "port"]),
        ("failed", "Failed %s for %s from %s port %d ssh2", ["method", "user", "ip", "port"]),
        ("failed", "Failed %s for %s from %s port %d ssh2: %s %s", ["method", "user", "ip", "port", "key_type", "fingerprint"]),
        ("invalid_user", "Invalid user %s from %s port %d", ["user", "ip", "port"]),
        ("invalid_user", "Invalid user %s from %s", ["user", "ip"]),
        ("disconnect", "Received disconnect from %s port %d:%d: %s", ["ip", "port", "code", "reason"]),
        ("disconnect", "Received disconnect from %s: %d: %s", ["ip", "code", "reason"]),
        ("disconnected", "Disconnected from %s port %d", ["ip", "port"]),
        ("disconnected", "Disconnected from user %s %s port %d", ["user", "ip", "port"]),
        ("closed", "Connection closed by authenticating user %s %s port %d [preauth]", ["user", "ip", "port"]),
        ("closed", "Connection closed by invalid user %s %s port %d [preauth]", ["user", "ip", "port"]),
        ("closed", "Connection closed by %s port %d [preauth]", ["ip", "port"]),
        ("closed", "Connection closed by %s port %d", ["ip", "port"]),
        ("closed", "Connection closed by %s [preauth]", ["ip"]),
        ("closed", "Connection closed by %s", ["ip"]),
        ("no_identification", "Did not receive identification string from %s port %d", ["ip", "port"]),
        ("connection", "Connection from %s port %d on %s port %d", ["ip", "port", "dst", "local_port"]),
        ("listening", "Server listening on %s port %d.", ["ip", "port"]),
        ("opened", "pam_unix(%s): session opened for user %s by (uid=%d)", ["service", "user", "uid"]),
        ("closed_session", "pam_unix(%s): session closed for user %s", ["service", "user"]),
    ],
    "sudo": [("command", "%s : TTY=%s ; PWD=%s ; USER=%s ; COMMAND=%s", ["user", "tty", "pwd", "as_user", "command"])],
    "su": [("opened", "(to %s) %s on %s", ["as_user", "user", "tty"])],
    "CRON": [("command", "(%s) CMD (%s)", ["user", "command"])],
    "pam": [
        ("opened", "pam_unix(%s): session opened for user %s by (uid=%d)", ["service", "user", "uid"]),
        ("closed", "pam_unix(%s): session closed for user %s", ["service", "user"]),
    ],
    "useradd": [("new_user", "new user: name=%s, UID=%d, GID=%d, home=%s, shell=%s", ["user", "uid", "gid", "home", "shell"])],
    "groupadd": [("new_group", "new group: name=%s, GID=%d", ["group", "gid"])],
    "groupdel": [("removed", "group '%s' removed", ["group"])],
    "login": [("failed", "FAILED LOGIN (%d) on '%s' FOR '%s', %s", ["tries", "tty", "user", "reason"])],
    "systemd-logind": [("new_session", "New session %s of user %s.", ["session", "user"]), ("removed", "Removed session %s.", ["session"])],
    "dhclient": [("bound", "bound to %s -- renewal in %d seconds.", ["ip", "seconds"]), ("request", "DHCPREQUEST on %s to %s port %d", ["interface", "ip", "port"])],
    "dhcpd": [
        ("ack", "DHCPACK on %s to %s (%s) via %s", ["ip", "mac", "host", "interface"]), ("ack", "DHCPACK on %s to %s via %s", ["ip", "mac", "interface"]),
        ("discover", "DHCPDISCOVER from %s (%s) via %s", ["mac", "host", "interface"]), ("discover", "DHCPDISCOVER from %s via %s", ["mac", "interface"]),
        ("offer", "DHCPOFFER on %s to %s (%s) via %s", ["ip", "mac", "host", "interface"]), ("offer", "DHCPOFFER on %s to %s via %s", ["ip", "mac", "interface"]),
        ("request", "DHCPREQUEST for %s (%s) from %s via %s", ["ip", "server", "mac", "interface"]), ("request", "DHCPREQUEST for %s from %s via %s", ["ip", "mac", "interface"]),
        ("nak", "DHCPNAK on %s to %s via %s", ["ip", "mac", "interface"]), ("inform", "DHCPINFORM from %s via %s", ["ip", "interface"]), ("release", "DHCPRELEASE of %s from %s via %s (%s)", ["ip", "mac", "interface", "found"]),
    ],
    "named": [
        ("query", "client %s#%d (%s): query: %s IN %s %s (%s)", ["ip", "port", "name", "query", "type", "flags", "server"]), ("query", "client %s#%d (%s): query: %s IN %s", ["ip", "port", "name", "query", "type"]),
        ("denied", "client %s#%d (%s): query (cache) '%s/%s/IN' denied", ["ip", "port", "name", "query", "type"]), ("lame", "lame server resolving '%s' (in '%s'?): %s#%d", ["query", "zone", "ip", "port"]),
    ],
    "puppet-agent": [("finished", "Finished catalog run in %f seconds", ["seconds"])],
    "smtpd": [
        ("connect", "connect from %s[%s]", ["client", "ip"]), ("disconnect", "disconnect from %s[%s] %s", ["client", "ip", "commands"]), ("disconnect", "disconnect from %s[%s]", ["client", "ip"]),
        ("reject", "NOQUEUE: reject: %s from %s[%s]: %s; from=<%s> to=<%s> proto=%s helo=<%s>", ["stage", "client", "ip", "reason", "from", "to", "proto", "helo"]),
        ("lost", "lost connection after %s from %s[%s]", ["stage", "client", "ip"]), ("timeout", "timeout after %s from %s[%s]", ["stage", "client", "ip"]), ("too_many", "too many errors after %s from %s[%s]", ["stage", "client", "ip"]),
        ("client", "%s: client=%s[%s], sasl_method=%s, sasl_username=%s", ["queue", "client", "ip", "sasl_method", "sasl_username"]), ("client", "%s: client=%s[%s]", ["queue", "client", "ip"]),
        ("unresolved", "warning: hostname %s does not resolve to address %s", ["client", "ip"]), ("login_failed", "warning: %s[%s]: SASL %s authentication failed: %s", ["client", "ip", "sasl_method", "reason"]),
    ],
    "cleanup": [("message_id", "%s: message-id=<%s>", ["queue", "message_id"]), ("resent_id", "%s: resent-message-id=<%s>", ["queue", "message_id"])],
    "qmgr": [("active", "%s: from=<%s>, size=%d, nrcpt=%d (queue active)", ["queue", "from", "size", "recipients"]), ("expired", "%s: from=<%s>, status=expired, returned to sender", ["queue", "from"]), ("removed", "%s: removed", ["queue"])],
    "pickup": [("picked", "%s: uid=%d from=<%s>", ["queue", "uid", "from"])],
    "bounce": [("non_delivery", "%s: sender non-delivery notification: %s", ["queue", "notice"]), ("delay_notice", "%s: sender delay notification: %s", ["queue", "notice"]), ("delivery_status", "%s: sender delivery status notification: %s", ["queue", "notice"])],
    "anvil": [("rate", "statistics: max connection rate %d/%s for (%s) at %s", ["rate", "per", "client", "at"]), ("count", "statistics: max connection count %d for (%s) at %s", ["count", "client", "at"]), ("cache", "statistics: max cache size %d at %s", ["size", "at"])],
    "scache": [("lookups", "statistics: %s lookup hits=%d miss=%d success=%d%%", ["kind", "hits", "misses", "percent"]), ("sizes", "statistics: max simultaneous domains=%d addresses=%d connection=%d", ["domains", "addresses", "connections"])],
    "master": [("started", "daemon started -- version %s, configuration %s", ["version", "folder"]), ("reload", "reload -- version %s, configuration %s", ["version", "folder"]), ("terminating", "terminating on signal %d", ["signal"])],
    "postscreen": [
        ("connect", "CONNECT from [%s]:%d to [%s]:%d", ["ip", "port", "dst", "local_port"]), ("pass", "PASS %s [%s]:%d", ["age", "ip", "port"]), ("disconnect", "DISCONNECT [%s]:%d", ["ip", "port"]), ("hangup", "HANGUP after %f from [%s]:%d in %s", ["seconds", "ip", "port", "stage"]),
        ("pregreet", "PREGREET %d after %f from [%s]:%d: %s", ["bytes", "seconds", "ip", "port", "text"]), ("listed", "DNSBL rank %d for [%s]:%d", ["rank", "ip", "port"]), ("allowed", "WHITELISTED [%s]:%d", ["ip", "port"]), ("denied", "BLACKLISTED [%s]:%d", ["ip", "port"]),
    ],
    "dnsblog": [("listed", "addr %s listed by domain %s as %s", ["ip", "domain", "code"])],
    "tlsproxy": [("connect", "CONNECT from [%s]:%d", ["ip", "port"]), ("disconnect", "DISCONNECT [%s]:%d", ["ip", "port"])],
    "postsuper": [("deleted", "Deleted: %d messages", ["messages"]), ("requeued", "Requeued: %d messages", ["messages"]), ("removed", "%s: removed", ["queue"])],
    "smtp": _DELIVERY,
    "lmtp": _DELIVERY,
    "local": _DELIVERY,
    "virtual": _DELIVERY,
    "pipe": _DELIVERY,
    "error": _DELIVERY,
    "relay": _DELIVERY,
    "retry": _DELIVERY,
    "discard": _DELIVERY,
    "sendmail": [("sent", "%s: to=%s, delay=%s, stat=%s", ["queue", "to", "delay", "stat"])],
}


def grammars(program: str) -> list[tuple[str, Grammar]]:
    return [(rule, printf(template, names)) for rule, template, names in TEMPLATES.get(program, [])]


def program_fields(program: Column, message: Column, known: tuple[str, ...] | None = None) -> Column:
    """A struct (rule, fields) of the first template of the program that the message fits, else null.

    A program is known by its name without a path and without a numbered instance; `known` names the programs to look for, all
    of them if not given.
    """
    name = F.regexp_replace(F.regexp_replace(program, r"^.*/", ""), r"\[\d+\]$", "")
    out = F.lit(None).cast("struct<rule:string,fields:map<string,string>>")
    for own in known or TEMPLATES:
        rules = grammars(own)
        names = sorted({n for _, g in rules for n, _, _ in g if n})
        out = F.when(name == own, first_match(message, rules, names)).otherwise(out)
    return out


def key_values(message: Column) -> Column:
    """The `key=<value>` and `key=value` pairs of a mail transport's message as a map."""
    pairs = F.regexp_extract_all(message, F.lit(r"([\w-]+)=(<[^>]*>|[^,\s]*)"), 0)

    def part(k: int) -> Column:
        return F.transform(pairs, lambda p: F.regexp_extract(p, r"^([\w-]+)=<?([^>]*)>?$", k))

    names, values = part(1), part(2)
    first = F.array_distinct(names)
    return F.transform_values(F.map_from_arrays(first, first), lambda k, v: F.get(values, F.array_position(names, k).cast("int") - 1))


def netfilter(message: Column) -> Column:
    """A kernel packet line: key=value pairs, and the bare flags as an array."""
    flags = F.filter(F.split(message, " "), lambda w: w.rlike("^[A-Z]+$"))
    return F.struct(key_values(message).alias("fields"), flags.alias("flags"))


def slow_query() -> Grammar:
    """A database's slow query record of several lines."""
    blank = (None, "string", r"\s+")
    return [
        literal("# User@Host: "), ("user", "string", r"[^\[\s]+"), (None, "string", r"\[[^\]]*\] @ "), ("host", "string", r"\S*"), literal(" ["), ("ip", "string", r"[^\]]*"), (None, "string", r"\][^\n]*\n"),
        literal("# Query_time: "), ("query_time", "double", r"[\d.]+"), blank, literal("Lock_time: "), ("lock_time", "double", r"[\d.]+"), blank, literal("Rows_sent: "), ("rows_sent", "long", r"\d+"), blank,
        literal("Rows_examined: "), ("rows_examined", "long", r"\d+"), (None, "string", r"\n(?:use [^\n]*\n)?SET timestamp="), ("timestamp", "long", r"\d+"), literal(";\n"), ("statement", "string", r".*"),
    ]


#: Severities and facilities of system logs by number: fixed values.
SEVERITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")
FACILITIES = ("kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "audit", "alert", "clock", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7")


def severity_name(number: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), number.cast("int"))


def facility_name(number: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in FACILITIES]), number.cast("int"))


_HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escape_html(text: Column) -> Column:
    out = text
    for plain, safe in _HTML:
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def escape_json(text: Column) -> Column:
    """The text as the inside of a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":"(.*)"\}$', 1)


def unescape_json(text: Column) -> Column:
    return F.get_json_object(F.concat(F.lit('{"t":"'), text, F.lit('"}')), "$.t")


def interpolate(template: str, fields: dict[str, Column], ts: Column) -> Column:
    """`%{name}` becomes the field, `%{+pattern}` the time in that pattern; unknown names stay as they are."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"%\{(\+?)([^}]+)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        if m[1]:
            parts.append(F.date_format(ts, m[2]))
        else:
            parts.append(F.coalesce(fields[m[2]].cast("string"), F.lit("")) if m[2] in fields else F.lit(m[0]))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))
