"""Compiled schemas against a plain recursive reading of the same rules."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sluice.functions import schemas

ADDRESS = {"type": "object", "properties": {"zip": {"type": "string", "pattern": "^[0-9]{5}$"}, "lines": {"type": "array", "items": {"type": "string", "minLength": 1}, "minItems": 1, "maxItems": 2}}, "required": ["zip"]}
SCHEMA = {
    "$schema": "any", "title": "a note", "definitions": {"address": ADDRESS},
    "type": "object", "required": ["id", "kind"], "additionalProperties": {"type": "null"}, "maxProperties": 7, "propertyNames": {"maxLength": 6},
    "properties": {
        "id": {"type": "integer", "minimum": 1, "exclusiveMaximum": 100, "multipleOf": 2}, "kind": {"enum": ["a", 5, None, {"x": 1, "y": [2]}]}, "home": {"$ref": "#/definitions/address"},
        "tags": {"type": "array", "uniqueItems": True, "items": {"oneOf": [{"type": "string"}, {"type": "number", "minimum": 0}, {"type": "integer"}]}, "contains": {"const": "x"}},
        "pair": {"type": ["array", "null"], "items": [{"type": "boolean"}, {"not": {"type": "string"}}]}, "any": {"anyOf": [{"maximum": 3}, {"type": "string", "maxLength": 2}]},
    },
    "patternProperties": {"^x": {"type": "array", "items": {"allOf": [{"type": "object", "minProperties": 1}, {"required": ["q"]}]}}},
}


def _kind(v):
    return {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}[type(v)]


def _same(a, b):
    return _kind(a) == _kind(b) and json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True) if _kind(a) != "number" else _kind(b) == "number" and a == b


def _plain(s, v, root, path="$"):
    """The first broken rule, in the order in which schemas are documented to be read."""
    if "$ref" in s:
        return _plain(root["definitions"][s["$ref"].rsplit("/", 1)[1]], v, root, path)
    k, bad = _kind(v), lambda word: f"{path}: {word}"
    types = s.get("type", [k] if "type" not in s else None)
    types = types if isinstance(types, list) else [types]
    if "type" in s and not any(k == t or (t == "integer" and k == "number" and v == int(v)) for t in types):
        return bad("type")
    if "const" in s and not _same(v, s["const"]):
        return bad("const")
    if "enum" in s and not any(_same(v, x) for x in s["enum"]):
        return bad("enum")
    if k == "number":
        for word, ok in (("minimum", lambda b: v >= b), ("maximum", lambda b: v <= b), ("exclusiveMinimum", lambda b: v > b), ("exclusiveMaximum", lambda b: v < b), ("multipleOf", lambda b: v / b == int(v / b))):
            if word in s and not ok(s[word]):
                return bad(word)
    if k == "string":
        for word, ok in (("minLength", lambda b: len(v) >= b), ("maxLength", lambda b: len(v) <= b), ("pattern", lambda b: re.search(b, v))):
            if word in s and not ok(s[word]):
                return bad(word)
    if k == "array":
        if len(v) < s.get("minItems", 0):
            return bad("minItems")
        if len(v) > s.get("maxItems", 10**9):
            return bad("maxItems")
        if s.get("uniqueItems") and len({json.dumps(x, sort_keys=True) for x in v}) < len(v):
            return bad("uniqueItems")
        parts = s.get("items", {})
        for i, x in enumerate(v):
            part = parts if isinstance(parts, dict) else parts[i] if i < len(parts) else {}
            if error := _plain(part, x, root, f"{path}[{i}]"):
                return error
        if "contains" in s and all(_plain(s["contains"], x, root) for x in v):
            return bad("contains")
    if k == "object":
        for name in s.get("required", []):
            if name not in v:
                return bad(f"required {name}")
        if len(v) < s.get("minProperties", 0):
            return bad("minProperties")
        if len(v) > s.get("maxProperties", 10**9):
            return bad("maxProperties")
        if "propertyNames" in s and any(_plain(s["propertyNames"], n, root) for n in v):
            return bad("propertyNames")
        for name, part in s.get("properties", {}).items():
            if name in v and (error := _plain(part, v[name], root, f"{path}.{name}")):
                return error
        for pattern, part in s.get("patternProperties", {}).items():
            for name in sorted(v):
                if re.search(pattern, name) and (error := _plain(part, v[name], root, f"{path}.{name}")):
                    return error
        for name in sorted(v):
            if name not in s.get("properties", {}) and not any(re.search(p, name) for p in s.get("patternProperties", {})) and (error := _plain(s.get("additionalProperties", {}), v[name], root, f"{path}.{name}")):
                return error
    for part in s.get("allOf", []):
        if error := _plain(part, v, root, path):
            return error
    if "anyOf" in s and all(_plain(p, v, root) for p in s["anyOf"]):
        return bad("anyOf")
    if "oneOf" in s and sum(not _plain(p, v, root) for p in s["oneOf"]) != 1:
        return bad("oneOf")
    if "not" in s and not _plain(s["not"], v, root):
        return bad("not")
    return None


def _document(rng: random.Random):
    """Mostly right documents with a few faults."""
    wrong = lambda good, *bad: rng.choice(bad) if rng.random() < 0.12 else good
    address = {"zip": wrong("12345", "1234", 7), "lines": wrong(["a", "bb"], [], ["a", ""], ["a", "b", "c"], "a")}
    if rng.random() < 0.1:
        del address["zip"]
    made = {
        "id": wrong(rng.randrange(2, 100, 2), 0, 3, 100, 2.5, "2", 4.0), "kind": wrong(rng.choice(["a", 5, 5.0, None, {"y": [2], "x": 1}]), "b", {"x": 1}), "home": wrong(address, [address], None),
        "tags": wrong(["x", -1, "y"], ["x", "x"], ["y"], ["x", 1], ["x", 0.5], ["x", [1]]), "pair": wrong(rng.choice([None, [True, 1], [False]]), [1], [True, "s"], {}), "any": wrong(rng.choice([1, "ab"]), "abc", 9),
        "x_1": wrong([{"q": 1}], [{}], [{"p": 1}], 5), "more": wrong(None, 1), "long_name": None, "z": None,
    }
    for name in [n for n in made if n not in ("id", "kind") and rng.random() < 0.5] + [n for n in ("id", "kind") if rng.random() < 0.05]:
        del made[name]
    return wrong(made, [], "text", 5) if rng.random() < 0.2 else made


def test_errors_are_those_of_a_plain_reading(spark):
    rng = random.Random(23)
    docs = [_document(rng) for _ in range(700)]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "k int, d string")
    found = {r["k"]: r["e"] for r in df.select("k", schemas.schema_error(F.col("d"), SCHEMA).alias("e")).collect()}
    assert found == {k: _plain(SCHEMA, d, SCHEMA) for k, d in enumerate(docs)}
    assert len({e for e in found.values() if e}) > 25 and sum(e is None for e in found.values()) > 100


def test_what_is_no_document_and_what_is_no_schema(spark):
    df = spark.createDataFrame([(None,), ("",), ("{",), ("null",), ("{}",)], "d string")
    assert [r[0] for r in df.select(schemas.schema_error(F.col("d"), {"type": "object"})).collect()] == ["$: json", "$: json", "$: json", "$: type", None]
    for bad in ({"typ": "object"}, {"$ref": "http://elsewhere"}, {"definitions": {"a": {"items": {"$ref": "#/definitions/a"}}}, "$ref": "#/definitions/a"}):
        with pytest.raises(ValueError, match="keyword|reference"):
            schemas.schema_error(F.lit("{}"), bad)
    assert spark.range(1).select(schemas.schema_error(F.lit("1"), {"properties": {"a": False}})).first()[0] is None
    assert spark.range(1).select(schemas.schema_error(F.lit('{"a": 1}'), {"properties": {"a": False}})).first()[0] == "$.a: false"


def test_schemas_of_a_folder_by_namespace_type_and_version(spark, tmp_path):
    for namespace, kind, version, schema in (("n1", "ping", 1, {"required": ["a"]}), ("n1", "ping", 2, {"required": ["b"]}), ("n2", "ping", 1, {"type": "array"})):
        at = tmp_path / namespace / kind
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{kind}.{version}.schema.json").write_text(json.dumps(schema, indent=1))
    (tmp_path / "n1" / "ping" / "other.txt").write_text("no schema")
    loaded = schemas.load_schemas(spark, str(tmp_path))
    assert set(loaded) == {("n1", "ping", 1), ("n1", "ping", 2), ("n2", "ping", 1)}
    rows = [("n1", "ping", 1, '{"b": 1}'), ("n1", "ping", 2, '{"b": 1}'), ("n2", "ping", 1, "[]"), ("n3", "ping", 1, "[]"), ("n1", "ping", None, "{}")]
    df = spark.createDataFrame(rows, "n string, t string, v int, d string")
    found = df.select(schemas.checked_by(F.col("d"), [F.col("n"), F.col("t"), F.col("v")], loaded).alias("e")).collect()
    assert [r["e"] for r in found] == ["$: required a", None, None, "no schema", "no schema"]
