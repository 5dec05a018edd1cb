"""JSON Schema as one expression: a schema's text is compiled to a column that names the first rule that a document breaks.

Documents are variants, so what isn't named by a rule isn't parsed into columns. Each part of a schema becomes one expression,
over the elements of a list or the members of an object by higher-order functions; nothing runs outside the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A rule takes a variant and the path of it, and gives the first error in it or null.
Rule = Callable[[Column, Column], Column]
#: What a variant's own type is called, by the names of schemas.
TYPES = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number"}
NOTES = {"$schema", "$id", "id", "title", "description", "default", "examples", "format", "definitions", "$comment"}


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def kind_of(value: Column) -> Column:
    """The schema's name for a variant's type."""
    named = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.element_at(named, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _members(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _is(value: Column, kind: Column, name: str) -> Column:
    if name == "integer":
        return (kind == "number") & (_number(value) == F.floor(_number(value)))
    return kind == name


def _equals(value: Column, kind: Column, wanted: Any) -> Column:
    """Equal as JSON: numbers by value, members of objects in any order."""
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return (kind == "number") & (_number(value) == float(wanted))
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))


class Compiler:
    """Compiles the parts of one schema; `$ref` may point into its own definitions, but not to a part that holds it."""

    def __init__(self, schema: dict) -> None:
        self.root = schema

    def rule(self, schema: dict | bool, seen: tuple[str, ...] = ()) -> Rule:
        if schema is True or schema == {}:
            return lambda value, path: F.lit(None).cast("string")
        if schema is False:
            return lambda value, path: F.concat(path, F.lit(": false"))
        if "$ref" in schema:
            return self._ref(schema["$ref"], seen)
        unknown = set(schema) - NOTES - {"type", "enum", "const"} - set(_NUMBERS) - set(_TEXTS) - {"items", "minItems", "maxItems", "uniqueItems", "contains"} - {"properties", "required", "additionalProperties", "patternProperties", "minProperties", "maxProperties", "propertyNames"} - {"allOf", "anyOf", "oneOf", "not"}
        if unknown:
            raise ValueError(f"no such keyword: {', '.join(sorted(unknown))}")
        parts = [*self._values(schema), *self._sizes(schema), *self._lists(schema, seen), *self._objects(schema, seen), *self._several(schema, seen)]

        def check(value: Column, path: Column) -> Column:
            return _with(kind_of(value), lambda kind: F.coalesce(*[p(value, kind, path) for p in parts], F.lit(None).cast("string")))

        return check

    def _ref(self, ref: str, seen: tuple[str, ...]) -> Rule:
        if not ref.startswith("#") or ref in seen:
            raise ValueError(f"a reference can't be resolved: {ref}")
        at: Any = self.root
        for step in filter(None, ref[1:].split("/")):
            at = at[step.replace("~1", "/").replace("~0", "~")]
        return self.rule(at, (*seen, ref))

    def _values(self, schema: dict) -> list:
        out = []
        if "type" in schema:
            names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            out.append(_fails("type", lambda v, k: _any([_is(v, k, n) for n in names])))
        if "const" in schema:
            out.append(_fails("const", lambda v, k: _equals(v, k, schema["const"])))
        if "enum" in schema:
            out.append(_fails("enum", lambda v, k: _any([_equals(v, k, x) for x in schema["enum"]])))
        return out

    def _sizes(self, schema: dict) -> list:
        out = []
        for table, kind in ((_NUMBERS, "number"), (_TEXTS, "string")):
            out += [_fails(word, lambda v, k, word=word, table=table, kind=kind: (k != kind) | table[word](v, schema[word])) for word in table if word in schema]
        return out

    def _lists(self, schema: dict, seen: tuple[str, ...]) -> list:
        out = []
        for word, ok in (("minItems", lambda n, b: n >= b), ("maxItems", lambda n, b: n <= b)):
            if word in schema:
                out.append(_fails(word, lambda v, k, word=word, ok=ok: (k != "array") | ok(F.size(_list(v)), F.lit(schema[word]))))
        if schema.get("uniqueItems"):
            out.append(_fails("uniqueItems", lambda v, k: (k != "array") | _with(F.transform(_list(v), lambda x: F.to_json(x)), lambda x: F.size(F.array_distinct(x)) == F.size(x))))
        if "items" in schema:
            if isinstance(schema["items"], list):
                for i, part in enumerate(schema["items"]):
                    out.append(self._at(self.rule(part, seen), "array", lambda v, i=i: F.get(_list(v), F.lit(i)), lambda path, i=i: F.concat(path, F.lit(f"[{i}]"))))
            else:
                out.append(self._each_item(self.rule(schema["items"], seen)))
        if "contains" in schema:
            inner = self.rule(schema["contains"], seen)
            out.append(_fails("contains", lambda v, k: (k != "array") | F.exists(_list(v), lambda x: inner(x, F.lit("$")).isNull())))
        return out

    @staticmethod
    def _at(inner: Rule, kind: str, get: Callable[[Column], Column], path_of: Callable[[Column], Column]):
        """A rule for one part, which may be missing."""
        return lambda v, k, path: F.when(k == kind, _with(get(v), lambda x: F.when(x.isNotNull(), inner(x, path_of(path)))))

    @staticmethod
    def _each_item(inner: Rule):
        def check(value: Column, kind: Column, path: Column) -> Column:
            errors = F.transform(_list(value), lambda x, i: inner(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            return F.when(kind == "array", F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0)))

        return check

    def _objects(self, schema: dict, seen: tuple[str, ...]) -> list:
        out = []
        for name in schema.get("required", []):
            out.append(_fails(f"required {name}", lambda v, k, name=name: (k != "object") | F.map_contains_key(_members(v), name)))
        for word, ok in (("minProperties", lambda n, b: n >= b), ("maxProperties", lambda n, b: n <= b)):
            if word in schema:
                out.append(_fails(word, lambda v, k, word=word, ok=ok: (k != "object") | ok(F.size(_members(v)), F.lit(schema[word]))))
        if "propertyNames" in schema:
            named = self.rule(schema["propertyNames"], seen)
            as_variant = lambda n: F.try_parse_json(F.concat(F.lit('"'), F.regexp_replace(n, r'(["\\\\])', r"\\$1"), F.lit('"')))
            out.append(_fails("propertyNames", lambda v, k: (k != "object") | F.forall(F.map_keys(_members(v)), lambda n: named(as_variant(n), F.lit("$")).isNull())))
        for name, part in schema.get("properties", {}).items():
            out.append(self._at(self.rule(part, seen), "object", lambda v, name=name: F.try_element_at(_members(v), F.lit(name)), lambda path, name=name: F.concat(path, F.lit(f".{name}"))))
        patterns = schema.get("patternProperties", {})
        for pattern, part in patterns.items():
            out.append(self._each_member(self.rule(part, seen), lambda name, pattern=pattern: name.rlike(pattern)))
        if schema.get("additionalProperties", True) is not True:
            known = list(schema.get("properties", {}))

            def other(name: Column) -> Column:
                return ~_any([name == x for x in known] + [name.rlike(p) for p in patterns])

            out.append(self._each_member(self.rule(schema["additionalProperties"], seen), other))
        return out

    @staticmethod
    def _each_member(inner: Rule, chosen: Callable[[Column], Column]):
        def check(value: Column, kind: Column, path: Column) -> Column:
            entries = F.array_sort(F.map_keys(_members(value)))
            errors = lambda names, members: F.transform(F.filter(names, lambda n: chosen(n)), lambda n: inner(F.element_at(members, n), F.concat(path, F.lit("."), n)))
            found = _with(_members(value), lambda m: F.get(F.filter(errors(entries, m), lambda e: e.isNotNull()), F.lit(0)))
            return F.when(kind == "object", found)

        return check

    def _several(self, schema: dict, seen: tuple[str, ...]) -> list:
        out = []
        for part in schema.get("allOf", []):
            out.append(lambda v, k, path, inner=self.rule(part, seen): inner(v, path))
        for word, ok in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
            if word in schema:
                inner = [self.rule(part, seen) for part in schema[word]]
                fits = lambda v, inner=inner: sum((r(v, F.lit("$")).isNull().cast("int") for r in inner), F.lit(0))
                out.append(_fails(word, lambda v, k, fits=fits, ok=ok: ok(fits(v))))
        if "not" in schema:
            out.append(_fails("not", lambda v, k, inner=self.rule(schema["not"], seen): inner(v, F.lit("$")).isNotNull()))
        return out


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _fails(word: str, holds: Callable[[Column, Column], Column]):
    """The path and keyword where a condition over (value, kind) doesn't hold."""
    return lambda v, k, path: F.when(~F.coalesce(holds(v, k), F.lit(False)), F.concat(path, F.lit(f": {word}")))


_NUMBERS: dict[str, Callable[[Column, Any], Column]] = {
    "minimum": lambda v, b: _number(v) >= float(b), "maximum": lambda v, b: _number(v) <= float(b), "exclusiveMinimum": lambda v, b: _number(v) > float(b), "exclusiveMaximum": lambda v, b: _number(v) < float(b),
    "multipleOf": lambda v, b: F.abs(_number(v) / float(b) - F.round(_number(v) / float(b))) < 1e-9,
}
_TEXTS: dict[str, Callable[[Column, Any], Column]] = {
    "minLength": lambda v, b: F.char_length(_text(v)) >= b, "maxLength": lambda v, b: F.char_length(_text(v)) <= b, "pattern": lambda v, b: _text(v).rlike(b),
}


def schema_error(document: Column, schema: dict | str) -> Column:
    """The first rule that a document breaks, as `path: keyword`, or null. Text that isn't JSON breaks `$: json`; null does too."""
    parsed = json.loads(schema) if isinstance(schema, str) else schema
    rule = Compiler(parsed).rule(parsed)
    return _with(F.try_parse_json(document), lambda v: F.when(v.isNull(), "$: json").otherwise(rule(v, F.lit("$"))))


def checked_by(document: Column, key: list[Column], schemas: dict[tuple, dict | str]) -> Column:
    """The error of a document by the schema that its key names, such as namespace, type and version; `no schema` where there is none.

    A document is checked by its own schema only.
    """
    found = None
    for names, schema in schemas.items():
        own = F.lit(True)
        for column, name in zip(key, names, strict=True):
            own = own & column.eqNullSafe(F.lit(name))
        error = schema_error(document, schema)
        found = F.when(own, error) if found is None else found.when(own, error)
    return F.lit("no schema") if found is None else found.otherwise("no schema")


def load_schemas(spark: SparkSession, path: str) -> dict[tuple, str]:
    """(namespace, type, version) to schema text, of files <namespace>/<type>/<type>.<version>.schema.json below a folder."""
    files: DataFrame = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.schema.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("at"), "value")
    out = {}
    for r in files.collect():  # a file for each kind of document
        *_, namespace, kind, name = r["at"].split("/")
        version = name.removeprefix(f"{kind}.").removesuffix(".schema.json")
        if name.startswith(f"{kind}.") and version.isdigit():
            out[namespace, kind, int(version)] = r["value"]
    return out
