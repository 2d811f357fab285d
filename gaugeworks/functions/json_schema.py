"""JSON schemas compiled to expressions over variants: a text's compliance is one column, checked where the rows are."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Keywords that say nothing about compliance.
ANNOTATIONS = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format", "contentEncoding", "contentMediaType", "definitions", "$defs"}
_KEYS, _ITEMS = "map<string,variant>", "array<variant>"


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number's type."""
    return F.regexp_extract(F.schema_of_variant(v), r"\A\w+", 0)


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


def _is(kind: Column, v: Column, name: str) -> Column:
    if name == "integer":  # 1.0 is an integer too
        return kind.isin(*NUMBERS) & F.coalesce(_number(v) == F.floor(_number(v)), F.lit(False))
    return kind.isin(*{"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "number": NUMBERS}[name])


def _equal(kind: Column, v: Column, x) -> Column:
    """Whether the variant is the JSON value x. Objects and arrays are compared member by member."""
    if isinstance(x, bool) or x is None:
        return (kind == "VOID") if x is None else (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == x)
    if isinstance(x, (int, float)):
        return kind.isin(*NUMBERS) & (_number(v) == float(x))
    if isinstance(x, str):
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == x)
    if isinstance(x, list):
        items = F.try_variant_get(v, "$", _ITEMS)
        return (kind == "ARRAY") & (F.size(items) == len(x)) & _all([let(F.get(items, i), _is_value(z)) for i, z in enumerate(x)])
    members = F.try_variant_get(v, "$", _KEYS)
    return (kind == "OBJECT") & (F.size(members) == len(x)) & _all([F.map_contains_key(members, k) & let(F.try_element_at(members, F.lit(k)), _is_value(z)) for k, z in x.items()])


# Functions of one variable, as transform() counts a lambda's parameters.
def _is_value(x):
    return lambda y: _equal(_kind(y), y, x)


def _holds(schema):
    return lambda y: _valid(y, schema)


def _named(pattern, schema):
    return lambda e: ~F.regexp_like(e["key"], F.lit(pattern)) | let(e["value"], _holds(schema))


def _kept(checks, here, schema):
    return lambda x: _all([checks[k](x, schema[k], schema) for k in here])


def _valid(v: Column, schema: dict | bool) -> Column:
    """Whether a variant, a lambda's variable, complies. A keyword of one type says nothing about values of another."""
    if isinstance(schema, bool):
        return F.lit(schema)
    unknown = set(schema) - ANNOTATIONS - KEYWORDS
    if unknown:
        raise ValueError(f"unsupported keywords {sorted(unknown)}")

    def of(kind):
        tests = []
        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            tests.append(reduce(lambda a, b: a | b, [_is(kind, v, n) for n in names]))
        if "enum" in schema:
            tests.append(reduce(lambda a, b: a | b, [_equal(kind, v, x) for x in schema["enum"]]))
        if "const" in schema:
            tests.append(_equal(kind, v, schema["const"]))
        tests += [_valid(v, s) for s in schema.get("allOf", [])]
        if "anyOf" in schema:
            tests.append(reduce(lambda a, b: a | b, [_valid(v, s) for s in schema["anyOf"]]))
        if "oneOf" in schema:
            tests.append(reduce(lambda a, b: a + b, [_valid(v, s).cast("int") for s in schema["oneOf"]]) == 1)
        if "not" in schema:
            tests.append(~_valid(v, schema["not"]))
        if "if" in schema:
            tests.append(F.when(_valid(v, schema["if"]), _valid(v, schema.get("then", True))).otherwise(_valid(v, schema.get("else", True))))
        for names, get, checks in (("number", _number, _NUMBER), ("string", lambda x: F.try_variant_get(x, "$", "string"), _STRING), ("array", lambda x: F.try_variant_get(x, "$", _ITEMS), _ARRAY), ("object", lambda x: F.try_variant_get(x, "$", _KEYS), _OBJECT)):
            here = [k for k in checks if k in schema]
            if here:
                tests.append(~_is(kind, v, names) | let(get(v), _kept(checks, here, schema)))
        return F.coalesce(_all(tests), F.lit(False))

    return let(_kind(v), of)


def _multiple(x: Column, of: float) -> Column:
    q = x / of
    return F.abs(q - F.round(q)) < 1e-9


_NUMBER = {
    "minimum": lambda x, k, s: x >= k,
    "maximum": lambda x, k, s: x <= k,
    "exclusiveMinimum": lambda x, k, s: x > k,
    "exclusiveMaximum": lambda x, k, s: x < k,
    "multipleOf": lambda x, k, s: _multiple(x, k),
}
_STRING = {
    "minLength": lambda x, k, s: F.length(x) >= k,
    "maxLength": lambda x, k, s: F.length(x) <= k,
    "pattern": lambda x, k, s: F.regexp_like(x, F.lit(k)),
}


def _rest(x: Column, k, schema: dict) -> Column:
    """Items after the listed ones."""
    n = len(schema.get("prefixItems", []))
    return F.forall(F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0))) if n else x, _holds(k))


def _others(x: Column, k, schema: dict) -> Column:
    """Members that neither properties nor patternProperties name."""
    named, patterns = list(schema.get("properties", {})), list(schema.get("patternProperties", {}))
    own = lambda key: reduce(lambda a, b: a | b, [key.isin(*named)] * bool(named) + [F.regexp_like(key, F.lit(p)) for p in patterns]) if named or patterns else F.lit(False)
    return F.forall(F.map_entries(x), lambda e: own(e["key"]) | let(e["value"], _holds(k)))


_ARRAY = {
    "minItems": lambda x, k, s: F.size(x) >= k,
    "maxItems": lambda x, k, s: F.size(x) <= k,
    "uniqueItems": lambda x, k, s: F.lit(True) if not k else F.size(F.array_distinct(F.transform(x, lambda y: F.to_json(y)))) == F.size(x),
    "prefixItems": lambda x, k, s: _all([(F.size(x) <= i) | let(F.get(x, F.lit(i)), _holds(z)) for i, z in enumerate(k)]),
    "items": _rest,
    "contains": lambda x, k, s: F.exists(x, _holds(k)),
}
_OBJECT = {
    "required": lambda x, k, s: _all([F.map_contains_key(x, n) for n in k]),
    "minProperties": lambda x, k, s: F.size(x) >= k,
    "maxProperties": lambda x, k, s: F.size(x) <= k,
    "properties": lambda x, k, s: _all([~F.map_contains_key(x, n) | let(F.try_element_at(x, F.lit(n)), _holds(z)) for n, z in k.items()]),
    "patternProperties": lambda x, k, s: _all([F.forall(F.map_entries(x), _named(p, z)) for p, z in k.items()]),
    "additionalProperties": _others,
    "propertyNames": lambda x, k, s: F.forall(F.map_keys(x), lambda n: let(F.try_variant_get(F.try_parse_json(F.to_json(F.array(n))), "$[0]", "variant"), _holds(k))),
}
KEYWORDS = {"type", "enum", "const", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", *_NUMBER, *_STRING, *_ARRAY, *_OBJECT}


def complies(text: Column, schema: dict | bool | str) -> Column:
    """Whether a text is JSON and complies with the schema (a mapping, or its JSON). A null text and one that isn't JSON comply with none.

    Numbers are compared as doubles. References and keywords about references are an error, like any keyword that is not known.
    """
    rule = json.loads(schema) if isinstance(schema, str) else schema
    return let(F.try_parse_json(text), lambda v: F.when(v.isNotNull(), _valid(v, rule)).otherwise(F.lit(False)))
