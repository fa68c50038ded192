"""JSON schemas as Spark columns over variants: every keyword is checked, is a mere annotation, or is refused."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of JSON Schema that say nothing about validity.
ANNOTATIONS = frozenset("title description default examples $schema $id $comment format deprecated readOnly writeOnly contentMediaType contentEncoding".split())
TYPES = frozenset("string integer number boolean object array null".split())


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _is(kind: Column, v: Column, name: str) -> Column:
    if name not in TYPES:
        raise ValueError(f"unknown type in a schema: {name!r}")
    number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    if name == "number":
        return number
    if name == "integer":
        # 1.0 is an integer too.
        n = F.try_variant_get(v, "$", "double")
        return kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT)") | (number & (n == F.floor(n)))
    if name in ("object", "array"):
        return kind.startswith(name.upper())
    return kind == {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[name]


def _equals(kind: Column, v: Column, wanted) -> Column:
    if isinstance(wanted, bool) or wanted is None or isinstance(wanted, (dict, list)):
        return F.to_json(v) == json.dumps(wanted, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(wanted))
    return _is(kind, v, "number") & (F.try_variant_get(v, "$", "double") == F.lit(float(wanted)))


def fits(schema, v: Column) -> Column:
    """Whether the variant v is valid: never NULL. A keyword that is not known raises ValueError."""
    if isinstance(schema, bool):
        return F.lit(schema)
    if not isinstance(schema, dict):
        raise ValueError(f"not a schema: {schema!r}")

    def check(kind: Column) -> Column:
        is_number, is_string, is_object, is_array = (_is(kind, v, t) for t in ("number", "string", "object", "array"))
        number, text = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
        members = F.from_json(F.to_json(v), "map<string, variant>")
        items = F.try_variant_get(v, "$", "array<variant>")
        properties = schema.get("properties", {})
        out: list[Column] = []

        def if_(is_kind: Column, condition: Column) -> None:
            out.append(~is_kind | condition)

        for key, x in schema.items():
            if key == "type":
                out.append(reduce(lambda a, b: a | b, [_is(kind, v, t) for t in ([x] if isinstance(x, str) else x)]))
            elif key in ("enum", "const"):
                out.append(reduce(lambda a, b: a | b, [_equals(kind, v, w) for w in (x if key == "enum" else [x])], F.lit(False)))
            elif key == "required":
                if_(is_object, _let(F.map_keys(members), lambda keys: _all([F.array_contains(keys, r) for r in x])))
            elif key == "properties":
                if_(is_object, _let(members, lambda m: _all([F.when(F.map_contains_key(m, p), fits(s, F.element_at(m, p))).otherwise(True) for p, s in x.items()])))
            elif key == "additionalProperties":
                names = F.array(*[F.lit(p) for p in properties]).cast("array<string>")
                if_(is_object, F.forall(F.map_entries(members), lambda e: F.array_contains(names, e["key"]) | fits(x, e["value"])))
            elif key in ("minProperties", "maxProperties"):
                if_(is_object, F.size(members) >= x if key[:3] == "min" else F.size(members) <= x)
            elif key in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
                if_(is_number, {"minimum": number >= x, "maximum": number <= x, "exclusiveMinimum": number > x, "exclusiveMaximum": number < x}[key])
            elif key == "multipleOf":
                if_(is_number, F.abs(number / x - F.round(number / x)) < 1e-9)
            elif key in ("minLength", "maxLength"):
                if_(is_string, F.length(text) >= x if key[:3] == "min" else F.length(text) <= x)
            elif key == "pattern":
                if_(is_string, text.rlike(x))
            elif key == "items":
                if_(is_array, F.forall(items, lambda i: fits(x, i)))
            elif key in ("minItems", "maxItems"):
                if_(is_array, F.size(items) >= x if key[:3] == "min" else F.size(items) <= x)
            elif key == "uniqueItems":
                texts = F.transform(items, lambda i: F.to_json(i))
                if_(is_array, (F.size(F.array_distinct(texts)) == F.size(texts)) | F.lit(not x))
            elif key in ("allOf", "anyOf", "oneOf"):
                met = [fits(s, v) for s in x]
                count = reduce(lambda a, b: a + b, [m.cast("int") for m in met])
                out.append(count == len(met) if key == "allOf" else count >= 1 if key == "anyOf" else count == 1)
            elif key == "not":
                out.append(~fits(x, v))
            elif key not in ANNOTATIONS:
                raise ValueError(f"a schema keyword that is not supported: {key!r}")
        return _all(out)

    return F.coalesce(_let(F.schema_of_variant(v), check), F.lit(False))
