"""A JSON schema as a column expression: what is wrong with each answer, found where the answer is.

Covered are the keywords that answers are held to: type (also lists of types),
enum, const, required, properties, additionalProperties false, items, minItems,
maxItems, minLength, maxLength, pattern, format date, minimum, maximum and
exclusiveMinimum. Any other keyword that constrains is refused when compiled.

A value is bound to a variable before its rules ask about it. Written out, it
would stand in each of them with all that it is taken from, and the expression
would grow with the power of the depth.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SILENT = {"$schema", "title", "description", "$id", "examples", "default"}
_KNOWN = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "pattern", "format", "minimum", "maximum", "exclusiveMinimum"}


#: JSON's names for the types of variants; whether a fraction is whole depends on its value.
_KINDS = {"VOID": "null", "STRING": "string", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array", "BIGINT": "integer", "INT": "integer", "SMALLINT": "integer", "TINYINT": "integer"}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it: the last step of a fold over nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def kind(v: Column) -> Column:
    """JSON's name of a value's type; null for what is absent."""
    name = F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    number = F.try_variant_get(v, "$", "double")
    whole = F.when(number == F.floor(number), "integer").otherwise("number")
    return bound(name, lambda n: F.when(n.isin("DOUBLE", "FLOAT", "DECIMAL"), whole).otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), n)))


def errors(v: Column, schema: dict, path: str = "$") -> Column:
    """The messages of all rules that a variant breaks, in the schema's order; none for an absent value."""
    if unknown := set(schema) - _KNOWN - _SILENT:
        raise ValueError(f"{path}: no rule for {sorted(unknown)}")
    if schema.get("format", "date") != "date" or schema.get("additionalProperties", False) is not False:
        raise ValueError(f"{path}: only dates are a known format, and extra members are refused or not spoken of")
    return bound(v, lambda x: F.when(x.isNull(), _none()).otherwise(_told(x, schema, path)))


def _none() -> Column:
    return F.array().cast("array<string>")


def _told(v: Column, schema: dict, path: str) -> Column:
    """The messages about a value that is there. A type is told by what the rules need anyway, as that of an object or array names those of all its members."""
    if "properties" in schema or "required" in schema:
        names = F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))
        return bound(names, lambda given: bound(F.when(given.isNotNull(), "object").otherwise(kind(v)), lambda is_a: _broken(v, is_a, schema, path, given=given)))
    if "items" in schema or "minItems" in schema or "maxItems" in schema:
        members = F.try_variant_get(v, "$", "array<variant>")
        return bound(members, lambda held: bound(F.when(held.isNotNull(), "array").otherwise(kind(v)), lambda is_a: _broken(v, is_a, schema, path, held=held)))
    return bound(kind(v), lambda is_a: _broken(v, is_a, schema, path))


def _broken(v: Column, is_a: Column, schema: dict, path: str, given: Column | None = None, held: Column | None = None) -> Column:
    """The same for a value of the type ``is_a``, with the names of an object's members or the members of an array."""
    found = []
    rule = lambda broken, text: found.append(F.when(F.coalesce(broken, F.lit(False)), F.lit(f"{path}: {text}")))
    if "type" in schema:
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        rule(~is_a.isin(*types, *(["integer"] if "number" in types else [])), f"not of type {' or '.join(types)}")
    members = schema.get("enum", [schema["const"]] if "const" in schema else None)
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    is_text, is_number = is_a == "string", is_a.isin("integer", "number")
    if members is not None:
        other = ~F.to_json(v).isin(*[json.dumps(m, ensure_ascii=False, separators=(",", ":")) for m in members if not isinstance(m, str)])
        rule(F.when(is_text, ~text.isin(*[m for m in members if isinstance(m, str)])).otherwise(other), "not one of the allowed values")
    if "minLength" in schema:
        rule(is_text & (F.length(text) < schema["minLength"]), f"shorter than {schema['minLength']}")
    if "maxLength" in schema:
        rule(is_text & (F.length(text) > schema["maxLength"]), f"longer than {schema['maxLength']}")
    if "pattern" in schema:
        rule(is_text & ~F.regexp_like(text, F.lit(schema["pattern"])), "not of the pattern")
    if schema.get("format") == "date":
        rule(is_text & ~(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")) & F.try_to_date(text, "yyyy-MM-dd").isNotNull()), "not a date")
    if "minimum" in schema:
        rule(is_number & (number < schema["minimum"]), f"below {schema['minimum']}")
    if "maximum" in schema:
        rule(is_number & (number > schema["maximum"]), f"above {schema['maximum']}")
    if "exclusiveMinimum" in schema:
        rule(is_number & (number <= schema["exclusiveMinimum"]), f"not above {schema['exclusiveMinimum']}")
    nested: list[Column] = []
    if given is not None:
        for name in schema.get("required", []):
            rule(~F.array_contains(given, name), f"{name} is missing")
        if schema.get("additionalProperties") is False:
            extra = F.array_except(given, F.array(*map(F.lit, schema.get("properties", {}))))
            nested.append(F.coalesce(F.transform(extra, lambda e: F.concat(F.lit(f"{path}: unknown member "), e)), _none()))
        for name, own in schema.get("properties", {}).items():
            nested.append(errors(F.when(is_a == "object", F.try_variant_get(v, f"$.{name}", "variant")), own, f"{path}.{name}"))
    if "items" in schema or "minItems" in schema or "maxItems" in schema:
        held = F.when(is_a == "array", F.try_variant_get(v, "$", "array<variant>")) if held is None else held
        if "minItems" in schema:
            rule(F.size(held) < schema["minItems"], f"fewer than {schema['minItems']} items")
        if "maxItems" in schema:
            rule(F.size(held) > schema["maxItems"], f"more than {schema['maxItems']} items")
        if "items" in schema:
            nested.append(F.coalesce(F.flatten(F.transform(held, lambda x: errors(x, schema["items"], f"{path}[]"))), _none()))
    own = F.array_compact(F.array(*found)) if found else _none()
    return F.concat(own, *nested)
