"""JSON documents held against a schema: the schema is compiled to one column expression that names every broken rule with its path.

Known keywords: type, enum, minLength, pattern, minimum, maximum, minItems, maxItems, items, required, properties,
additionalProperties (false), $ref into the schema itself; annotations say nothing. Any other keyword is refused, and so is a
reference that leads back to itself."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bound

#: A broken rule: where, which keyword, and what it asks for.
ERROR = "struct<path:string,rule:string,wanted:string>"
_ANNOTATIONS = {"$schema", "$id", "$defs", "$comment", "definitions", "title", "description", "default", "examples", "format"}
_RULES = {"type", "enum", "minLength", "pattern", "minimum", "maximum", "minItems", "maxItems", "items", "required", "properties", "additionalProperties", "$ref"}
_TYPES = {"null", "integer", "number", "string", "boolean", "array", "object"}


def parsed(text: Column) -> Column:
    """The document in a JSON text; null where it isn't JSON."""
    return F.try_parse_json(text)


def _kind(value: Column) -> Column:
    """The type of a value in the schema's words. Numbers are called number; whether one is whole is asked of its value."""
    name = F.schema_of_variant(value)
    number = name.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    named = F.when(name == "VOID", "null").when(number, "number").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
    return named.when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object")


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _resolved(schema: dict, root: dict, seen: tuple[str, ...] = ()) -> tuple[dict, tuple[str, ...]]:
    while "$ref" in schema:
        ref = schema["$ref"]
        if not ref.startswith("#/") or ref in seen:
            raise ValueError(f"reference {ref}: only others in the same schema can be followed, and none back to itself")
        seen, node = (*seen, ref), root
        for step in ref[2:].split("/"):
            node = node[step]
        schema = node
    unknown = schema.keys() - _RULES - _ANNOTATIONS
    if unknown:
        raise ValueError(f"unknown keywords: {', '.join(sorted(unknown))}")
    return schema, seen


def _none() -> Column:
    return F.array().cast(f"array<{ERROR}>")


def _error(path: Column, rule: str, wanted: Column | str) -> Column:
    return F.struct(path.alias("path"), F.lit(rule).alias("rule"), (wanted if isinstance(wanted, Column) else F.lit(wanted)).alias("wanted"))


def _when(broken: Column, path: Column, rule: str, wanted) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.array(_error(path, rule, wanted if isinstance(wanted, str) else json.dumps(wanted)))).otherwise(_none())


def _checks(value: Column, path: Column, schema: dict, root: dict, seen: tuple[str, ...]) -> Column:
    """A document's parts are bound as they are taken out, so each is read once, however many rules ask for it and however deep it lies."""
    schema, seen = _resolved(schema, root, seen)
    return bound(value, lambda v: bound(_kind(v), lambda kind: _of_kind(v, kind, path, schema, root, seen)))


def _of_kind(value: Column, kind: Column, path: Column, schema: dict, root: dict, seen: tuple[str, ...]) -> Column:
    number, text = _as(value, "double"), _as(value, "string")
    parts: list[Column] = []
    if "enum" in schema:
        same = F.lit(False)
        for x in schema["enum"]:
            if x is None:
                same = same | (kind == "null")
            elif isinstance(x, bool):
                same = same | ((kind == "boolean") & (_as(value, "boolean") == x))
            elif isinstance(x, str):
                same = same | ((kind == "string") & (text == x))
            else:
                same = same | ((kind == "number") & (number == float(x)))
        parts.append(_when(~F.coalesce(same, F.lit(False)), path, "enum", schema["enum"]))
    is_text, is_number = kind == "string", kind == "number"
    if "minLength" in schema:
        parts.append(_when(is_text & (F.char_length(text) < schema["minLength"]), path, "minLength", schema["minLength"]))
    if "pattern" in schema:
        parts.append(_when(is_text & ~text.rlike(schema["pattern"]), path, "pattern", schema["pattern"]))
    if "minimum" in schema:
        parts.append(_when(is_number & (number < schema["minimum"]), path, "minimum", schema["minimum"]))
    if "maximum" in schema:
        parts.append(_when(is_number & (number > schema["maximum"]), path, "maximum", schema["maximum"]))

    def of_items(items: Column) -> Column:
        found = []
        if "minItems" in schema:
            found.append(_when(F.size(items) < schema["minItems"], path, "minItems", schema["minItems"]))
        if "maxItems" in schema:
            found.append(_when(F.size(items) > schema["maxItems"], path, "maxItems", schema["maxItems"]))
        if "items" in schema:
            each = F.transform(items, lambda x, i: _checks(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), schema["items"], root, seen))
            found.append(F.coalesce(F.flatten(each), _none()))
        return F.concat(*found)

    if schema.keys() & {"minItems", "maxItems", "items"}:
        parts.append(bound(_as(value, "array<variant>"), of_items))
    properties = schema.get("properties", {})

    def of_fields(fields: Column, keys: Column) -> Column:
        found = [_when(~F.array_contains(keys, name), path, "required", name) for name in schema.get("required", ())]
        if schema.get("additionalProperties") is False and properties:
            # names that begin with _ are notes, which any object may hold
            others = F.array_sort(F.filter(keys, lambda k: ~k.isin(list(properties)) & ~k.startswith("_")))
            found.append(F.coalesce(F.transform(others, lambda k: _error(path, "additionalProperties", k)), _none()))
        for name, sub in properties.items():
            there = F.array_contains(keys, name)
            inner = _checks(fields[name], F.concat(path, F.lit(f".{name}")), sub, root, seen)
            found.append(F.when(F.coalesce(there, F.lit(False)), inner).otherwise(_none()))
        return F.concat(*found)

    if properties or schema.get("required"):
        parts.append(bound(_as(value, "map<string,variant>"), lambda fields: bound(F.map_keys(fields), lambda keys: of_fields(fields, keys))))
    rest = F.concat(*parts) if parts else _none()
    if "type" not in schema:
        return rest
    types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
    if set(types) - _TYPES:
        raise ValueError(f"unknown types: {types}")
    fits = kind.isin([t for t in types if t != "integer"])
    if "integer" in types:
        fits = fits | (is_number & (number == F.floor(number)))
    # a value of the wrong type breaks this rule alone
    return F.when(F.coalesce(fits, F.lit(False)), rest).otherwise(F.array(_error(path, "type", json.dumps(schema["type"]))))


def schema_errors(document: Column, schema: dict, path: Column | None = None) -> Column:
    """All broken rules of a document (see parsed), in the schema's order from the outside in; a text that isn't JSON breaks rule json."""
    at = F.lit("$") if path is None else path
    return F.when(document.isNull(), F.array(_error(at, "json", "a document"))).otherwise(_checks(document, at, schema, schema, ()))


def record_errors(files: DataFrame, schema: dict, text: str = "text") -> DataFrame:
    """Rows (path, place, record_id, errors) of files (path, text): each record of a file with an array `records`, else the file as one record (place null)."""
    whole = files.select("path", parsed(F.col(text)).alias("d"))
    records = F.try_variant_get("d", "$.records", "array<variant>")
    rows = whole.select("path", records.isNotNull().alias("many"), "d", F.posexplode_outer(records).alias("place", "r"))
    one = rows.filter("NOT many OR place IS NOT NULL").select("path", "place", F.when(F.col("many"), F.col("r")).otherwise(F.col("d")).alias("r"))
    return one.select("path", "place", F.try_variant_get("r", "$.id", "string").alias("record_id"), schema_errors(F.col("r"), schema).alias("errors"))
