"""The compiled schema against a plain validator, on documents made to break every rule."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerstone.operators import schemas as S

SCHEMA = {
    "type": "object",
    "title": "a record",
    "required": ["id", "parts"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 2, "pattern": "^[a-z]"},
        "kind": {"type": ["string", "null"], "enum": ["a", "b", None, 3]},
        "size": {"$ref": "#/$defs/amount"},
        "whole": {"type": "integer", "maximum": 9},
        "flag": {"type": "boolean"},
        "parts": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["n"], "properties": {"n": {"$ref": "#/$defs/amount"}, "tags": {"type": "array", "items": {"type": "string", "minLength": 1}}}}},
        "free": {},
    },
    "$defs": {"amount": {"type": ["number", "null"], "minimum": 0, "maximum": 100}},
}


def plain(value, schema, path="$"):
    while "$ref" in schema:
        node = SCHEMA
        for step in schema["$ref"][2:].split("/"):
            node = node[step]
        schema = node
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    has = {"null": value is None, "string": isinstance(value, str), "boolean": isinstance(value, bool), "array": isinstance(value, list), "object": isinstance(value, dict), "number": number, "integer": number and value == int(value)}
    if "type" in schema and not any(has[t] for t in ([schema["type"]] if isinstance(schema["type"], str) else schema["type"])):
        return [(path, "type", json.dumps(schema["type"]))]
    out = []
    if "enum" in schema and not any(type(x) is type(value) and x == value for x in schema["enum"]):
        out.append((path, "enum", json.dumps(schema["enum"])))
    if isinstance(value, str):
        out += [(path, "minLength", str(schema.get("minLength")))] * (len(value) < schema.get("minLength", 0))
        out += [(path, "pattern", schema.get("pattern"))] * (not re.search(schema.get("pattern", ""), value))
    if number:
        out += [(path, "minimum", str(schema.get("minimum")))] * (value < schema.get("minimum", value))
        out += [(path, "maximum", str(schema.get("maximum")))] * (value > schema.get("maximum", value))
    if isinstance(value, list):
        out += [(path, "minItems", str(schema.get("minItems")))] * (len(value) < schema.get("minItems", 0))
        out += [(path, "maxItems", str(schema.get("maxItems")))] * (len(value) > schema.get("maxItems", 99))
        for i, x in enumerate(value):
            out += plain(x, schema.get("items", {}), f"{path}[{i}]")
    if isinstance(value, dict):
        out += [(path, "required", k) for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [(path, "additionalProperties", k) for k in sorted(value) if k not in schema["properties"] and k[:1] != "_"]
        for k, sub in schema.get("properties", {}).items():
            if k in value:
                out += plain(value[k], sub, f"{path}.{k}")
    return out


def made(rng, depth=0, right=0.6):
    leaf = [None, True, 1, 1.0, 2.5, -3, 250, 12, "", "a", "ab", "b", "Xy", "a" * 30]
    if depth == 0 and rng.random() < 0.9:
        keys = [*SCHEMA["properties"], "_note", "other", "zz"]
        good = {"id": "ab", "kind": "a", "size": 5, "whole": 3, "flag": True, "parts": [{"n": 1}], "free": {"x": []}, "_note": 1, "other": 2, "zz": 3}
        keys = keys if right < 0.9 else keys[:8]
        return {k: good[k] if rng.random() < right else made(rng, 1) for k in keys if rng.random() < 0.8}
    kind = rng.random()
    if kind < 0.3 and depth < 3:
        return [made(rng, depth + 1) for _ in range(rng.randrange(5))]
    if kind < 0.6 and depth < 3:
        return {k: made(rng, depth + 1) for k in ("n", "tags", "q") if rng.random() < 0.7}
    return rng.choice(leaf)


def test_equals_a_plain_validator(spark):
    rng = random.Random(6)
    documents = [made(rng) for _ in range(400)] + [made(rng, 0, 0.98) for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "i int, text string")
    got = {r.i: [tuple(e) for e in r.errors] for r in df.select("i", S.schema_errors(S.parsed(F.col("text")), SCHEMA).alias("errors")).collect()}
    want = {i: plain(d, SCHEMA) for i, d in enumerate(documents)}
    assert got == want
    seen = {rule for errors in want.values() for _, rule, _ in errors}
    assert seen == {"type", "enum", "minLength", "pattern", "minimum", "maximum", "minItems", "maxItems", "required", "additionalProperties"}
    assert sum(not e for e in want.values()) > 5


def test_files_of_records(spark):
    files = [("many", '{"records": [{"id": "ab", "parts": [{"n": 1}]}, {"id": 7, "parts": []}, 3]}'), ("one", '{"id": "zz", "parts": [{"n": -1}]}'), ("none", '{"records": []}'), ("bad", "{"), ("null", None)]
    got = S.record_errors(spark.createDataFrame(files, "path string, text string"), SCHEMA).collect()
    by = {(r.path, r.place): (r.record_id, [(e.path, e.rule) for e in r.errors]) for r in got}
    assert by == {
        ("many", 0): ("ab", []),
        ("many", 1): ("7", [("$.id", "type"), ("$.parts", "minItems")]),
        ("many", 2): (None, [("$", "type")]),
        ("one", None): ("zz", [("$.parts[0].n", "minimum")]),
        ("bad", None): (None, [("$", "json")]),
        ("null", None): (None, [("$", "json")]),
    }


@pytest.mark.parametrize("schema", [{"oneOf": []}, {"$ref": "other.json"}, {"$ref": "#/a", "a": {"$ref": "#/a"}}, {"type": "text"}])
def test_what_is_not_known_is_refused(spark, schema):
    with pytest.raises(ValueError):
        S.schema_errors(S.parsed(F.lit("1")), schema)
