"""JSON Schema, nested redaction and canonical dumps against plain Python."""

from __future__ import annotations

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import contracts as K
from tidemark.functions import nested as N
from tidemark.functions.text import REDACTIONS

SCHEMA = {
    "type": "object",
    "required": ["id", "tags"],
    "properties": {
        "id": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-z]"},
        "n": {"type": ["integer", "null"], "minimum": 1, "exclusiveMaximum": 10, "multipleOf": 2},
        "kind": {"enum": ["a", 1, None, True, {"x": [1]}]},
        "v": {"const": 1},
        "tags": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"$ref": "#/$defs/tag"}},
        "pair": {"prefixItems": [{"type": "number"}, {"type": "boolean"}], "items": {"type": "string"}},
        "any": {"anyOf": [{"type": "string"}, {"type": "integer", "minimum": 5}]},
        "one": {"oneOf": [{"type": "number"}, {"minimum": 3}]},
        "not": {"not": {"type": "null"}},
        "all": {"allOf": [{"type": "object"}, {"minProperties": 1, "maxProperties": 2}]},
        "if": {"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"type": "integer"}},
        "free": {"type": "object", "additionalProperties": {"type": "integer"}},
        "deep": {"properties": {"a": {"properties": {"b": {"items": {"items": {"type": "integer"}}}}}}},
    },
    "additionalProperties": False,
    "$defs": {"tag": {"type": "object", "properties": {"Name": {"type": "string"}}, "required": ["Name"]}},
}


def kind_of(v):
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, float):
        return "integer" if v.is_integer() else "number"
    return {dict: "object", list: "array", str: "string", int: "integer", type(None): "null"}[type(v)]


def same(a, b):
    return kind_of(a).replace("integer", "number") == kind_of(b).replace("integer", "number") and a == b


def walk(schema, v, path, root):
    """(path, keyword) of all errors, in the order of the schema."""
    if schema is True:
        return []
    kind, out = kind_of(v), []
    bad = lambda key, at=path: out.append((list(at), key))
    number = kind in ("integer", "number")
    for key, want in schema.items():
        if key == "$ref":
            out += walk(root["$defs"][want.rsplit("/", 1)[1]], v, path, root)
        elif key == "type":
            kinds = [want] if isinstance(want, str) else want
            if kind not in kinds and not (kind == "integer" and "number" in kinds):
                bad(key)
        elif key == "required" and kind == "object":
            for k in want:
                if k not in v:
                    bad(key)
        elif key == "properties" and kind == "object":
            for k, sub in want.items():
                if k in v:
                    out += walk(sub, v[k], [*path, k], root)
        elif key == "additionalProperties" and kind == "object":
            for k in sorted(set(v) - set(schema.get("properties", {}))):
                if want is False:
                    bad(key)
                else:
                    out += walk(want, v[k], [*path, k], root)
        elif key == "prefixItems" and kind == "array":
            for i, (sub, x) in enumerate(zip(want, v)):
                out += walk(sub, x, [*path, str(i)], root)
        elif key == "items" and kind == "array":
            for i, x in enumerate(v):
                if i >= len(schema.get("prefixItems", [])):
                    out += walk(want, x, [*path, str(i)], root)
        elif key == "allOf":
            for sub in want:
                out += walk(sub, v, path, root)
        elif key in ("anyOf", "oneOf"):
            good = sum(not walk(sub, v, path, root) for sub in want)
            if not (good >= 1 if key == "anyOf" else good == 1):
                bad(key)
        elif key == "not":
            if not walk(want, v, path, root):
                bad(key)
        elif key == "if":
            out += walk(schema.get("else", True) if walk(want, v, path, root) else schema.get("then", True), v, path, root)
        else:
            holds = {
                "enum": lambda: any(same(v, w) for w in want), "const": lambda: same(v, want), "pattern": lambda: kind != "string" or re.search(want, v),
                "minLength": lambda: kind != "string" or len(v) >= want, "maxLength": lambda: kind != "string" or len(v) <= want,
                "minimum": lambda: not number or v >= want, "exclusiveMaximum": lambda: not number or v < want, "multipleOf": lambda: not number or v % want == 0,
                "minItems": lambda: kind != "array" or len(v) >= want, "maxItems": lambda: kind != "array" or len(v) <= want,
                "uniqueItems": lambda: kind != "array" or len({json.dumps(x, sort_keys=True) for x in v}) == len(v),
                "minProperties": lambda: kind != "object" or len(v) >= want, "maxProperties": lambda: kind != "object" or len(v) <= want,
            }.get(key)
            if holds and not holds():
                bad(key)
    return out


def made(rng, depth=0):
    kinds = [lambda: rng.choice(["", "a", "ab", "abcde", "Zz", "é😀"]), lambda: rng.choice([0, 1, 2, 7, 8, 12, -3]), lambda: rng.choice([0.5, 2.0, 4.5]), lambda: rng.choice([True, False]), lambda: None]
    if depth < 3:
        kinds += [lambda: [made(rng, depth + 1) for _ in range(rng.randrange(5))], lambda: {k: made(rng, depth + 1) for k in rng.sample(["Name", "x", "a", "b"], rng.randrange(3))}] * 2
    return rng.choice(kinds)()


def test_schema_errors_equal_a_walk_over_the_values(spark):
    rng, rows = random.Random(1), []
    for k in range(400):
        v = {key: made(rng) for key in rng.sample([*SCHEMA["properties"], "zz", "yy"], rng.randrange(6))} if k % 20 else made(rng)
        if isinstance(v, dict) and rng.random() < 0.7:
            v |= {"id": rng.choice(["ab", "abcd", "x"]), "tags": rng.choice([[{"Name": "t"}], [{"Name": "t"}, {"Name": "t"}], [{"Name": 1}, {}, 3], []])}
        rows.append(v)
    rows += [{"id": "ab", "tags": [{"Name": "t"}], "deep": {"a": {"b": [[1], [1, "x"], 3]}}}, {"id": "ab", "tags": [{"Name": "t"}], "kind": {"x": [1]}}]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(rows)], "k int, j string")
    got = {r["k"]: r for r in K.first_error(K.checked(df, "j", K.Schema(SCHEMA)), "j", K.Schema(json.dumps(SCHEMA))).collect()}
    place = lambda p: [x.rjust(12, "0") if x.isdigit() else x for x in p]
    for k, v in enumerate(rows):
        wanted = walk(SCHEMA, v, [], SCHEMA)
        assert [(list(e["path"]), e["keyword"]) for e in got[k]["errors"]] == wanted, v
        first = min(enumerate(wanted), key=lambda e: (place(e[1][0]), e[0]), default=None)
        assert got[k]["error"] == (None if first is None else f"{'.'.join(first[1][0]) or '<root>'} -> {first[1][1]}")
    assert sum(not r["errors"] for r in got.values()) > 5


def test_schema_odd_input_and_messages(spark):
    df = spark.createDataFrame([("{bad",), (None,), ("",), ('{"a": [{"Name": 3}]}',), ("[]",)], "j string").coalesce(1)
    schema = K.Schema({"type": "object", "properties": {"a": {"items": {"properties": {"Name": {"type": "string"}}, "required": ["Size"]}}}})
    said = [r[0] for r in K.checked(df, "j", schema).select(F.transform("errors", K.described)).collect()]
    assert said[:3] == [["No JSON at root level"]] * 3
    assert said[3] == ["Expected string, got int at 'a -> 0 -> Name'", "Missing required field 'Size' at 'a -> 0'"] and said[4] == ["Expected object, got list at root level"]
    assert K.checked(df, "j", K.Schema(True)).select(F.size("errors")).collect()[3][0] == 0
    for bad in ({"$ref": "#"}, {"patternProperties": {}}, {"type": "text"}, {"$ref": "other.json"}, {"properties": {"a'b": {}}}):
        with pytest.raises(ValueError):
            K.Schema(bad).errors(F.col("j"))


def scrubbed(v):
    if isinstance(v, str):
        for _, pattern, put in REDACTIONS:
            v = re.sub(pattern, put, v)
        return v
    if isinstance(v, dict):
        return {k: scrubbed(x) for k, x in v.items()}
    return [scrubbed(x) for x in v] if isinstance(v, list) else v


def test_redaction_of_json_lines_equals_recursion(spark):
    rng = random.Random(2)
    texts = ["call 555-123-4567", "me@example.org", 'say "hi" to John Smith', "back\\slash\n\t", "é😀 http://x.y/z", "plain", "", "\\\\\"", "4111 1111 1111 1111", "A" * 30]

    def tree(depth):
        if depth == 0 or rng.random() < 0.4:
            return rng.choice([*texts, 1, 2.5, None, True])
        return [tree(depth - 1) for _ in range(3)] if rng.random() < 0.5 else {rng.choice(["k", "me@example.org", 'q"', "John Smith", "a:b"]): tree(depth - 1) for _ in range(3)}

    rows = [tree(5) for _ in range(200)] + [{}, [], {"a": []}, "x me@example.org"]
    lines = [json.dumps(r, ensure_ascii=bool(k % 2), indent=2 if k % 3 == 0 else None) for k, r in enumerate(rows)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string")
    got = {r["k"]: r["out"] for r in df.select("k", N.redact_jsonl(F.col("line")).alias("out")).collect()}
    for k, v in enumerate(rows):
        assert json.loads(got[k]) == scrubbed(v)
    odd = spark.createDataFrame([("no JSON me@example.org",), ("  ",), (None,), ('{"a": "\x01me@example.org"}',)], "line string").coalesce(1)
    assert [r[0] for r in odd.select(N.redact_jsonl(F.col("line"))).collect()] == ["no JSON [EMAIL_REDACTED]", "  ", None, '{"a": "\x01[EMAIL_REDACTED]"}']


def test_redaction_of_nested_columns(spark):
    row = ("me@example.org", {"me@example.org": ["John Smith", None]}, [{"t": "555-123-4567", "n": 1}, None], 3, None)
    df = spark.createDataFrame([row], "a string, m map<string,array<string>>, s array<struct<t:string,n:int>>, n int, z struct<q:string>")
    r = N.redact_nested(df).first().asDict(True)
    assert r == {"a": "[EMAIL_REDACTED]", "m": {"me@example.org": ["[NAME_REDACTED]", None]}, "s": [{"t": "[PHONE_REDACTED]", "n": 1}, None], "n": 3, "z": None}
    assert N.redact_nested(df, ["a"]).first()["m"] == row[1] and N.redact_nested(df).schema == df.schema


def test_canonical_equals_json_dumps(spark):
    floats = [0.1, 1.0, 1e7, 12345678.9, 1e15, 1e16, 1.5e-05, 0.0001, 0.00123, -2.5e20, 3.14, 1e22, -0.0, 123456789012345.6, 1e-300, math.inf]
    texts = ["plain", 'q"b\\', "é😀\n\t\x01\x7f /", "", "日本", " ", "a\r\b\f", "\\u0041"]
    rows = [(x, t, {t: [x], "b": None, "é": [], "a": [1.0, -x]}, k, None if k % 2 else True) for k, (x, t) in enumerate((f, texts[i % len(texts)]) for i, f in enumerate(floats))]
    df = spark.createDataFrame(rows, "x double, T string, m map<string,array<double>>, k long, b boolean")
    got = N.canonical_columns(df, df.columns).select("k", "canonical", N.canonical_text(F.col("canonical")).alias("again")).collect()
    for r in got:
        x, t, m, k, b = rows[r["k"]]
        assert r["canonical"] == r["again"] == json.dumps({"x": x, "T": t, "m": m, "k": k, "b": b}, sort_keys=True, separators=(",", ":"))
    texts = spark.createDataFrame([('{"b":[{"z":1,"a":{"c":"é","b":1.50}}],"a":10}',), ("{bad",), (None,)], "j string").coalesce(1)
    assert [r[0] for r in texts.select(N.canonical_text(F.col("j"))).collect()] == ['{"a":10,"b":[{"a":{"b":1.5,"c":"\\u00e9"},"z":1}]}', None, None]
