"""JSON Schema as Columns: a schema document becomes one expression that gives a row's errors, with where they are.

The value is JSON text that is parsed once (VARIANT). Each place of the schema is one node of the expression, bound to a
lambda variable, so a value is looked up and its kind found once; items are a transform over the array. What the compiler does
not know is refused when it is built, so no rule is passed over in silence.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "array<struct<path:array<string>,keyword:string,expected:string,actual:string>>"
# The names of the kinds of a value in messages.
KINDS = {"object": "dict", "array": "list", "string": "str", "integer": "int", "number": "float", "boolean": "bool", "null": "NoneType"}
#: Keywords that demand nothing.
NOTES = {"$schema", "$id", "$defs", "$comment", "$anchor", "definitions", "title", "description", "default", "examples", "format", "readOnly", "writeOnly", "deprecated", "then", "else"}


def _none() -> Column:
    return F.array().cast(ERROR)


def _error(path: list[Column], keyword: str, expected, kind: Column) -> Column:
    where = F.array(*path) if path else F.array().cast("array<string>")
    text = expected if isinstance(expected, str) else json.dumps(expected)
    return F.array(F.struct(where.alias("path"), F.lit(keyword).alias("keyword"), F.lit(text).alias("expected"), kind.alias("actual")))


def _bound(value: Column, use) -> Column:
    """use(x), where x is the value, computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kind(v: Column) -> Column:
    """object, array, string, integer, number, boolean or null. A number without a fraction is an integer."""
    name = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(F.is_variant_null(v), "null").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
        .when((name == "BIGINT") | (number == F.floor(number).cast("double")), "integer").otherwise("number")
    )


def _quoted(key: str) -> str:
    if "'" in key or "\\" in key:
        raise ValueError(f"a key with quotes or backslashes: {key}")
    return f"$['{key}']"


def _equals(v: Column, kind: Column, wanted) -> Column:
    if isinstance(wanted, bool):
        return (kind == "boolean") & (F.try_variant_get(v, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, (int, float)):
        return kind.isin("integer", "number") & (F.try_variant_get(v, "$", "double") == F.lit(float(wanted)))
    if isinstance(wanted, str):
        return (kind == "string") & (F.try_variant_get(v, "$", "string") == F.lit(wanted))
    return kind == "null" if wanted is None else F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))


class Schema:
    """A schema document of draft 7 or 2020-12. `$ref` may name a place in the same document, but no schema may hold itself:
    an expression has a fixed depth, so such a document is refused."""

    def __init__(self, document: dict | bool | str):
        self.document = json.loads(document) if isinstance(document, str) else document

    def errors(self, text: Column) -> Column:
        """ERROR: all errors of JSON text in the order of the schema; keyword json, if it is none or null."""
        parsed = F.try_parse_json(text)
        return F.when(parsed.isNull(), _error([], "json", "JSON", F.lit(None).cast("string"))).otherwise(self._node(self.document, parsed, [], ()))

    def _resolved(self, ref: str):
        if not ref.startswith("#"):
            raise ValueError(f"{ref} is in another document")
        found = self.document
        for part in ref.removeprefix("#").strip("/").split("/"):
            if part:
                part = part.replace("~1", "/").replace("~0", "~")
                found = found[int(part)] if isinstance(found, list) else found[part]
        return found

    def _node(self, schema, value: Column, path: list[Column], inside: tuple[str, ...]) -> Column:
        """The errors of a value that is there."""
        if schema is True or schema == {}:
            return _none()
        if schema is False:
            return _error(path, "false", "nothing", _kind(value))
        return _bound(F.struct(value.alias("v"), _kind(value).alias("kind")), lambda n: self._checks(schema, n["v"], n["kind"], path, inside))

    def _checks(self, schema: dict, v: Column, kind: Column, path: list[Column], inside: tuple[str, ...]) -> Column:
        found = [self._keyword(schema, key, want, v, kind, path, inside) for key, want in schema.items() if key not in NOTES]
        found = [f for f in found if f is not None]
        return F.concat(*found) if len(found) > 1 else found[0] if found else _none()

    def _keyword(self, schema: dict, key: str, want, v: Column, kind: Column, path: list[Column], inside: tuple[str, ...]) -> Column | None:
        unless = lambda ok: F.when(~F.coalesce(ok, F.lit(False)), _error(path, key, want, kind)).otherwise(_none())
        within = lambda sub, x=v, p=path: self._node(sub, x, p, inside)
        holds = lambda sub: F.size(within(sub)) == 0
        string, array, number = kind == "string", kind == "array", kind.isin("integer", "number")
        text, amount = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        items, fields = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")
        if key == "$ref":
            if want in inside:
                raise ValueError(f"{want} holds itself")
            return self._node(self._resolved(want), v, path, (*inside, want))
        if key == "type":
            kinds = [want] if isinstance(want, str) else want
            if unknown := set(kinds) - set(KINDS):
                raise ValueError(f"no such type: {unknown}")
            return unless(kind.isin(*kinds, *(["integer"] if "number" in kinds else [])))
        if key == "required":
            lacks = [F.when((kind == "object") & F.try_variant_get(v, _quoted(k), "variant").isNull(), _error(path, key, k, kind)).otherwise(_none()) for k in want]
            return F.concat(*lacks) if lacks else None
        if key == "properties":
            each = []
            for name, sub in want.items():
                x = F.try_variant_get(v, _quoted(name), "variant")
                each.append(F.when((kind == "object") & x.isNotNull(), within(sub, x, [*path, F.lit(name)])).otherwise(_none()))
            return F.concat(*each) if each else None
        if key == "additionalProperties":
            known = F.array(*map(F.lit, schema.get("properties", {}))) if schema.get("properties") else F.array().cast("array<string>")
            if "patternProperties" in schema:
                raise ValueError("additionalProperties beside patternProperties")
            more = F.array_sort(F.array_except(F.map_keys(fields), known))
            each = F.flatten(F.transform(more, lambda k: within(want, F.element_at(fields, k), [*path, k]) if want is not False else _error(path, key, "none", k)))
            return F.when(kind == "object", each).otherwise(_none())
        if key in ("items", "prefixItems"):
            if isinstance(want, list):
                each = [F.when(array & (F.size(items) > i), within(sub, F.get(items, F.lit(i)), [*path, F.lit(str(i))])).otherwise(_none()) for i, sub in enumerate(want)]
                return F.concat(*each) if each else None
            first = len(schema.get("prefixItems", []))
            each = F.transform(items, lambda x, i: F.when(i >= first, within(want, x, [*path, i.cast("string")])).otherwise(_none()))
            return F.when(array, F.flatten(each)).otherwise(_none())
        if key in ("allOf", "anyOf", "oneOf"):
            if key == "allOf":
                return F.concat(*(within(sub) for sub in want))
            good = reduce(lambda a, b: a + b, (holds(sub).cast("int") for sub in want))
            return unless(good >= 1 if key == "anyOf" else good == 1)
        if key == "not":
            return unless(~holds(want))
        if key == "if":
            return F.when(holds(want), within(schema.get("then", True))).otherwise(within(schema.get("else", True)))
        tests = {
            "enum": lambda: reduce(lambda a, b: a | b, (_equals(v, kind, w) for w in want), F.lit(False)),
            "const": lambda: _equals(v, kind, want),
            "pattern": lambda: ~string | text.rlike(want),
            "minLength": lambda: ~string | (F.length(text) >= want),
            "maxLength": lambda: ~string | (F.length(text) <= want),
            "minimum": lambda: ~number | (amount >= F.lit(float(want))),
            "maximum": lambda: ~number | (amount <= F.lit(float(want))),
            "exclusiveMinimum": lambda: ~number | (amount > F.lit(float(want))),
            "exclusiveMaximum": lambda: ~number | (amount < F.lit(float(want))),
            "multipleOf": lambda: ~number | (F.abs(amount / F.lit(float(want)) - F.round(amount / F.lit(float(want)))) < 1e-9),
            "minItems": lambda: ~array | (F.size(items) >= want),
            "maxItems": lambda: ~array | (F.size(items) <= want),
            "uniqueItems": lambda: ~array | F.lit(not want) | (F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) == F.size(items)),
            "minProperties": lambda: (kind != "object") | (F.size(fields) >= want),
            "maxProperties": lambda: (kind != "object") | (F.size(fields) <= want),
        }
        return unless(tests[key]()) if key in tests else self._refuse(key)

    @staticmethod
    def _refuse(key: str):
        raise ValueError(f"the keyword {key} is not known")


def described(error: Column) -> Column:
    """An error as a sentence with its place, such as: Expected string, got int at 'Themes -> 2 -> Name'."""
    place = F.when(F.size(error["path"]) == 0, "at root level").otherwise(F.concat(F.lit("at '"), F.array_join(error["path"], " -> "), F.lit("'")))
    kind, want = error["keyword"], error["expected"]
    name = reduce(lambda c, k: F.when(error["actual"] == k, KINDS[k]).otherwise(c), KINDS, error["actual"])
    said = (
        F.when(kind == "required", F.concat(F.lit("Missing required field '"), want, F.lit("'"))).when(kind == "type", F.concat(F.lit("Expected "), want, F.lit(", got "), name))
        .when(kind == "minLength", F.concat(F.lit("String too short (minimum "), want, F.lit(" characters)"))).when(kind == "minItems", F.concat(F.lit("Array too short (minimum "), want, F.lit(" items)")))
        .when(kind == "additionalProperties", F.concat(F.lit("Additional properties not allowed: '"), error["actual"], F.lit("'"))).when(kind == "json", F.lit("No JSON"))
        .otherwise(F.concat(F.lit("Validation error: "), kind, F.lit(" "), want))
    )
    return F.concat(said, F.lit(" "), place)


def first_by_path(errors: Column) -> Column:
    """The error of the least path, places in arrays as numbers; of equal paths the first. Null if there is none."""
    key = lambda e: F.transform(e["path"], lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 12, "0")).otherwise(p))
    ranked = F.transform(errors, lambda e, i: F.struct(key(e).alias("key"), i.alias("i"), e.alias("e")))
    return F.array_min(F.transform(ranked, lambda r: F.struct(r["key"].alias("key"), r["i"].alias("i"))))["i"]


def checked(df: DataFrame, text: str, schema: Schema, name: str = "errors") -> DataFrame:
    """df with the errors of its JSON column, each row's as an array; a bad row is a row like others."""
    return df.withColumn(name, schema.errors(F.col(text)))


def first_error(df: DataFrame, text: str, schema: Schema, name: str = "error") -> DataFrame:
    """df with the place (dots between; <root> for the whole) and keyword of the first error by path, else null."""
    found = checked(df, text, schema, "__errors")
    e = F.get(F.col("__errors"), first_by_path(F.col("__errors")))
    place = F.when(F.size(e["path"]) == 0, "<root>").otherwise(F.array_join(e["path"], "."))
    return found.withColumn(name, F.when(F.size("__errors") > 0, F.concat(place, F.lit(" -> "), e["keyword"]))).drop("__errors")
