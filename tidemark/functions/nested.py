"""Functions over nested values: redaction of all strings, and a canonical dump as JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import redact

#: Stand for an escaped backslash and quote inside JSON text, which cannot hold control characters itself.
SLASH, QUOTE = "\x01", "\x02"


def _rewritten(value: Column, kind: T.DataType, use) -> Column:
    """A value with `use` on each string in it, at any depth; keys of maps and names of fields stay."""
    if isinstance(kind, T.StringType):
        return use(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _rewritten(x, kind.elementType, use)) if _has_text(kind) else value
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _rewritten(x, kind.valueType, use)) if _has_text(kind.valueType) else value
    if isinstance(kind, T.StructType) and _has_text(kind):
        return F.when(value.isNotNull(), F.struct(*(_rewritten(value[f.name], f.dataType, use).alias(f.name) for f in kind.fields)))
    return value


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_text(kind.valueType)
    return any(_has_text(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else isinstance(kind, T.StringType)


def redact_nested(df: DataFrame, columns: list[str] | None = None, only: str | None = None) -> DataFrame:
    """df with all strings of some columns (all, if none are named) redacted, inside structs, arrays and maps too. Nulls stay null."""
    named = df.columns if columns is None else columns
    return df.withColumns({c: _rewritten(F.col(f"`{c}`"), df.schema[c].dataType, lambda x: redact(x, only)) for c in named if _has_text(df.schema[c].dataType)})


def redact_jsonl(line: Column, only: str | None = None) -> Column:
    """A line of JSON with the strings in it redacted at any depth, keys and all else as they are written. A line that is
    no JSON is redacted as text, a blank one stays.

    Between quotes that are not escaped are strings and what is around them in turn; a string before a colon is a key.
    """
    hidden = F.replace(F.replace(line, F.lit("\\\\"), F.lit(SLASH)), F.lit('\\"'), F.lit(QUOTE))
    shown = lambda x: F.replace(F.replace(x, F.lit(QUOTE), F.lit('\\"')), F.lit(SLASH), F.lit("\\\\"))
    said = lambda x: F.get(F.from_json(F.concat(F.lit('["'), shown(x), F.lit('"]')), "array<string>"), F.lit(0))
    again = lambda x: F.regexp_replace(F.to_json(F.array(redact(said(x), only))), '^\\["|"\\]$', "")

    def rewritten(parts: Column) -> Column:
        key = lambda i: F.coalesce(F.get(parts, i + 1), F.lit("")).rlike("^\\s*:")
        return F.array_join(F.transform(parts, lambda p, i: F.when((i % 2 == 1) & ~key(i), again(p)).otherwise(shown(p))), '"')

    whole = F.get(F.transform(F.array(F.split(hidden, '"', -1)), rewritten), F.lit(0))
    return F.when(F.trim(line) == "", line).when(F.try_parse_json(line).isNull() | line.rlike(f"[{SLASH}{QUOTE}]"), redact(line, only)).otherwise(whole)


def json_string(text: Column) -> Column:
    """A string as JSON of ASCII only; characters beyond it are escaped by UTF-16 units, as pairs where they need two."""
    units = lambda run: F.lower(F.regexp_replace(F.hex(F.encode(run, "UTF-16BE")), "(.{4})", "\\\\u$1"))

    def short(x: Column) -> Column:
        for code, letter in (("0008", "b"), ("0009", "t"), ("000a", "n"), ("000c", "f"), ("000d", "r")):
            x = F.replace(x, F.lit(f"\\u{code}"), F.lit(f"\\{letter}"))
        return x

    plain = lambda run: F.replace(F.replace(run, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    runs = F.regexp_extract_all(text, F.lit("[ -~]+|[^ -~]+"), F.lit(0))
    mixed = F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[ -~]"), plain(r)).otherwise(short(units(r)))), "")
    return F.concat(F.lit('"'), F.when(text.rlike("[^ -~]"), mixed).otherwise(plain(text)), F.lit('"'))


def _float(x: Column) -> Column:
    """As Python writes it: plain from 1e-4 up to 1e16, else with an exponent of two digits at least. Digits are the JVM's, which before
    version 19 has one too many for some values, such as the least of all."""
    raw = x.cast("string")
    plain = F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    power = F.regexp_extract(raw, "E(-?[0-9]+)$", 1).try_cast("int")
    exponent = F.concat(F.regexp_replace(F.substring_index(raw, "E", 1), "\\.0$", ""), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    odd = F.when(F.isnan(x), "NaN").when(raw == "Infinity", "Infinity").when(raw == "-Infinity", "-Infinity")
    return F.coalesce(odd, F.when(~F.contains(raw, F.lit("E")), raw).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), plain).otherwise(exponent))


def canonical(value: Column, kind: T.DataType) -> Column:
    """A value of a known type as JSON: keys sorted by code points at each level, no spaces, ASCII only; never null."""
    if isinstance(kind, T.StructType):
        fields = [F.concat(json_string(F.lit(f.name)), F.lit(":"), canonical(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.array_join(F.array(*fields), ","), F.lit("}")) if fields else F.lit("{}")
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise ValueError("keys are strings")
        pairs = F.array_sort(F.map_keys(value))
        out = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda k: F.concat(json_string(k), F.lit(":"), canonical(F.element_at(value, k), kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = _float(value)
    elif isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        out = json_string(value.cast("string"))
    elif isinstance(kind, (T.BooleanType, T.IntegralType, T.DecimalType)):
        out = value.cast("string")
    else:
        raise ValueError(f"{kind.simpleString()} has no JSON")
    return F.when(value.isNull(), "null").otherwise(out)


def canonical_columns(df: DataFrame, columns: list[str], name: str = "canonical") -> DataFrame:
    """df with some columns as one canonical object."""
    picked = T.StructType([df.schema[c] for c in columns])
    return df.withColumn(name, canonical(F.struct(*(F.col(f"`{c}`") for c in columns)), picked))


@F.pandas_udf(T.StringType())
def canonical_text(text: pd.Series) -> pd.Series:
    """The same of JSON text of any depth, which no expression of fixed depth can sort: a batch at a time; null if it is no JSON."""

    def dump(x):
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return text.map(dump)
