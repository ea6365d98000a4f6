"""Table-driven checks of structs: the errors of a row as an array, so a batch never fails on one row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What a field (a path with dots) must be. Lengths are of strings and arrays; a field that is null and not required passes."""

    field: str
    required: bool = False
    const: object = None
    among: tuple = ()
    least: float | None = None
    most: float | None = None
    shortest: int | None = None
    longest: int | None = None
    pattern: str | None = None


def _fails(rule: Rule, kind: str) -> list[tuple[Column, str]]:
    x = F.col(rule.field)
    size = F.size(x) if kind.startswith("array") else F.length(x.cast("string"))
    found = [(x.isNull(), "is required")] if rule.required else []
    for given, bad, says in (
        (rule.const is not None, x != F.lit(rule.const), f"is not {rule.const}"),
        (bool(rule.among), ~x.isin(*rule.among), f"is none of {', '.join(map(str, rule.among))}"),
        (rule.least is not None, x < F.lit(rule.least), f"is below {rule.least}"),
        (rule.most is not None, x > F.lit(rule.most), f"is above {rule.most}"),
        (rule.shortest is not None, size < F.lit(rule.shortest), f"is shorter than {rule.shortest}"),
        (rule.longest is not None, size > F.lit(rule.longest), f"is longer than {rule.longest}"),
        (rule.pattern is not None, ~x.cast("string").rlike(rule.pattern or ""), f"does not match {rule.pattern}"),
    ):
        if given:
            found.append((F.coalesce(bad, F.lit(False)), says))
    return found


def errors(df: DataFrame, rules: list[Rule], name: str = "errors") -> DataFrame:
    """df with an array of messages, in the order of the rules; it is empty where all hold."""
    made = [F.when(bad, F.lit(f"{r.field} {says}")) for r in rules for bad, says in _fails(r, df.select(r.field).dtypes[0][1])]
    return df.withColumn(name, F.filter(F.array(*made), lambda e: e.isNotNull()))


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """The rows without errors, and those with errors and what they are."""
    checked = errors(df, rules)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def unknown_keys(json: Column, known: list[str]) -> Column:
    """The keys of a JSON object that a closed schema does not have."""
    return F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, known)))


def decline(*rules: tuple[Column, str, str]) -> Column:
    """struct(reason, message) of the first rule (holds, reason, message) that does not hold, else null."""
    none = F.lit(None).cast("struct<reason:string,message:string>")
    return reduce(lambda found, r: F.when(~F.coalesce(r[0], F.lit(False)), F.struct(F.lit(r[1]).alias("reason"), F.lit(r[2]).alias("message"))).otherwise(found), reversed(rules), none)
