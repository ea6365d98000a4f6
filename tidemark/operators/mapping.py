"""Text labels to targets: exact, then by substrings in order, from a registry or another table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More entries than this are refused: they are compiled into one expression. A longer registry is a table for first_substring.
MAX_ENTRIES = 1000
#: Characters of the runs that labels and texts are joined on.
GRAM = 3


def priority_match(label: Column, registry: tuple[tuple[str, str], ...], default: str) -> Column:
    """The target of the entry (label, target) that equals the label, case and outer spaces aside; else of the first entry
    that holds it or is held by it; else the default. A blank label is held by the first entry; null has the default."""
    if len(registry) > MAX_ENTRIES:
        raise ValueError(f"at most {MAX_ENTRIES} entries")
    low = F.lower(F.trim(label))
    fold = lambda test, otherwise: reduce(lambda found, e: F.when(test(F.lit(e[0].lower())), e[1]).otherwise(found), reversed(registry), otherwise)
    return F.transform(F.array(low), lambda x: fold(lambda e: x == e, fold(lambda e: F.contains(e, x) | F.contains(x, e), F.lit(default))))[0]


def _grams(text: Column, n: int) -> Column:
    """All runs of n characters of a text, each once."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, F.lit(n))))


def _every_gram(text: Column) -> Column:
    return F.flatten(F.array(*(_grams(text, n) for n in range(1, GRAM + 1))))


def _holding(texts: DataFrame, text: str, labels: DataFrame, label: str) -> DataFrame:
    """Rows of texts and labels, both not empty, whose text holds the label.

    A text that holds a label has all of its runs of GRAM characters (a shorter label is one run), so one is enough to join
    on: the one that the fewest texts have. A label with a run that no text has is in none.
    """
    held = texts.select("*", F.explode(_every_gram(F.col(text))).alias("__g"))
    counts = held.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    own = F.when(F.length(label) >= GRAM, _grams(F.col(label), GRAM)).otherwise(F.array(label))
    runs = labels.select("*", F.explode(own).alias("__g")).join(counts, "__g", "left")
    rarest = runs.groupBy(*labels.columns).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__g").alias("g"))).alias("__r")).where("__r.n > 0")
    return held.join(rarest.select(*labels.columns, F.col("__r.g").alias("__g")), "__g").where(F.contains(text, label)).drop("__g")


def first_substring(left: DataFrame, key: str, label: str, right: DataFrame, order: str, other: str) -> DataFrame:
    """(key, order): for each left row the least `order` of the right rows whose label holds the left one's or is held by
    it, case aside; left rows without one are not there, nor are null labels.

    Equal labels are one, each pair that shares its label's rarest run is tested, and no row is compared with all others.
    Blank labels are held by everything, which one row says.
    """
    a = left.select(F.col(key).alias("k"), F.lower(label).alias("x")).where("x IS NOT NULL")
    b = right.select(F.col(order).alias("o"), F.lower(other).alias("y")).where("y IS NOT NULL")
    x, y = a.where("x <> ''").select("x").distinct(), b.where("y <> ''").groupBy("y").agg(F.min("o").alias("o"))
    both = _holding(x, "x", y, "y").select("x", "o").unionByName(_holding(y, "y", x, "x").select("x", "o"))
    pairs = a.join(both.groupBy("x").agg(F.min("o").alias("o")), "x").select("k", "o")
    # one row each: the first of all right rows for blank left labels, the first blank right row for all left ones
    blank = b.where("y = ''").agg(F.min("o").alias("o")).where("o IS NOT NULL")
    first = b.agg(F.min("o").alias("o")).where("o IS NOT NULL")
    pairs = pairs.unionByName(a.select("k").crossJoin(F.broadcast(blank))).unionByName(a.where("x = ''").select("k").crossJoin(F.broadcast(first)))
    return pairs.groupBy(F.col("k").alias(key)).agg(F.min("o").alias(order))
