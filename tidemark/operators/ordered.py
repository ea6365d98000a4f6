"""Row numbers and sliding windows over one long order without one long task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.files import folder

BLOCK = 20_000


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None) -> DataFrame:
    """Adds, of the rows before each row among those of its keys by `order`, which should be total: sums of columns, 0 where
    there is none, and values of the row just before, null where there is none. sums, last: new names and their columns.

    Rows are dealt by ranges of keys and order, so a hot key has many; windows end at a range. What the ranges before it add,
    one row for each range and key in it, is joined. The ranges are written first, so that both sides see the same ones.
    A null key is a key. Sums of doubles go on from what the range before has, in order, so a key that a border cuts in two has
    the sums of an uncut one; a key over more ranges has each one's sum added as a whole.
    """
    spark, sums, last = df.sparkSession, sums or {}, last or {}
    path, c = folder(spark, "ordered"), F.col
    added = {f"__s{i}": x for i, x in enumerate(sums.values())} | {f"__l{i}": x for i, x in enumerate(last.values())}
    made = df.withColumns(added).repartitionByRange(*keys, *order).withColumn("__g", F.struct(*keys, F.spark_partition_id().alias("__part")))
    inexact = [isinstance(made.schema[f"__s{i}"].dataType, (T.DoubleType, T.FloatType)) for i in range(len(sums))]
    (made.sortWithinPartitions(*keys, *order) if any(inexact) else made).write.parquet(path)
    dealt = spark.read.schema(made.schema).parquet(path)
    totals = [F.sum(f"__s{i}").alias(f"__t{i}") for i in range(len(sums))]
    end = F.max_by(F.struct(F.lit(True), *(c(f"__l{i}") for i in range(len(last)))), F.struct(*order))
    parts = dealt.groupBy("__g").agg(*totals, end.alias("__end"))
    earlier = W.partitionBy(*(c("__g")[k] for k in keys)).orderBy(c("__g")["__part"])
    before = [F.coalesce(F.sum(f"__t{i}").over(earlier.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"__t{i}") for i in range(len(sums))]
    parts = parts.select("__g", *before, F.lag("__end").over(earlier).alias("__end"))
    here = W.partitionBy("__g").orderBy(*order)
    joined, above = dealt.join(parts, "__g"), here.rowsBetween(W.unboundedPreceding, -1)
    if any(inexact):
        joined = joined.withColumn("__first", F.row_number().over(here) == 1)
    carried = lambda i: F.when(c("__first"), c(f"__t{i}") + F.coalesce(f"__s{i}", F.lit(0))).otherwise(c(f"__s{i}"))
    own = {n: F.coalesce(F.sum(carried(i)).over(above), c(f"__t{i}")) if inexact[i] else F.coalesce(F.sum(f"__s{i}").over(above), F.lit(0)) + c(f"__t{i}") for i, n in enumerate(sums)}
    own |= {n: F.when(F.row_number().over(here) == 1, c("__end")[f"__l{i}"]).otherwise(F.lag(f"__l{i}").over(here)) for i, n in enumerate(last)}
    return joined.withColumns(own).select(*(c(f"`{x}`") for x in df.columns if x not in own), *own)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """Adds each row's number (from 1) among those of its keys, by `order`, which should be total."""
    return running(df, keys, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) + 1)


def among_first(df: DataFrame, keys: list[str], order: list[str], n: int, name: str) -> DataFrame:
    """Adds whether a row is among the n first of its keys, by `order`, which should be total. Of each key n rows are compared
    after a cut in each task, and the last one's place is joined; a null key is a key."""
    group, place = F.struct(*keys), F.struct(*order)
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    edge = df.withColumn("__nth", nth).where(F.col("__nth") <= n).groupBy(group.alias("__g")).agg(F.max(place).alias("__edge"))
    return df.withColumn("__g", group).join(edge, "__g").withColumn(name, place <= F.col("__edge")).drop("__g", "__edge")


def sliding(df: DataFrame, keys: list[str], nth: str, last: int, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Adds an aggregate over each row and the last - 1 rows before it, of rows numbered by `nth` within their keys.

    A window is cut into blocks of rows; the last rows of a block are sent along with the next one too.
    """
    place = F.floor((F.col(nth) - 1) / block)
    reaches = F.floor((F.col(nth) - 1 + last - 1) / block)
    rows = df.withColumn("__block", F.explode(F.sequence(place, reaches)))
    w = W.partitionBy(*keys, "__block").orderBy(nth).rowsBetween(-(last - 1), 0)
    return rows.withColumn(name, value.over(w)).where(F.col("__block") == place).drop("__block")


def sessions(df: DataFrame, keys: list[str], order: list[str], at: str, gap: str, name: str = "session") -> DataFrame:
    """Adds the number (from 1) of each row's session among those of its keys: a row that comes later than `gap`, such as
    30 minutes, after the row before begins one.

    Dealt once by ranges, as in running(): of each range and key in it, one row tells its first and last time and how many
    sessions begin inside; whether its first row begins one, and how many there were before, comes from the ranges before it.
    """
    path, c = folder(df.sparkSession, "sessions"), F.col
    made = df.repartitionByRange(*keys, *order).withColumn("__g", F.struct(*keys, F.spark_partition_id().alias("__part")))
    made.write.parquet(path)
    here = W.partitionBy("__g").orderBy(*order)
    fresh = lambda now, then: F.when(now <= then + F.expr(f"INTERVAL {gap}"), 0).otherwise(1).cast("long")
    inner = F.when(F.row_number().over(here) == 1, F.lit(0).cast("long")).otherwise(fresh(c(at), F.lag(at).over(here)))
    rows = df.sparkSession.read.schema(made.schema).parquet(path).withColumn("__fresh", inner)
    place = F.struct(*order)
    parts = rows.groupBy("__g").agg(F.sum("__fresh").alias("__inside"), F.min_by(at, place).alias("__first"), F.max_by(at, place).alias("__last"))
    earlier = W.partitionBy(*(c("__g")[k] for k in keys)).orderBy(c("__g")["__part"])
    parts = parts.withColumn("__begins", fresh(c("__first"), F.lag("__last").over(earlier)))
    before = F.coalesce(F.sum(c("__inside") + c("__begins")).over(earlier.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__g", (before + c("__begins")).alias("__base"))
    return rows.join(parts, "__g").withColumn(name, c("__base") + F.sum("__fresh").over(here)).select(*(c(f"`{x}`") for x in df.columns if x != name), name)


class RankIndex:
    """The k-th least of any slice of an array, for many slices at once: a wavelet matrix over the values' ranks. A level for
    each bit of a rank, each one array operation over all slices, so a slice's length does not matter."""

    def __init__(self, values: np.ndarray):
        self.levels, codes = [], np.zeros(0, np.int64)
        self.distinct, codes = np.unique(values, return_inverse=True)
        for bit in reversed(range(max(1, int(len(self.distinct) - 1).bit_length()))):
            ones = (codes >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~ones)])
            self.levels.append((bit, zeros))
            codes = np.concatenate([codes[~ones], codes[ones]])

    def kth(self, start: np.ndarray, stop: np.ndarray, k: np.ndarray) -> np.ndarray:
        """k from 0 and below stop - start."""
        code, start, stop, k = np.zeros(len(k), np.int64), start.copy(), stop.copy(), k.copy()
        for bit, zeros in self.levels:
            low, high = zeros[start], zeros[stop]
            up = k >= high - low
            k = np.where(up, k - (high - low), k)
            start, stop = np.where(up, zeros[-1] + start - low, low), np.where(up, zeros[-1] + stop - high, high)
            code |= up.astype(np.int64) << bit
        return self.distinct[code]


def window_percentiles(values: np.ndarray, last: int, share: float) -> np.ndarray:
    """The interpolated percentile of each value and the last - 1 before it, NaN aside; NaN where a window has none."""
    there = ~np.isnan(values)
    seen = np.concatenate([[0], np.cumsum(there)])
    start, stop = seen[np.maximum(np.arange(len(values)) - last + 1, 0)], seen[1:]
    found, full = np.full(len(values), np.nan), stop > start
    if full.any():
        index, start, stop = RankIndex(values[there]), start[full], stop[full]
        at = share * (stop - start - 1)
        low = np.floor(at).astype(np.int64)
        first, next_ = index.kth(start, stop, low), index.kth(start, stop, np.minimum(low + 1, stop - start - 1))
        found[full] = np.where(at > low, first + (next_ - first) * (at - low), first)
    return found


def sliding_percentile(df: DataFrame, keys: list[str], nth: str, last: int, value: str, share: float, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the interpolated percentile of a column over each row and the last - 1 rows before it, nulls aside, of rows
    numbered by `nth` within their keys; null where a window has no value.

    Blocks are those of sliding(), and longer than a window; a block has one rank index, so its cost grows with its rows, not with `last`.
    """
    block = max(block, last)
    place = F.floor((F.col(nth) - 1) / block)
    reaches = F.floor((F.col(nth) - 1 + last - 1) / block)
    rows = df.withColumn("__block", F.explode(F.sequence(place, reaches)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(nth)
        found = window_percentiles(table.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float), last, share)
        out = pa.array(found, from_pandas=True)
        own = (table.column(nth).to_numpy() - 1) // block == table.column("__block").to_numpy()
        return table.drop_columns("__block").append_column(name, out).filter(pa.array(own))

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return rows.groupBy(*keys, "__block").applyInArrow(run, schema)


def percentile(df: DataFrame, keys: list[str], value: str, share: float, name: str, nearest: bool = False, accuracy: int = 10_000) -> DataFrame:
    """(keys, name): the exact percentile of a column by keys: interpolated, or with `nearest` the value at rank ceil(share * n).

    A sketch, whose ranks are off by n / accuracy at most, gives two values around the rank. What is below them is only
    counted, what is between them counted by value, both in each task before the shuffle. So ties are one row, and the rows
    of a hot key that are put in order are eight in `accuracy`. Nulls do not count; keys without a value have no row; a null key is a key.
    """
    reach = 4 / accuracy
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("__key"), F.col(value).cast("double").alias("__value"))
    near = F.percentile_approx("__value", [max(0.0, share - reach), min(1.0, share + reach)], accuracy)
    bounds = rows.groupBy("__key").agg(near.alias("__near"), F.count(F.lit(1)).alias("__size"))
    # of few rows a rank between two of them is as far away as the sketch's; NaN is above all other numbers
    many = F.col("__size") >= accuracy
    low = F.when(many & F.lit(share > reach), F.col("__near")[0]).otherwise(float("-inf"))
    high = F.when(many & F.lit(share + reach < 1), F.col("__near")[1]).otherwise(float("nan"))
    held = rows.join(bounds, "__key").where(F.col("__value") <= high).withColumn("__value", F.when(F.col("__value") < low, float("-inf")).otherwise(F.col("__value")))
    counts = held.groupBy("__key", "__size", "__value").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(W.partitionBy("__key").orderBy("__value"))
    placed = counts.withColumn("__upto", upto).withColumn("__before", F.col("__upto") - F.col("__n"))
    has = lambda rank: (F.col("__before") < rank) & (rank <= F.col("__upto"))
    if nearest:
        found = placed.where(has(F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("__size"))))).select("__key", F.col("__value").alias(name))
    else:
        place = F.lit(share) * (F.col("__size") - 1)
        first, last = F.floor(place), F.ceil(place)
        part = F.when(has(first + 1), 1 - (place - first)).otherwise(0.0) + F.when(has(last + 1), place - first).otherwise(0.0)
        found = placed.where(has(first + 1) | has(last + 1)).groupBy("__key").agg(F.sum(F.col("__value") * part).alias(name))
    return found.select(*(F.col("__key")[k].alias(k) for k in keys), name)
