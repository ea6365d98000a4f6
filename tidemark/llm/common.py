"""What the operators share: the cluster's shared folder, written tables, Arrow text buffers and 64-bit mixing."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Odd constants of the public splitmix64 finalizer.
MIX_A, MIX_B, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one that is made and set here."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


#: Workspaces made inside scratch(), while it is open.
_made: ContextVar[list | None] = ContextVar("made", default=None)


@contextmanager
def scratch():
    """Workspaces that are made inside are removed at the end: what reads them must be written elsewhere by then."""
    found: list[Workspace] = []
    token = _made.set(found)
    try:
        yield
    finally:
        _made.reset(token)
        for work in found:
            work.remove()


class Workspace:
    """A folder of its own under the shared one; tables written there cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        if (found := _made.get()) is not None:
            found.append(self)

    def remove(self) -> None:
        """Deletes all that is in it."""
        fs, path = self.file_system()
        fs.delete(path, True)

    def next_path(self, name: str) -> str:
        self._count += 1
        return f"{self.path}/{self._count:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.next_path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def file_system(self, path: str | None = None):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path or self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of this workspace that no later step reads."""
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            fs, path = self.file_system(name)
            fs.delete(path, True)


def numbered(df: DataFrame, work: Workspace, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds each row's number (from 1) among those of its keys by `order`, nulls first; a null key is a key.

    Rows are dealt by ranges of keys and order and written in that order with the number that a task gives them; where a
    key begins in a range, and how many rows it has in the ranges before, is one joined row for each range and key in it.
    `df` is read twice, so it should be cheap to read.
    """
    made = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id())
    dealt = work.write(made, "dealt").withColumn("__g", F.struct(*keys, F.shiftright("__at", 33).alias("__part")))
    parts = dealt.groupBy("__g").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*(F.col("__g")[k] for k in keys)).orderBy(F.col("__g")["__part"]).rowsBetween(W.unboundedPreceding, -1)
    shift = parts.select("__g", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    return dealt.join(shift, "__g").withColumn(name, F.col("__at") + F.col("__shift")).drop("__g", "__at", "__shift")


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), *cols), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def sql_crc32(text: str) -> str:
    """CRC-32 of an ASCII text as DuckDB SQL, bit by bit."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {step})), 4294967295)"


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def filled(column: pa.Array) -> pa.Array:
    """A string column with empty texts for nulls."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each text's bounds in them."""
    column = filled(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Parts of a batch whose texts have about `most` bytes together, so that scratch memory is bounded by the longest text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
