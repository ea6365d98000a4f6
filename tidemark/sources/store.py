"""A keyed store and a dataset behind a pointer, both on the Hadoop file system of their folder."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer came first."""


def rename_onto_free(spark: SparkSession, source, target) -> None:
    """Renames a file onto a name that must be free, else raises. One step on HDFS; on a local disk the name is tested first."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    context.rename(source, target, spark.sparkContext._gateway.new_array(kinds, 0))


class Pointer:
    """A dataset that is replaced whole: a new version is written beside the old one, then a numbered file that names it
    appears by the rename of a whole file onto a name that must be free. So of two writers on one version the second fails,
    and a writer that dies at any step leaves files that no number names and that block nobody; vacuum() removes them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _named(self, number: int) -> str:
        stream = self.fs.open(self._path(f"{self.path}/pointers/{number:010d}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def number(self) -> int:
        """The newest version, 0 before the first."""
        place = self._path(f"{self.path}/pointers")
        names = [x.getPath().getName() for x in self.fs.listStatus(place)] if self.fs.exists(place) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def current(self) -> str | None:
        number = self.number()
        return f"{self.path}/data/{self._named(number)}" if number else None

    def replace(self, df: DataFrame, base: int | None = None) -> int:
        """Makes df the version after `base` (the newest, if it is not given). Raises Conflict if that is there."""
        number = (self.number() if base is None else base) + 1
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{name}")
        temp = self._path(f"{self.path}/pointers/.{name}")
        out = self.fs.create(temp, False)
        try:
            out.write(f"{name}\n".encode())
        finally:
            out.close()
        try:
            rename_onto_free(self.spark, temp, self._path(f"{self.path}/pointers/{number:010d}"))
        except Exception as e:
            self.fs.delete(temp, False)
            raise Conflict(f"version {number} is there") from e
        return number

    def vacuum(self, keep: int = 1, grace: float = 86_400.0) -> int:
        """Deletes the data of versions before the newest `keep`, and what writers without a version left more than `grace` seconds ago;
        returns how many folders went. A writer must not take longer than that."""
        place = self._path(f"{self.path}/data")
        found = {x.getPath().getName(): x.getModificationTime() for x in self.fs.listStatus(place)} if self.fs.exists(place) else {}
        newest = self.number()
        old = {self._named(n) for n in range(1, newest - keep + 1) if self.fs.exists(self._path(f"{self.path}/pointers/{n:010d}"))}
        kept = {self._named(n) for n in range(max(1, newest - keep + 1), newest + 1)}
        gone = [n for n, at in found.items() if n in old or n not in kept and at < (time.time() - grace) * 1000]
        for n in gone:
            self.fs.delete(self._path(f"{self.path}/data/{n}"), True)
        return len(gone)

    def read(self, schema: T.StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.current())


class KeyValues:
    """Rows (bucket, key, value) below a folder; the latest of a key counts.

    Each put is a folder of its own; compact() puts the latest rows of all of them into one base behind a Pointer and
    removes them. A reader that has listed a put before it went must read again.
    """

    SCHEMA = "key STRING, value STRING, at LONG, bucket STRING"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.base = Pointer(spark, f"{self.path}/base")

    def put(self, rows: DataFrame, at: int) -> None:
        """rows: bucket, key, value; at: a number that grows with each call."""
        rows.select("key", "value", F.lit(at).cast("long").alias("at"), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/puts/{at:020d}-{uuid.uuid4().hex}")

    def _puts(self) -> list[str]:
        place = self.base._path(f"{self.path}/puts")
        found = self.base.fs.listStatus(place) if self.base.fs.exists(place) else []
        done = lambda x: self.base.fs.exists(self.base._path(x.getPath(), "_SUCCESS"))
        return [x.getPath().toString() for x in found if done(x)]

    def _rows(self, puts: list[str], bucket: str | None = None) -> DataFrame:
        """All rows of some puts and of the base; of one bucket only its files of the puts are read."""
        parts = [self.spark.read.schema(self.SCHEMA).option("basePath", p).parquet(p) for p in puts]
        if self.base.current():
            parts.append(self.base.read(self.SCHEMA))
        every = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.SCHEMA)
        return every if bucket is None else every.where(F.col("bucket") == bucket)

    def get(self, bucket: str) -> DataFrame:
        """(key, value) of a bucket."""
        return self._rows(self._puts(), bucket).groupBy("key").agg(F.max_by("value", "at").alias("value"))

    def existing(self, wanted: DataFrame) -> DataFrame:
        """The rows (bucket, key) of `wanted` that have a value."""
        return wanted.join(self._rows(self._puts()), ["bucket", "key"], "left_semi")

    def compact(self) -> int:
        """Returns how many puts went."""
        puts = self._puts()
        if not puts:
            return 0
        row = F.struct("value", "at")
        latest = self._rows(puts).groupBy("bucket", "key").agg(F.max_by(row, "at").alias("r")).select("key", "r.*", "bucket")
        self.base.replace(latest.sortWithinPartitions("bucket"))
        for p in puts:
            self.base.fs.delete(self.base._path(p), True)
        self.base.vacuum()
        return len(puts)
