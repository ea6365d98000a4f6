"""Sharding by size-tiered compaction: small immutable shards, merges of similar sizes, versioned manifests.

Layout of a store's folder:
    data/<part>/*.parquet       immutable shards; a file never changes after its manifest is committed
    manifests/<version>.json    one line for each shard that came or went, and in each FULL_EVERY-th one for each live shard;
                                a version appears by one rename and is never replaced
    leases/<part>               a writer's, from before its first file until its commit; vacuum() leaves such parts alone
Readers take the newest manifest, so a job that fails or an executor that is lost leaves only files that none names.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import Workspace, table

#: Every so many versions a manifest names all live shards, so that a reader needs at most as many manifests and a commit writes little.
FULL_EVERY = 16


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    tier: int
    made_in: int


class CommitConflict(RuntimeError):
    """Another writer committed this version first; read it and try again."""


class ShardStore:
    """All file operations go through the Hadoop file system of the folder, all rows through Spark's own readers and writers.

    Rows go through as they are: nulls, texts of any length, repeated rows and columns of any name but __arrival. Rows with
    a null arrival have shards of their own. An empty table is a version without rows; compacting it merges nothing but empty files.
    """

    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = 64 << 20, fanout: int = 4, least_bytes: int = 1 << 20):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.target_bytes, self.fanout, self.least_bytes = target_bytes, fanout, least_bytes
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        place = self._path(f"{self.folder}/manifests")
        if not self.fs.exists(place):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(place)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _manifest(self, version: int) -> list[str]:
        stream = self.fs.open(self._path(f"{self.folder}/manifests/{version:010d}.json"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        finally:
            stream.close()

    def live(self, version: int | None = None) -> list[Shard]:
        """The shards of a version: files, not rows, so a list for the driver."""
        version = self.version() if version is None else version
        found: dict[str, Shard] = {}
        for v in range(self._full_before(version), version + 1):
            for line in map(json.loads, self._manifest(v)[1:]):
                if "gone" in line:
                    found.pop(line["gone"], None)
                else:
                    found[line["path"]] = Shard(**line)
        return list(found.values())

    @staticmethod
    def _full_before(version: int) -> int:
        """The newest version up to this one whose manifest names all live shards."""
        return max(1, version // FULL_EVERY * FULL_EVERY)

    def schema(self, version: int | None = None) -> StructType:
        """The rows' schema in a version, which is the first line of its manifest."""
        return StructType.fromJson(json.loads(self._manifest(self.version() if version is None else version)[0])["schema"])

    def commit(self, base: int, new: list[Shard], gone: set[str], schema: StructType) -> int:
        """Writes the next manifest under a name of its own, then renames it. Raises CommitConflict if base is not the newest version any more."""
        version = base + 1
        final = self._path(f"{self.folder}/manifests/{version:010d}.json")
        temp = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        parts = {s.path.split("/")[1] for s in new}
        if self.version() != base or self.fs.exists(final):
            self._release(parts)
            raise CommitConflict(f"version {version} is there")
        if not all(self.fs.exists(self._lease(p)) for p in parts):
            raise CommitConflict("a lease ran out before its files were committed")
        full = self._full_before(version) == version
        named = [s for s in self.live(base) if s.path not in gone] + new if full else new
        lines = [{"version": version, "schema": schema.jsonValue()}, *(asdict(s) for s in sorted(named, key=lambda s: s.path)), *({"gone": path} for path in sorted(gone) if not full)]
        out = self.fs.create(temp, False)
        try:
            out.write("".join(json.dumps(line) + "\n" for line in lines).encode())
        finally:
            out.close()
        # one step on HDFS; a store without such a rename needs a lock around this call
        try:
            self._rename(temp, final)
        except Exception as e:
            self.fs.delete(temp, False)
            raise CommitConflict(f"version {version} is there") from e
        finally:
            self._release(parts)
        return version

    def _rename(self, source, target) -> None:
        """Onto a name that must be free; a local disk tests it first."""
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(source, target, self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))

    def _lease(self, part: str):
        return self._path(f"{self.folder}/leases/{part}")

    def _release(self, parts: set[str]) -> None:
        for p in parts:
            self.fs.delete(self._lease(p), False)

    def tier_of(self, size: int) -> int:
        """0 below least_bytes, then one more for each power of fanout, and the last one for shards of target size."""
        if size >= self.target_bytes // 2:
            return 99
        tier, top = 0, self.least_bytes
        while size >= top:
            tier, top = tier + 1, top * self.fanout
        return tier

    def _written(self, df: DataFrame, version: int, arrival: str | None = None) -> list[Shard]:
        """Writes each task's rows as a file, or as one for each value of a column, and lists the files. They have a lease until they are committed."""
        part = f"{version:010d}-{uuid.uuid4().hex}"
        place = f"{self.folder}/data/{part}"
        self.fs.create(self._lease(part), False).close()
        if arrival is None:
            df.write.parquet(place)
        else:
            df.withColumn("__arrival", F.col(f"`{arrival}`")).write.partitionBy("__arrival").parquet(place)
        return self._listed(place, version)

    def append(self, df: DataFrame, arrival: str | None = None) -> int:
        """Adds rows as small shards: each task writes a file, or one for each value of the column `arrival`, without a shuffle."""
        base = self.version()
        if base and self.schema() != df.schema:
            raise ValueError("the rows' schema is not the store's")
        return self.commit(base, self._written(df, base + 1, arrival), set(), df.schema)

    def _listed(self, place: str, version: int) -> list[Shard]:
        root = self.fs.makeQualified(self._path(self.folder)).toString()
        files, found = self.fs.listFiles(self._path(place), True), []
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet"):
                found.append(Shard(f.getPath().toString()[len(root) + 1 :], f.getLen(), self.tier_of(f.getLen()), version))
        return found

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """What a compaction merges: of each tier with at least fanout shards, runs of neighbours by size."""
        by: dict[int, list[Shard]] = {}
        for s in shards:
            if s.tier != 99:
                by.setdefault(s.tier, []).append(s)
        return [sorted(group, key=lambda s: (s.bytes, s.path)) for _, group in sorted(by.items()) if len(group) >= self.fanout]

    def compact(self) -> int:
        """Merges the runs of all tiers and commits once; returns the newest version, which stays if nothing is to be merged.

        Each task reads whole shards of a tier, of up to five quarters of the target together, and writes them as one file,
        so nothing is shuffled. A shard that is merged has less than half the target, so every file but a tier's last one
        has more than three quarters of it. The old shards stay for readers of older versions until vacuum().
        """
        base = self.version()
        runs = self.runs(self.live(base))
        if not runs:
            return base
        schema, new = self.schema(), []
        for run in runs:
            with self._set({"spark.sql.files.maxPartitionBytes": str(self.target_bytes * 5 // 4), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}):
                new += self._written(self._rows(run, schema), base + 1)
        return self.commit(base, new, {s.path for run in runs for s in run}, schema)

    @contextmanager
    def _set(self, settings: dict[str, str]):
        """Session settings for the time of one job."""
        before = {k: self.spark.conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _rows(self, shards: list[Shard], schema: StructType) -> DataFrame:
        """The rows of some shards, without the column that Spark makes of a folder's name."""
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{s.path}" for s in shards)).select(*(F.col(f"`{c}`") for c in schema.names))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        shards, schema = self.live(version), self.schema(version)
        return self._rows(shards, schema) if shards else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1, lease: float = 86_400.0) -> int:
        """Deletes the shards that none of the newest `keep` manifests names, and the older manifests. Returns how many files went.

        Files whose writer has a lease stay, unless it is older than `lease` seconds: then it goes first, so that its writer
        cannot commit any more. Files are listed before leases and these before manifests, so a file without a lease here
        has been committed before the manifests are read, or never will be.
        """
        files = self._listed(f"{self.folder}/data", 0)
        place, open_ = self._path(f"{self.folder}/leases"), set()
        for s in self.fs.listStatus(place) if self.fs.exists(place) else []:
            if s.getModificationTime() < (time.time() - lease) * 1000:
                self.fs.delete(s.getPath(), False)
            else:
                open_.add(s.getPath().getName())
        newest = self.version()
        named = {s.path for v in range(max(1, newest - keep + 1), newest + 1) for s in self.live(v)}
        gone = 0
        for s in files:
            if s.path not in named and s.path.split("/")[1] not in open_:
                gone += bool(self.fs.delete(self._path(f"{self.folder}/{s.path}"), False))
        for v in range(1, self._full_before(max(1, newest - keep + 1))):
            self.fs.delete(self._path(f"{self.folder}/manifests/{v:010d}.json"), False)
        return gone


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four batches, each of which is a version; after each second one they are compacted, and what
    no version needs any more goes. Read back by the newest manifest: one row a document."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("batch", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)))
    store = ShardStore(spark, Workspace(spark, "shards").path)
    for k in range(4):
        store.append(docs.where(F.col("batch") == k), "batch")
        if k % 2:
            store.compact()
            store.vacuum()
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", "batch", F.length(text).cast("long").alias("chars"), F.sha2(text, 256).alias("text_sha256"))


OP10_SQL = """
SELECT doc_id, ((coalesce(doc_id, 0) % 4) + 4) % 4 AS batch, length(coalesce(text, '')) AS chars, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
