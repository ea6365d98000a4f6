"""A chunk index of segments: an update writes what has changed, and readers merge.

Layout of an index's folder:
    segments/<name>/docs     doc_id, hash, chunks, tokens, gone: the documents that the segment is newest for
    segments/<name>/chunks   their chunks with vectors
    versions/<number>        the segments, oldest first, and totals; a version appears by one rename onto a free name
    runs/<number>            what each update changed, a line of JSON
A document is as its newest segment says, which may be that it is gone: a newer row of docs is a delete vector for the older
chunks. Segments of similar size are merged, so a document is rewritten about as often as the logarithm of the index's growth.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.chunk import fixed_windows
from tidemark.operators.embedding import embed
from tidemark.sources.store import Conflict, rename_onto_free

DOCS = "doc_id long, hash string, chunks long, tokens long, gone boolean"
CHUNKS = "doc_id long, hash string, chunk long, n_tokens long, text string, v array<double>"
#: Of a new index.
EMPTY = {"segments": [], "chunks": 0, "tokens": 0, "batch": -1}


class Index:
    """fanout: so many segments of one size class, the newest ones, are merged into one."""

    def __init__(self, spark: SparkSession, path: str, backend: str = "stub", dim: int = 16, fanout: int = 4):
        self.spark, self.path, self.backend, self.dim, self.fanout = spark, path.rstrip("/"), backend, dim, fanout
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def number(self) -> int:
        """The newest version, 0 before the first."""
        place = self._path(f"{self.path}/versions")
        names = [x.getPath().getName() for x in self.fs.listStatus(place)] if self.fs.exists(place) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def version(self, number: int | None = None) -> dict:
        number = self.number() if number is None else number
        if not number:
            return EMPTY
        stream = self.fs.open(self._path(f"{self.path}/versions/{number:010d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, folder: str, number: int, content: dict) -> None:
        temp = self._path(f"{self.path}/{folder}/.{uuid.uuid4().hex}")
        out = self.fs.create(temp, False)
        try:
            out.write((json.dumps(content) + "\n").encode())
        finally:
            out.close()
        try:
            rename_onto_free(self.spark, temp, self._path(f"{self.path}/{folder}/{number:010d}"))
        except Exception as e:
            self.fs.delete(temp, False)
            raise Conflict(f"{folder}/{number} is there") from e

    def _segment(self, name: str, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/segments/{name}/{part}")

    def _newest(self, segments: list[dict]) -> DataFrame:
        """(doc_id, seq, hash, chunks, tokens, gone): each document by the last of some segments that has it."""
        parts = [self._segment(s["name"], "docs", DOCS).withColumn("seq", F.lit(k)) for k, s in enumerate(segments)]
        if not parts:
            return self.spark.createDataFrame([], DOCS + ", seq int")
        row = F.struct("hash", "chunks", "tokens", "gone", "seq")
        return reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.max_by(row, "seq").alias("r")).select("doc_id", "r.*")

    def _live(self, segments: list[dict]) -> DataFrame:
        """The chunks of some segments less those that a later one of them has replaced or deleted."""
        if not segments:
            return self.spark.createDataFrame([], CHUNKS)
        parts = [self._segment(s["name"], "chunks", CHUNKS).withColumn("seq", F.lit(k)) for k, s in enumerate(segments)]
        every = reduce(DataFrame.unionByName, parts)
        return every.join(self._newest(segments).where("NOT gone").select("doc_id", "seq"), ["doc_id", "seq"], "left_semi").drop("seq") if len(segments) > 1 else every.drop("seq")

    def chunks(self, number: int | None = None) -> DataFrame:
        """Merged on read."""
        return self._live(self.version(number)["segments"])

    def documents(self, number: int | None = None) -> DataFrame:
        """(doc_id, hash, chunks, tokens)."""
        return self._newest(self.version(number)["segments"]).where("NOT gone").drop("gone", "seq")

    def _write(self, docs: DataFrame, chunks: DataFrame) -> str:
        name = uuid.uuid4().hex
        chunks.write.parquet(f"{self.path}/segments/{name}/chunks")
        docs.write.parquet(f"{self.path}/segments/{name}/docs")
        return name

    def _made(self, docs: DataFrame) -> DataFrame:
        cut = docs.select("doc_id", "hash", F.posexplode(fixed_windows(F.col("text"))).alias("chunk", "c"))
        rows = cut.select("doc_id", "hash", F.col("chunk").cast("long").alias("chunk"), (F.col("c.stop") - F.col("c.start")).alias("n_tokens"), F.col("c.text").alias("text"))
        return embed(rows, self.backend, self.dim)

    @contextmanager
    def _logged(self, operation: str):
        """A line of the run's log: what it changed, how long it took, and whether it failed."""
        begun, line = time.time(), {"operation": operation, "success": False, "error": None}
        try:
            yield line
            line["success"] = True
        except Exception as e:
            line["error"] = f"{type(e).__name__}: {e}"[:500]
            raise
        finally:
            line |= {"timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(begun)), "total_time_ms": int((time.time() - begun) * 1000)}
            place = self._path(f"{self.path}/runs/{int(begun * 1000):014d}-{uuid.uuid4().hex[:8]}.json")
            out = self.fs.create(place, False)
            try:
                out.write((json.dumps(line) + "\n").encode())
            finally:
                out.close()

    def runs(self) -> DataFrame:
        """The log of updates, one row each."""
        kind = "timestamp string, operation string, batch long, files_changed long, files_added long, files_removed long, chunks_before long, chunks_after long, tokens_before long, tokens_after long, total_time_ms long, success boolean, error string"
        return self.spark.read.schema(kind).json(f"{self.path}/runs")

    def apply(self, changes: DataFrame, batch: int | None = None) -> dict | None:
        """changes (doc_id, text, hash): documents that are new or have changed, each once; a null hash deletes one. Writes a
        segment of them alone. batch: a number that grows; one that is not above the last one is done already, and gives None.
        Documents with the hash that is known stay as they are. A writer that came first makes this fail before anything is seen."""
        base = self.number()
        old = self.version(base)
        if batch is not None and batch <= old["batch"]:
            return None
        with self._logged("apply") as line:
            known = self._newest(old["segments"]).where("NOT gone").select("doc_id", F.col("hash").alias("old"), F.col("chunks").alias("old_chunks"), F.col("tokens").alias("old_tokens"))
            joined = changes.join(known, "doc_id", "left").where("NOT (hash <=> old)")
            made = self._made(joined.where("hash IS NOT NULL").select("doc_id", "text", "hash"))
            name = uuid.uuid4().hex
            made.write.parquet(f"{self.path}/segments/{name}/chunks")
            sizes = self._segment(name, "chunks", CHUNKS).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_tokens").alias("tokens"))
            zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
            rows = joined.drop("text").join(sizes, "doc_id", "left").select("doc_id", "hash", zero("chunks").alias("chunks"), zero("tokens").alias("tokens"), F.col("hash").isNull().alias("gone"), "old", "old_chunks", "old_tokens")
            rows.write.parquet(f"{self.path}/segments/{name}/docs")
            written = self._segment(name, "docs", DOCS + ", old string, old_chunks long, old_tokens long")
            row = written.agg(
                F.count(F.lit(1)).alias("n"), F.count_if(F.col("old").isNotNull() & ~F.col("gone")).alias("files_changed"), F.count_if(F.col("old").isNull()).alias("files_added"), F.count_if("gone").alias("files_removed"),
                zero(F.sum("chunks") - zero(F.sum("old_chunks"))).alias("chunks"), zero(F.sum("tokens") - zero(F.sum("old_tokens"))).alias("tokens"), zero(F.sum("chunks")).alias("size"),
            ).first()
            new = {"segments": [*old["segments"], {"name": name, "docs": row["n"], "chunks": row["size"]}] if row["n"] else old["segments"], "chunks": old["chunks"] + row["chunks"], "tokens": old["tokens"] + row["tokens"], "batch": old["batch"] if batch is None else batch}
            self._put("versions", base + 1, new)
            stats = {c: row[c] for c in ("files_changed", "files_added", "files_removed")} | {f"{c}_{when}": v[c] for c in ("chunks", "tokens") for when, v in (("before", old), ("after", new))}
            line |= stats | {"batch": batch}
        self.compact()
        return stats

    def update(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, text, hash): all documents there are now, each once. Those that differ from the index are applied, and
        those that are gone deleted; of the others only hashes are compared. Returns one row with what changed, counted."""
        gone = self.documents().select("doc_id").join(docs, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("hash"))
        stats = self.apply(docs.select("doc_id", "text", "hash").unionByName(gone))
        return self.spark.createDataFrame([tuple(stats.values())], ", ".join(f"{c} long" for c in stats))

    def compact(self) -> int:
        """Merges the newest segments, while the last `fanout` of them are of one size class, and returns the newest version.
        The version before stays whole for its readers until vacuum()."""
        while True:
            base = self.number()
            now = self.version(base)
            last = now["segments"][-self.fanout :]
            size = lambda s: max(s["docs"], 1).bit_length() // 2
            if len(last) < self.fanout or size(last[0]) > max(map(size, last[1:])):
                return base
            whole = len(last) == len(now["segments"])
            docs = self._newest(last).drop("seq")
            # with older segments beneath, what is deleted must stay deleted
            name = self._write(docs.where("NOT gone") if whole else docs, self._live(last))
            row = self._segment(name, "docs", DOCS).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks")).first()
            self._put("versions", base + 1, now | {"segments": [*now["segments"][: -self.fanout], {"name": name, "docs": row["docs"], "chunks": row["chunks"]}]})

    def vacuum(self, keep: int = 1, grace: float = 86_400.0) -> int:
        """Deletes segments that only versions before the newest `keep` name at once, and those that none names after `grace`
        seconds, within which a writer must commit. Returns how many went."""
        newest = self.number()
        kept = {s["name"] for v in range(max(1, newest - keep + 1), newest + 1) for s in self.version(v)["segments"]}
        numbers = [v for v in range(1, newest - keep + 1) if self.fs.exists(self._path(f"{self.path}/versions/{v:010d}"))]
        old = {s["name"] for v in numbers for s in self.version(v)["segments"]} - kept
        place, gone = self._path(f"{self.path}/segments"), 0
        for x in self.fs.listStatus(place) if self.fs.exists(place) else []:
            name = x.getPath().getName()
            if name in old or name not in kept and x.getModificationTime() < (time.time() - grace) * 1000:
                gone += bool(self.fs.delete(x.getPath(), True))
        for v in numbers:
            self.fs.delete(self._path(f"{self.path}/versions/{v:010d}"), False)
        return gone
