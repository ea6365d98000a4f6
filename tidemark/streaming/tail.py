"""Structured Streaming over the event log: filters, budget alerts, changed files, incremental chunks and an index that follows.

Each function takes a streaming DataFrame and returns one; drain() runs it over all that is there and returns what was
written, with its checkpoint and its sink in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.chunk import fixed_windows
from tidemark.sources.files import folder
from tidemark.streaming.stateful import rocksdb


def source(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def drain(stream: DataFrame, name: str, sink: str | None = None, marks: str | None = None) -> DataFrame:
    """Runs a stream over all that is there. With a sink and marks that have been used it goes on from there."""
    spark = stream.sparkSession
    sink, marks = sink or folder(spark, f"{name}-sink"), marks or folder(spark, f"{name}-marks")
    with rocksdb(spark):
        run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def slow_turns(events: DataFrame, least: float) -> DataFrame:
    """The followed log behind a filter."""
    return events.where(F.col("value") >= least).select("event_id", "event_type", "value")


def budget_alerts(events: DataFrame, budget: float, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Windows whose p95 is over the budget, once the watermark has passed them."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    p = timed.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.percentile("value", F.lit(0.95)).alias("p95"), F.count(F.lit(1)).alias("n"))
    return p.where(F.col("p95") > budget).select(F.col("w.start").alias("start"), "event_type", "p95", "n")


def changed(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each path once for each content: rows (path, content hash, at) without repeats inside the watermark."""
    return files.withWatermark("at", late).dropDuplicatesWithinWatermark(["path", "hash"])


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two listings (path, hash): created, modified or deleted. A file source never tells of deletions; this does."""
    both = before.select("path", F.col("hash").alias("old")).join(after.select("path", F.col("hash").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def index_as_it_comes(docs: DataFrame, index, name: str, marks: str | None = None) -> None:
    """Runs a stream of new and changed documents (doc_id, text, hash; a null hash deletes) into an index: each batch is one
    segment of what it changes. A batch that runs again after a failure is known by its number and does nothing."""
    marks = marks or folder(docs.sparkSession, f"{name}-marks")

    def take(batch: DataFrame, number: int) -> None:
        newest = F.struct("text", "hash")
        index.apply(batch.groupBy("doc_id").agg(F.max_by(newest, F.struct("hash")).alias("r")).select("doc_id", "r.*"), number)

    docs.writeStream.foreachBatch(take).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def new_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of documents as they arrive."""
    c = docs.select("doc_id", F.explode(fixed_windows(F.col("text"))).alias("c"))
    return c.select("doc_id", "c.start", "c.stop", F.sha2("c.text", 256).alias("hash"))
