"""Queries of readers and writers. What is written goes to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.ordered import numbered
from tidemark.registry import query, read
from tidemark.sources import files

C = F.col


@query("json_parse_or_drop", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def _(s, d):
    return read(s, d, "events").select("event_id", F.from_json("props", "k BIGINT").alias("p")).where("p.k IS NOT NULL").select("event_id", "p.k")


@query("json_path_get", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing.deep') AS missing FROM events")
def _(s, d):
    return read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing.deep").alias("missing"))


@query("scan_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def _(s, d):
    """Written as lines of JSON and read again with the schema."""
    rows = read(s, d, "conversations").select("conv_id", "turn", "role", "text")
    return files.read_jsonl(s, files.write_jsonl(rows, s, "turns"), rows.schema)


@query("scan_json_docs", "SELECT doc_id, length(text) AS chars FROM documents")
def _(s, d):
    rows = read(s, d, "documents").select("doc_id", "text")
    return files.read_jsonl(s, files.write_jsonl(rows, s, "documents"), rows.schema).select("doc_id", F.length("text").cast("long").alias("chars"))


@query("index_roundtrip", "SELECT vec_id, label, len(embedding)::BIGINT AS dim FROM embeddings")
def _(s, d):
    """One dataset for each label instead of an index with a row-aligned list of metadata."""
    rows = read(s, d, "embeddings")
    return files.versioned(s, rows, "index", "label").select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


@query("scan_binary_hash")
def _(s, d):
    """The sha256 of each file of a written dataset, and its size."""
    path = files.write_jsonl(read(s, d, "benchmark"), s, "benchmark")
    return s.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.sha2("content", 256).alias("sha256"), "length")


@query("split_concat_json", "SELECT event_id, 1 + i AS part, event_id * 10 + i AS v FROM events, (SELECT unnest([0, 1])::BIGINT AS i) WHERE event_type = 'click'")
def _(s, d):
    """Objects that follow each other without a separator, split where one ends at depth 0 outside strings."""
    e = read(s, d, "events").where("event_type = 'click'")
    joined = F.concat(F.lit('{"s":"}{","v":'), (C("event_id") * 10).cast("string"), F.lit('}{"s":"\\"{","v":'), (C("event_id") * 10 + 1).cast("string"), F.lit("}"))
    parts = files.split_objects(e.select("event_id", joined.alias("raw")), "raw")
    return parts.select("event_id", C("part").cast("long"), F.from_json("object", "s STRING, v BIGINT")["v"].alias("v"))


@query("daily_log_sink", "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def _(s, d):
    """Appended in two parts, with a folder for each day."""
    path, e = files.folder(s, "daily"), read(s, d, "events").select("event_id", "ts")
    for k in (0, 1):
        files.append_daily(e.where(C("event_id") % 2 == k), path, "ts")
    return files.read_daily(s, path, e.schema).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("manifest_copy", "SELECT item_id, item_id % 5 <> 0 AS copied FROM benchmark")
def _(s, d):
    """The benchmark's items as files, copied by a manifest in which some paths lead nowhere."""
    path, target = files.folder(s, "items"), files.folder(s, "copies")
    files.write_by_document(read(s, d, "benchmark"), path, "item_id", "text")
    found = files.find_files(s, path, "*.json").select("path", F.regexp_extract("path", "item_id=([0-9]+)/", 1).cast("long").alias("id"))
    manifest = found.select("id", F.when(C("id") % 5 != 0, C("path")).otherwise(F.concat("path", F.lit(".gone"))).alias("path"))
    done = files.folder(s, "copied")
    files.copy_files(manifest, target).write.parquet(done)
    names = files.find_files(s, target).select(F.element_at(F.split("path", "/"), -1).alias("id"), F.lit(True).alias("there"))
    return s.read.parquet(done).join(names, "id", "left").select(C("id").cast("long").alias("item_id"), (C("copied") & F.coalesce("there", F.lit(False))).alias("copied"))


@query("matrix_roundtrip", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, len(embedding)::BIGINT AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def _(s, d):
    """The vectors as one matrix file, and their metadata beside it by row number."""
    rows = numbered(read(s, d, "embeddings"), [], ["vec_id"], "row").withColumn("row", C("row") - 1)
    path = files.folder(s, "matrix")
    files.write_matrix(rows, f"{path}/vectors.npy", "row", "embedding", 64)
    rows.select("row", "vec_id", "label").write.json(f"{path}/meta.jsonl")
    found = files.load_index(s, path, read(s, d, "embeddings").select("vec_id", "label").schema)
    return found.select("row", "vec_id", "label", F.size("v").cast("long").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
