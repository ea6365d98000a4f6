"""Queries that run as streams over all that is there; their batch twins are among the other plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.reindex import Index
from tidemark.plans.chunks import _WINDOWS
from tidemark.registry import query, read
from tidemark.sources.files import folder
from tidemark.streaming import follow, stateful, tail

C = F.col


#: Of a table that is copied for a stream, about so many bytes are one file, which one task writes.
FILE_BYTES = 16 << 20


def _stored(df) -> int:
    """The bytes of the files that a table is read from."""
    paths = [df.sparkSession._jvm.org.apache.hadoop.fs.Path(x) for x in df.inputFiles()]
    conf = df.sparkSession._jsc.hadoopConfiguration()
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def _copied(s, d, table, batches):
    """The table as several files, so that a stream has more than one batch; a batch has as many files as its share of the
    table's bytes has FILE_BYTES, however many splits and cores there are, so that no task has more of a larger table."""
    path, rows = folder(s, table), read(s, d, table)
    files = max(1, -(-_stored(rows) // (batches * FILE_BYTES)))
    rows.repartition(batches * files).write.parquet(path)
    return tail.source(s, path, rows.schema, files)


def _log(s, d, batches=3, files=4):
    """The events as log files, some for each range of times, one range after the other: a range is a batch, its files are tasks."""
    path, rows = folder(s, "events"), read(s, d, "events")
    edges = rows.agg(F.percentile_approx("ts", [k / batches for k in range(1, batches)])).first()[0]
    for low, high in zip([None, *edges], [*edges, None]):
        part = rows if low is None else rows.where(C("ts") > F.lit(low))
        (part if high is None else part.where(C("ts") <= F.lit(high))).repartition(files).write.mode("append").parquet(path)
    return tail.source(s, path, rows.schema, files).withColumn("at", C("ts").cast("timestamp"))


@query("stream_tail", "SELECT event_id, event_type, value FROM events WHERE value >= 100")
def _(s, d):
    """A log of JSON lines, written by three tasks and followed by bytes."""
    path, rows = folder(s, "log"), read(s, d, "events").select("event_id", "event_type", "value")
    follow.write_part(rows.repartition(3), path, "events")
    return tail.drain(tail.slow_turns(follow.events(s, path, rows.schema), 100), "tail")


@query("stream_tail_since", "SELECT event_id, event_type, value FROM events WHERE value >= 100 AND ts >= TIMESTAMP '2024-01-15 00:00:00'")
def _(s, d):
    path, rows = folder(s, "log"), read(s, d, "events").select("event_id", "event_type", "value", C("ts").cast("string").alias("ts"))
    follow.write_part(rows.repartition(3), path, "events")
    return tail.drain(tail.slow_turns(follow.events(s, path, rows.schema, since="2024-01-15 00:00:00"), 100), "since")


@query("stream_rolling_p95", """SELECT event_type, nth AS seen, round(p95, 6) AS p95 FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nth,
  quantile_cont(value, 0.95) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS p95 FROM events) WHERE nth % 10 = 0""")
def _(s, d):
    found = tail.drain(stateful.rolling(_log(s, d), "event_type"), "rolling")
    return found.select(C("key").alias("event_type"), "seen", F.round("p", 6).alias("p95"))


@query("stream_budget_alert", """SELECT start, event_type, round(p95, 6) AS p95, n FROM (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, event_type, quantile_cont(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1, 2)
WHERE p95 > 150 AND start + INTERVAL 5 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""")
def _(s, d):
    """Five minutes over the budget, once the watermark has passed them."""
    found = tail.drain(tail.budget_alerts(_log(s, d).drop("at"), 150), "alerts")
    return found.select(C("start").cast("timestamp_ntz").alias("start"), "event_type", F.round("p95", 6).alias("p95"), "n")


@query("stream_debounced_changes", """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS path, event_id, ts, CASE WHEN event_id % 11 <> 0 THEN (event_id % 3)::VARCHAR END AS hash, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
c AS (SELECT path, 0::BIGINT AS nth, NULL::BIGINT AS event_id, NULL::VARCHAR AS change, NULL::VARCHAR AS known, NULL::TIMESTAMP AS last FROM (SELECT DISTINCT path FROM e) UNION ALL
  SELECT path, nth, event_id, change, CASE WHEN change = 'deleted' THEN NULL WHEN change IS NULL THEN known ELSE hash END, CASE WHEN change IN ('created', 'modified') THEN ts ELSE last END
  FROM (SELECT e.path, e.nth, e.event_id, e.ts, e.hash, c.known, c.last, CASE WHEN e.hash IS NULL THEN CASE WHEN c.known IS NOT NULL THEN 'deleted' END
    WHEN (c.last IS NULL OR e.ts - c.last >= INTERVAL 6 HOURS) AND e.hash IS DISTINCT FROM c.known THEN CASE WHEN c.known IS NULL THEN 'created' ELSE 'modified' END END AS change
    FROM c JOIN e ON e.path = c.path AND e.nth = c.nth + 1))
SELECT path, event_id, change FROM c WHERE change IS NOT NULL""")
def _(s, d):
    """The log as writes and deletions of each user's file."""
    k = C("event_id")
    files = _log(s, d).select(C("user_id").cast("string").alias("path"), "event_id", "at", F.when(k % 11 != 0, (k % 3).cast("string")).alias("hash"))
    return tail.drain(stateful.first_of_burst(files, 3600.0 * 6), "debounced")


_BURSTS = """e AS (SELECT {path} AS path, event_id, ts, {hash} AS hash FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) <= INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM e)),
g AS (SELECT path, burst, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ended, arg_max(struct_pack(h := hash), (ts, event_id)).h AS hash, count(*) AS n FROM b GROUP BY 1, 2),
c AS (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY burst) AS known FROM g)
SELECT path, event_id, CASE WHEN hash IS NULL THEN 'deleted' WHEN known IS NULL THEN 'created' ELSE 'modified' END AS change, n FROM c WHERE hash IS DISTINCT FROM known AND ended + INTERVAL {gap} < (SELECT max(ts) FROM events)"""


@query("stream_quiet_changes", "WITH " + _BURSTS.format(path="user_id::VARCHAR", hash="CASE WHEN event_id % 11 <> 0 THEN (event_id % 3)::VARCHAR END", gap="6 HOURS"))
def _(s, d):
    """The same log, of which a change is told once its file has been quiet for six hours: timers of each path by the watermark."""
    k = C("event_id")
    files = _log(s, d).select(C("user_id").cast("string").alias("path"), "event_id", "at", F.when(k % 11 != 0, (k % 3).cast("string")).alias("hash"))
    return tail.drain(stateful.last_of_burst(files, 3600.0 * 6), "quiet").drop("at")


@query("stream_reindex", "SELECT count(*)::BIGINT AS chunks, count(DISTINCT doc_id)::BIGINT AS docs FROM (SELECT doc_id, unnest(range(0, CASE WHEN n <= 500 THEN 1 ELSE (ceil((n - 500) / 450.0) * 450)::BIGINT + 1 END, 450)) AS start FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS n FROM documents) WHERE n > 0)")
def _(s, d):
    """Documents as they come, into chunks with vectors: a segment for each batch."""
    index = Index(s, folder(s, "live"))
    docs = _copied(s, d, "documents", 2).select("doc_id", "text", F.sha2("text", 256).alias("hash"))
    tail.index_as_it_comes(docs, index, "reindex")
    return index.chunks().agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("docs"))


@query("snapshot_changes", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'created' WHEN page_id % 5 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM pages WHERE page_id % 7 = 0 AND page_id % 5 <> 0 OR page_id % 5 = 0 AND page_id % 7 <> 0 OR page_id % 3 = 0 AND page_id % 5 <> 0 AND page_id % 7 <> 0")
def _(s, d):
    """Two listings of the pages: some are in one only, some have other content."""
    pages, k = read(s, d, "pages"), C("page_id")
    before = pages.where(k % 7 != 0).select(k.alias("path"), F.sha2("html", 256).alias("hash"))
    after = pages.where(k % 5 != 0).select(k.alias("path"), F.sha2(F.when(k % 3 == 0, F.concat("html", F.lit("."))).otherwise(C("html")), 256).alias("hash"))
    return tail.snapshot_changes(before, after).select(C("path").alias("page_id"), "change")


@query("stream_changed_files", "SELECT page_id, sha256(html) AS hash FROM pages")
def _(s, d):
    rows = _copied(s, d, "pages", 2).select("page_id", C("url").alias("path"), F.sha2("html", 256).alias("hash"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    return tail.drain(tail.changed(rows), "changed").select("page_id", "hash")


@query("stream_incremental_index", f"WITH {_WINDOWS} SELECT doc_id, start, least(start + 500, len(w)) AS stop, sha256(array_to_string(w[start + 1 : start + 500], ' ')) AS hash FROM s")
def _(s, d):
    return tail.drain(tail.new_chunks(_copied(s, d, "documents", 3)), "chunks")
