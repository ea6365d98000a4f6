"""Queries of counts, distributions and summaries over documents and sessions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.registry import query, read

C = F.col


def n():
    return F.count(F.lit(1))


@query("index_stats", "SELECT count(*) AS total, count(DISTINCT label) AS labels, min(len(embedding))::BIGINT AS dim FROM embeddings")
def _(s, d):
    return read(s, d, "embeddings").agg(n().alias("total"), F.countDistinct("label").alias("labels"), F.min(F.size("embedding")).cast("long").alias("dim"))


@query("processing_summary", "SELECT lang, count(*) AS docs, count(*) FILTER (n_chars >= 100) AS valid, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def _(s, d):
    return read(s, d, "documents").groupBy("lang").agg(n().alias("docs"), F.count_if(C("n_chars") >= 100).alias("valid"), F.sum("n_chars").alias("chars"))


@query("distribution_by_label", "SELECT 'role' AS field, role AS value, count(*) AS n FROM conversations GROUP BY ALL UNION ALL SELECT 'tone', coalesce({}, 'unspecified'), count(*) FROM conversations GROUP BY ALL".format(X.sql_case("text", X.ENTRY_TONE)))
def _(s, d):
    c = read(s, d, "conversations")
    parts = F.array(F.struct(F.lit("role").alias("field"), C("role").alias("value")), F.struct(F.lit("tone").alias("field"), F.coalesce(X.first_rule(C("text"), X.ENTRY_TONE), F.lit("unspecified")).alias("value")))
    return c.select(F.explode(parts).alias("p")).groupBy("p.field", "p.value").agg(n().alias("n"))


@query("enum_distribution_zerofill", "SELECT role, count(c.role) AS n FROM (SELECT unnest(['system', 'user', 'assistant', 'tool']) AS role) e LEFT JOIN conversations c USING (role) GROUP BY 1")
def _(s, d):
    """Every value of the enum, also those that no row has."""
    found = read(s, d, "conversations").groupBy("role").agg(n().alias("n"))
    every = s.range(1).select(F.explode(F.array(*map(F.lit, ("system", "user", "assistant", "tool")))).alias("role"))
    return every.join(found, "role", "left").select("role", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("priority_max_action", "SELECT l_orderkey, CASE max(CASE l_shipmode WHEN 3 THEN 3 WHEN 2 THEN 2 WHEN 1 THEN 2 ELSE 1 END) WHEN 3 THEN 'later' WHEN 2 THEN 'hold' ELSE 'continue' END AS action FROM (SELECT l_orderkey, l_suppkey % 4 AS l_shipmode FROM lineitem) GROUP BY 1")
def _(s, d):
    """LATER outranks HOLD and SOFT_HOLD, which outrank NOW."""
    pace = C("l_suppkey") % 4
    rank = F.max(F.when(pace == 3, 3).when(pace.isin(1, 2), 2).otherwise(1))
    return read(s, d, "lineitem").groupBy("l_orderkey").agg(F.when(rank == 3, "later").when(rank == 2, "hold").otherwise("continue").alias("action"))


@query("dominant_label", "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS nth FROM (SELECT user_id, event_type, count(*) AS n, min((ts, event_id)) AS first FROM events GROUP BY ALL)) WHERE nth = 1")
def _(s, d):
    """The most frequent value; of equally frequent ones that seen first."""
    counts = read(s, d, "events").groupBy("user_id", "event_type").agg(n().alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    nth = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("nth", nth).where("nth = 1").select("user_id", "event_type")


@query("memory_summary", "SELECT user_id, count(*) AS total, count(*) FILTER (value > 100) AS pinned, count(*) FILTER (ts >= now - INTERVAL 24 HOUR) AS recent FROM events, (SELECT max(ts) AS now FROM events) GROUP BY 1")
def _(s, d):
    e = read(s, d, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).groupBy("user_id").agg(n().alias("total"), F.count_if(C("value") > 100).alias("pinned"), F.count_if(C("ts") >= C("now") - F.expr("INTERVAL 24 HOURS")).alias("recent"))


@query("compliance_rate", "SELECT source, coalesce(round(count(*) FILTER (toxic = 0)::DOUBLE / nullif(count(*), 0), 6), 0) AS rate FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def _(s, d):
    return read(s, d, "documents").join(read(s, d, "labels"), "doc_id").groupBy("source").agg(F.round(F.coalesce(F.count_if(C("toxic") == 0) / F.nullif(n(), F.lit(0)), F.lit(0.0)), 6).alias("rate"))


@query("success_rate", "SELECT o_orderpriority, count(*) AS writes, round(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM orders GROUP BY 1")
def _(s, d):
    return read(s, d, "orders").groupBy("o_orderpriority").agg(n().alias("writes"), F.round(F.avg((C("o_orderstatus") == "F").cast("int")), 6).alias("rate"))


@query("distinct_contexts", "SELECT o_custkey, count(*) AS n, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS contexts FROM orders GROUP BY 1")
def _(s, d):
    return read(s, d, "orders").groupBy("o_custkey").agg(n().alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("contexts"))


@query("tag_coverage", "SELECT tag, count(d.doc_id) AS docs FROM (SELECT 'src' || unnest(range(0, 25)) AS tag) t LEFT JOIN documents d ON d.source = tag GROUP BY 1")
def _(s, d):
    """Known tags only, with those that no document has."""
    tags = s.range(25).select(F.concat(F.lit("src"), C("id").cast("string")).alias("tag"))
    found = read(s, d, "documents").groupBy(C("source").alias("tag")).agg(n().alias("docs"))
    return tags.join(found, "tag", "left").select("tag", F.coalesce("docs", F.lit(0).cast("long")).alias("docs"))


@query("mix_by_bucket", "WITH b AS (SELECT lang, CASE WHEN length(text) // 4 <= 800 THEN 'short' WHEN length(text) // 4 <= 2000 THEN 'medium' ELSE 'long' END AS bucket FROM documents) SELECT bucket, lang, count(*) AS n FROM b GROUP BY ALL")
def _(s, d):
    return read(s, d, "documents").groupBy(X.length_bucket(X.token_estimate(C("text"))).alias("bucket"), "lang").agg(n().alias("n"))


_WORDS = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))"


@query("corpus_stats", f"SELECT count(*) AS docs, sum(w)::BIGINT AS words, round(sum(w) * 0.75::DOUBLE, 4) AS tokens, round(avg(w), 4) AS mean_words, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM (SELECT lang, {_WORDS} AS w FROM documents)")
def _(s, d):
    w = read(s, d, "documents").select("lang", F.size(X.words(C("text"))).cast("long").alias("w"))
    return w.agg(n().alias("docs"), F.sum("w").alias("words"), F.round(F.sum("w") * 0.75, 4).alias("tokens"), F.round(F.avg("w"), 4).alias("mean_words"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
