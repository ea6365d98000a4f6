"""Queries of chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.chunk import fixed_windows, greedy_chunks
from tidemark.operators import documents as D
from tidemark.registry import query, read

C = F.col


def _documents(s, d):
    return read(s, d, "documents")


_W = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"
_WINDOWS = f"""w AS (SELECT doc_id, {_W} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 500 THEN 1 ELSE (ceil((len(w) - 500) / 450.0) * 450)::BIGINT + 1 END, 450)) AS start FROM w)"""


@query("chunk_fixed_window", f"WITH {_WINDOWS} SELECT doc_id, start, least(start + 500, len(w)) AS stop, sha256(array_to_string(w[start + 1 : start + 500], ' ')) AS hash FROM s")
def _(s, d):
    c = _documents(s, d).select("doc_id", F.explode(fixed_windows(C("text"))).alias("c"))
    return c.select("doc_id", "c.start", "c.stop", F.sha2("c.text", 256).alias("hash"))


@query("chunk_ids", f"WITH {_WINDOWS} SELECT doc_id || '::s0::c' || (start // 450) AS chunk_id, sha256(array_to_string(w[start + 1 : start + 500], ' '))[1:16] AS hash FROM s")
def _(s, d):
    c = _documents(s, d).select("doc_id", F.posexplode(fixed_windows(C("text"))).alias("i", "c"))
    return c.select(F.concat(C("doc_id").cast("string"), F.lit("::s0::c"), C("i").cast("string")).alias("chunk_id"), F.left(F.sha2("c.text", 256), F.lit(16)).alias("hash"))


@query("dedupe_by_hash", f"WITH {_WINDOWS}, h AS (SELECT doc_id, start, sha256(array_to_string(w[start + 1 : start + 500], ' ')) AS hash FROM s) SELECT hash, min(doc_id) AS first_doc, count(*) AS copies FROM h GROUP BY 1")
def _(s, d):
    c = _documents(s, d).select("doc_id", F.explode(fixed_windows(C("text"))).alias("c"))
    return c.groupBy(F.sha2("c.text", 256).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


@query("chunk_token_totals", f"WITH {_WINDOWS} SELECT doc_id, count(*) AS chunks, sum(least(start + 500, len(w)) - start)::BIGINT AS tokens FROM s GROUP BY 1")
def _(s, d):
    c = _documents(s, d).select("doc_id", F.explode(fixed_windows(C("text"))).alias("c"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(C("c.stop") - C("c.start")).alias("tokens"))


@query("token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def _(s, d):
    return _documents(s, d).select("doc_id", X.token_estimate(C("text")).alias("tokens"))


#: RE2 has no look-behind: the sentence ends are marked first.
_S = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query("sentence_split", f"SELECT doc_id, len({_S})::BIGINT AS n, sha256(array_to_string({_S}, '|')) AS joined FROM documents")
def _(s, d):
    parts = X.sentences(C("text"))
    return _documents(s, d).select("doc_id", F.size(parts).cast("long").alias("n"), F.sha2(F.array_join(parts, "|"), 256).alias("joined"))


def _greedy(most: int, overlap: int) -> str:
    """SQL: a document's chunks as lists of sentences. The kept tail is the sentences from which on all together are within the overlap."""
    tail = f"list_filter(a.open, lambda s, i: list_sum(list_transform(a.open[i:], lambda q: length(q) // 4)) <= {overlap})"
    packed = f"""list_reduce(list_prepend({{'done': []::VARCHAR[][], 'open': []::VARCHAR[], 'n': 0::BIGINT}}, list_transform({_S}, lambda s: {{'done': []::VARCHAR[][], 'open': [s], 'n': (length(s) // 4)::BIGINT}})),
      lambda a, x: CASE WHEN len(a.open) > 0 AND a.n + x.n > {most} THEN {{'done': list_append(a.done, a.open), 'open': list_concat({tail}, x.open), 'n': coalesce(list_sum(list_transform({tail}, lambda q: length(q) // 4)), 0)::BIGINT + x.n}}
      ELSE {{'done': a.done, 'open': list_concat(a.open, x.open), 'n': a.n + x.n}} END)"""
    return f"(SELECT doc_id, CASE WHEN len(r.open) > 0 THEN list_append(r.done, r.open) ELSE r.done END AS chunks FROM (SELECT doc_id, {packed} AS r FROM documents))"


@query("chunk_greedy", f"SELECT doc_id, i - 1 AS chunk, len(c)::BIGINT AS sentences, array_to_string(c, ' ') AS text FROM (SELECT doc_id, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS i FROM {_greedy(240, 48)})")
def _(s, d):
    c = _documents(s, d).select("doc_id", F.posexplode(greedy_chunks(C("text"), 240, 48)).alias("i", "c"))
    return c.select("doc_id", C("i").cast("long").alias("chunk"), F.size("c").cast("long").alias("sentences"), F.array_join("c", " ").alias("text"))


@query("chunk_greedy_counts", f"SELECT doc_id, len(chunks)::BIGINT AS chunks FROM {_greedy(240, 48)}")
def _(s, d):
    n = F.size(greedy_chunks(C("text"), 240, 48)).cast("long")
    return _documents(s, d).select("doc_id", n.alias("chunks"))


@query("profile_compare", f"SELECT a.doc_id, len(a.chunks)::BIGINT AS speed, len(b.chunks)::BIGINT AS accuracy FROM {_greedy(600, 20)} a JOIN {_greedy(240, 48)} b ON a.doc_id = b.doc_id")
def _(s, d):
    """Chunks of each document under both profiles."""
    return _documents(s, d).select("doc_id", F.size(greedy_chunks(C("text"), 600, 20)).cast("long").alias("speed"), F.size(greedy_chunks(C("text"), 240, 48)).cast("long").alias("accuracy"))


@query("doc_sections", "SELECT doc_id, (i - 1)::BIGINT AS section, 'line ' || (i - 1) AS name, length(line) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> ''")
def _(s, d):
    x = _documents(s, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).where(F.trim("line") != "")
    return x.select("doc_id", C("i").cast("long").alias("section"), F.concat(F.lit("line "), C("i").cast("string")).alias("name"), F.length("line").cast("long").alias("chars"))


_FIELD_ROWS = """(SELECT doc_id, 0 AS ord, 'title' AS type, 'Title: ' || split_part(text, ' ', 1) AS value, FALSE AS cut FROM documents WHERE split_part(text, ' ', 1) <> '' UNION ALL
  SELECT doc_id, 1, 'content', text, TRUE FROM documents UNION ALL SELECT doc_id, 2, 'stones', 'Principles: ' || lang || '; ' || source, FALSE FROM documents UNION ALL
  SELECT doc_id, 3, 'purpose', split_part(text, chr(10), 1), TRUE FROM documents UNION ALL
  SELECT doc_id, 3 + i, 'theme', 'Theme: ' || split_part(line, ' ', 1) || ' - ' || line || CASE WHEN length(line) % 2 = 0 THEN ' - because' ELSE '' END, TRUE FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE split_part(line, ' ', 1) <> '')"""
_FIELD_W = _W.replace("(text,", "(value,")


@query("extract_fields_chunks", f"""WITH f AS (SELECT doc_id, ord, type, value, cut, {_FIELD_W} AS w FROM {_FIELD_ROWS} WHERE value <> ''),
 s AS (SELECT *, unnest(CASE WHEN NOT cut THEN [0] ELSE range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 500 THEN 1 ELSE (ceil((len(w) - 500) / 450.0) * 450)::BIGINT + 1 END, 450) END) AS start FROM f),
 c AS (SELECT *, CASE WHEN cut THEN least(start + 500, len(w)) WHEN type = 'title' THEN len(w) - 1 ELSE len(w) END AS stop, count(*) FILTER (ord < 2) OVER (PARTITION BY doc_id) AS before FROM s)
SELECT doc_id, ord::BIGINT AS place, type, CASE WHEN type = 'stones' THEN before ELSE start // 450 END AS chunk, start, stop, sha256(CASE WHEN cut THEN array_to_string(w[start + 1 : start + 500], ' ') ELSE value END) AS hash FROM c""")
def _(s, d):
    """Each document as one with a title, content, principles, a purpose and its lines as themes; each longer field is cut by
    word windows, whose numbers begin anew."""
    head = lambda x: F.split_part(x, F.lit(" "), F.lit(1))
    themes = F.transform(F.split("text", "\n", -1), lambda x: F.struct(head(x).alias("name"), x.alias("purpose"), F.when(F.length(x) % 2 == 0, "because").alias("why")))
    docs = _documents(s, d).select("doc_id", head(C("text")).alias("title"), C("text").alias("content"), F.array("lang", "source").alias("stones"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("purpose"), themes.alias("themes"))
    found = D.field_chunks(docs, "doc_id", fields=("purpose",))
    return found.select("doc_id", "place", "type", "chunk", "start", "stop", F.sha2("text", 256).alias("hash"))