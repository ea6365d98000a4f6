"""Queries of document selection. A language is a stage and a source is a tag."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import curation as U
from tidemark.operators import reindex as R
from tidemark.registry import query, read
from tidemark.sources.files import folder

C = F.col


def n():
    return F.count(F.lit(1))


def _scored(s, d):
    tokens = X.token_estimate(C("text"))
    tags = 1 + (C("n_chars") % 3)
    return read(s, d, "documents").select(C("doc_id").alias("id"), C("lang").alias("stage"), C("source").alias("tag"), tokens.alias("tokens"), U.static_score(tags, X.length_bucket(tokens)).cast("long").alias("score"))


_SCORED = f"scored AS (SELECT doc_id AS id, lang AS stage, source AS tag, length(text) // 4 AS tokens, least(1 + n_chars % 3, {U.TAGS_AT_MOST}) * {U.TAG_POINTS} + CASE WHEN length(text) // 4 > 2000 THEN {U.LONG_POINTS} WHEN length(text) // 4 > 800 THEN {U.MEDIUM_POINTS} ELSE {U.SHORT_POINTS} END AS score FROM documents)"


@query("selection_static_score", f"WITH {_SCORED} SELECT id, score FROM scored")
def _(s, d):
    return _scored(s, d).select("id", "score")


#: Ten tags and eight fields, of which each document has some; the last tag is rare.
TAGS, FIELDS = tuple(f"tag{k}" for k in range(10)), tuple(f"field{k}" for k in range(8))
QUOTAS = U.Quotas(24, {"en": 8, "de": 6, "fr": 6, "es": 6}, {"short": 6, "medium": 8, "long": 10}, TAGS, FIELDS, includes=(3, 11))


def _described(s, d):
    k, tokens = C("doc_id"), X.token_estimate(C("text"))
    tags = F.filter(F.array(*(F.when((k * (j + 3) + j) % (11 if j < 9 else 97) == 0, t) for j, t in enumerate(TAGS))), lambda x: x.isNotNull())
    fields = F.filter(F.array(*(F.when((k + j * j) % 5 == 0, f) for j, f in enumerate(FIELDS))), lambda x: x.isNotNull())
    return read(s, d, "documents").select(k.alias("id"), F.concat_ws("_", "source", "lang").alias("slug"), C("lang").alias("stage"), X.length_bucket(tokens).alias("bucket"), tokens.alias("tokens"), tags.alias("tags"), fields.alias("fields"))


@query("select_balanced")
def _(s, d):
    """Two documents that must be in, picks by score under the quotas, and swaps for tags that lack."""
    return U.select_balanced(_described(s, d), QUOTAS)


@query("select_lowest")
def _(s, d):
    """The same preferring the least score."""
    return U.select_balanced(_described(s, d), replace(QUOTAS, lowest_first=True))


@query("swap_candidates", f"WITH {_SCORED} SELECT stage, id, score / (1 + tokens) AS density FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY score / (1 + tokens) DESC, tokens, id) AS nth FROM scored) WHERE nth <= 3")
def _(s, d):
    """The three densest of each stage."""
    density = C("score") / (1 + C("tokens"))
    nth = F.row_number().over(W.partitionBy("stage").orderBy(F.desc(density), "tokens", "id"))
    return _scored(s, d).withColumn("nth", nth).where("nth <= 3").select("stage", "id", density.alias("density"))


@query("removal_candidate", f"WITH {_SCORED}, c AS (SELECT *, count(*) OVER (PARTITION BY stage, tag) AS others FROM scored) SELECT stage, id FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY others DESC, tokens DESC, id) AS nth FROM c) WHERE nth = 1")
def _(s, d):
    """Of each stage the document whose tag the most others have."""
    rows = _scored(s, d)
    x = rows.join(rows.groupBy("stage", "tag").agg(n().alias("others")), ["stage", "tag"])
    return x.withColumn("nth", F.row_number().over(W.partitionBy("stage").orderBy(F.desc("others"), F.desc("tokens"), "id"))).where("nth = 1").select("stage", "id")


_CUT = "(SELECT doc_id, doc_id % 4 <> 1 AS had, doc_id % 5 <> 0 AS has, doc_id % 3 = 0 AS changed, {w} AS w FROM documents)"
_N = "CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 500 THEN 1 ELSE 1 + ceil((len(w) - 500) / 450.0)::BIGINT END"
_T = f"CASE WHEN len(w) = 0 THEN 0 ELSE len(w) + 50 * ({_N} - 1) END"


@query("reindex_once", f"""SELECT count(*) FILTER (had AND has AND changed) AS files_changed, count(*) FILTER (has AND NOT had) AS files_added, count(*) FILTER (had AND NOT has) AS files_removed,
  sum({_N}) FILTER (had)::BIGINT AS chunks_before, sum({_N}) FILTER (has)::BIGINT AS chunks_after, sum({_T}) FILTER (had)::BIGINT AS tokens_before, sum({_T}) FILTER (has)::BIGINT AS tokens_after FROM {_CUT.format(w="list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')")}""")
def _(s, d):
    """An index of most documents is brought up to date with others: some are new, some are gone, some have another text by name."""
    docs, k = read(s, d, "documents"), C("doc_id")
    index = R.Index(s, folder(s, "index"))
    index.update(docs.where(k % 4 != 1).select(k.alias("doc_id"), "text", F.sha2("text", 256).alias("hash")))
    new = docs.where(k % 5 != 0).select("doc_id", "text", F.sha2(F.when(k % 3 == 0, F.concat("text", F.lit("#"))).otherwise(C("text")), 256).alias("hash"))
    return index.update(new)