"""Queries of vector search, fusion and re-ranking. Queries are the vectors whose id is divisible by 20."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import search as S
from tidemark.registry import query, read

C = F.col
K = 10


def _vectors(s, d):
    return read(s, d, "embeddings").select(C("vec_id").alias("id"), C("embedding").alias("v"), "label")


def _queries(s, d):
    return _vectors(s, d).where("id % 20 = 0")


def _sql(metric: str, on: str = "TRUE", k: int = K) -> str:
    score = {"cosine": "list_cosine_similarity(q.v, x.v)", "dot": "list_dot_product(q.v, x.v)", "l2": "-list_distance(q.v, x.v)"}[metric]
    return f"""(SELECT query_id, row_id, score, rank FROM (SELECT q.id AS query_id, x.id AS row_id, round({score}, 6) + 0.0 AS score,
      row_number() OVER (PARTITION BY q.id ORDER BY round({score}, 6) DESC, x.id) AS rank
      FROM (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings) x WHERE {on}) WHERE rank <= {k})"""


for _metric in ("cosine", "dot", "l2"):
    query(f"knn_{_metric}", f"SELECT * FROM {_sql(_metric)}")(lambda s, d, m=_metric: S.top_k(_queries(s, d), _vectors(s, d), K, m))


@query("knn_prefilter", f"SELECT * FROM {_sql('cosine', 'q.label = x.label')}")
def _(s, d):
    """Only rows with the query's label count, before the k best are taken."""
    return S.top_k(_queries(s, d), _vectors(s, d), K, "cosine", "label")


@query("knn_postfilter", f"SELECT r.* FROM {_sql('cosine')} r JOIN embeddings q ON q.vec_id = query_id JOIN embeddings x ON x.vec_id = row_id WHERE q.label = x.label")
def _(s, d):
    """The k best of all rows, of which those with another label go: fewer than k may be left."""
    found = S.top_k(_queries(s, d), _vectors(s, d), K)
    label = read(s, d, "embeddings")
    return (
        found.join(label.select(C("vec_id").alias("query_id"), C("label").alias("ql")), "query_id")
        .join(label.select(C("vec_id").alias("row_id"), C("label").alias("xl")), "row_id")
        .where("ql = xl")
        .select("query_id", "row_id", "score", "rank")
    )


@query("join_vector_meta", f"SELECT r.query_id, r.row_id, x.label, r.rank FROM {_sql('cosine')} r JOIN embeddings x ON x.vec_id = r.row_id")
def _(s, d):
    found = S.top_k(_queries(s, d), _vectors(s, d), K)
    return found.join(read(s, d, "embeddings").select(C("vec_id").alias("row_id"), "label"), "row_id").select("query_id", "row_id", "label", "rank")


_SEARCHED = f"SELECT query_id, count(*) AS results, string_agg(row_id::VARCHAR, ',' ORDER BY rank) AS ids FROM {_sql('cosine', 'q.label = x.label', 40)} GROUP BY 1"


@query("search_with_warnings", f"""WITH f AS ({_SEARCHED}), q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0), m AS (SELECT unnest(['fast', 'accuracy', 'accuracy_missing', 'disabled']) AS asked)
SELECT q.query_id, asked, CASE asked WHEN 'disabled' THEN 'disabled' WHEN 'fast' THEN 'fast' ELSE 'accuracy' END AS mode, CASE WHEN asked = 'disabled' THEN '' ELSE ids END AS ids,
  CASE WHEN asked = 'disabled' THEN '' ELSE array_to_string(list_filter([CASE WHEN results < 40 THEN 'Only ' || results || ' results found (requested 40)' END, CASE WHEN asked = 'accuracy_missing' THEN 'Accuracy index not available, using latency index' END], lambda x: x IS NOT NULL), '; ') END AS warnings,
  CASE WHEN asked = 'disabled' THEN 'flags.disabled' END AS reason FROM q, m LEFT JOIN f ON f.query_id = q.query_id""")
def _(s, d):
    """The same search by mode, with an index that lacks, and switched off."""
    rows, asked = _vectors(s, d), _queries(s, d)
    both = {"latency": rows, "accuracy": rows}
    answers = {"fast": S.search(asked, both, 40, "fast", same="label"), "accuracy": S.search(asked, both, 40, "accuracy", same="label"), "accuracy_missing": S.search(asked, {"latency": rows}, 40, "accuracy", same="label"), "disabled": S.search(asked, both, 40, enabled=False)}
    shown = lambda df, name: df.select("query_id", F.lit(name).alias("asked"), "mode", F.array_join(F.transform("results", lambda r: r["row_id"].cast("string")), ",").alias("ids"), F.array_join("warnings", "; ").alias("warnings"), "reason")
    return reduce(lambda a, b: a.unionByName(b), (shown(df, name) for name, df in answers.items()))


@query("rank_final", f"SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, x.label, row_id) AS final_rank FROM {_sql('cosine')} JOIN embeddings x ON x.vec_id = row_id")
def _(s, d):
    found = S.top_k(_queries(s, d), _vectors(s, d), K).join(read(s, d, "embeddings").select(C("vec_id").alias("row_id"), "label"), "row_id")
    return found.select("query_id", "row_id", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "label", "row_id")).cast("long").alias("final_rank"))


def _lanes(s, d, k=2 * K):
    return S.top_k(_queries(s, d), _vectors(s, d), k, "cosine"), S.top_k(_queries(s, d), _vectors(s, d), k, "l2")


_BOTH = f"(SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.row_id, b.row_id) AS row_id, a.score AS score_a, b.score AS score_b, a.rank AS rank_a, b.rank AS rank_b FROM {_sql('cosine', k=2 * K)} a FULL JOIN {_sql('l2', k=2 * K)} b ON a.query_id = b.query_id AND a.row_id = b.row_id)"


def _fused(expr: str, places: int = 6) -> str:
    return f"SELECT * FROM (SELECT query_id, row_id, fused, rank_a, rank_b, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, row_id) AS rank FROM (SELECT *, round({expr}, {places}) AS fused FROM {_BOTH})) WHERE rank <= {K}"


@query("fuse_rrf", _fused("coalesce(1.0::DOUBLE / (60 + rank_a), 0) + coalesce(1.0::DOUBLE / (60 + rank_b), 0)"))
def _(s, d):
    return S.reciprocal_rank_fusion(*_lanes(s, d), K)


@query("fuse_weighted", _fused("0.7::DOUBLE * coalesce(score_a, 0) + 0.3::DOUBLE * coalesce(score_b, 0)", 7))
def _(s, d):
    return S.weighted_fusion(*_lanes(s, d), K, 0.7, 0.3)


@query("hybrid_search", f"SELECT query_id, count(*) AS hits, count(rank_a) AS from_first, count(rank_b) AS from_second FROM ({_fused('coalesce(1.0::DOUBLE / (60 + rank_a), 0) + coalesce(1.0::DOUBLE / (60 + rank_b), 0)')}) GROUP BY 1")
def _(s, d):
    fused = S.reciprocal_rank_fusion(*_lanes(s, d), K)
    return fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.count("rank_a").alias("from_first"), F.count("rank_b").alias("from_second"))


@query("mmr_rerank", f"""WITH RECURSIVE c AS MATERIALIZED (SELECT query_id, list({{'id': row_id, 's': score, 'v': embedding::DOUBLE[]}} ORDER BY row_id) AS found FROM {_sql('cosine', k=4 * K)} JOIN embeddings ON vec_id = row_id GROUP BY 1),
m AS (SELECT query_id, 0::BIGINT AS pick, []::STRUCT(worth DOUBLE, id BIGINT, v DOUBLE[])[] AS picked FROM c UNION ALL
  SELECT m.query_id, pick + 1, list_append(picked, list_sort(list_transform(list_filter(found, lambda x: NOT list_contains(list_transform(picked, lambda p: p.id), x.id)),
    lambda x: {{'worth': -round(0.7::DOUBLE * x.s - 0.3::DOUBLE * coalesce(list_max(list_transform(picked, lambda p: list_cosine_similarity(p.v, x.v))), 0), 9), 'id': x.id, 'v': x.v}}))[1])
  FROM m JOIN c ON c.query_id = m.query_id WHERE pick < least({K}, len(found)))
SELECT query_id, picked[pick].id AS row_id, pick FROM m WHERE pick > 0""")
def _(s, d):
    """Four times as many candidates as are picked."""
    found = S.top_k(_queries(s, d), _vectors(s, d), 4 * K).join(_vectors(s, d).select(C("id").alias("row_id"), "v"), "row_id")
    return S.mmr(found, K)


@query("rerank_lexical", """
WITH w AS (SELECT item_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS w FROM benchmark)
SELECT * FROM (SELECT a.item_id AS query_id, b.item_id AS row_id, round(len(list_intersect(a.w, b.w))::DOUBLE / len(a.w), 6) AS score,
  row_number() OVER (PARTITION BY a.item_id ORDER BY round(len(list_intersect(a.w, b.w))::DOUBLE / len(a.w), 6) DESC, b.item_id) AS rank FROM w a JOIN w b ON a.item_id <> b.item_id AND a.item_id % 20 = 0) WHERE rank <= 10""")
def _(s, d):
    """Each twentieth benchmark item against all, by the share of its words."""
    b = read(s, d, "benchmark").select("item_id", F.filter(F.array_distinct(F.split(F.lower("text"), " ")), lambda x: x != "").alias("w"))
    rows = b.withColumnRenamed("item_id", "id")
    return S.top_overlap(rows.where("id % 20 = 0"), rows, 10)


def _by_length():
    """A scorer of pairs: texts as long as the query first."""
    return lambda pairs: [1 / (1 + abs(len(q) - len(t))) for q, t in pairs]


@query("rerank_pairs", """
WITH w AS (SELECT item_id, text, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS w FROM benchmark),
c AS (SELECT * FROM (SELECT a.item_id AS query_id, b.item_id AS row_id, a.text AS query, b.text, row_number() OVER (PARTITION BY a.item_id ORDER BY round(len(list_intersect(a.w, b.w))::DOUBLE / len(a.w), 6) DESC, b.item_id) AS old FROM w a JOIN w b ON a.item_id <> b.item_id AND a.item_id % 20 = 0) WHERE old <= 40)
SELECT query_id, row_id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old, row_id) AS rank FROM (SELECT *, 1::DOUBLE / (1 + abs(length(query) - length(text))) AS score FROM c)) WHERE rank <= 10""")
def _(s, d):
    """The forty best of the lexical search, by a scorer of pairs in batches."""
    b = read(s, d, "benchmark").select(C("item_id").alias("id"), "text", F.filter(F.array_distinct(F.split(F.lower("text"), " ")), lambda x: x != "").alias("w"))
    found = S.top_overlap(b.where("id % 20 = 0").select("id", "w"), b.select("id", "w"), 4 * 10)
    texts = lambda key, name: b.select(C("id").alias(key), C("text").alias(name))
    pairs = found.join(texts("query_id", "query"), "query_id").join(texts("row_id", "text"), "row_id")
    return S.rerank(pairs, _by_length, 10).withColumn("score", F.round("score", 9))


@query("vec_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS l1 FROM embeddings")
def _(s, d):
    v = S.normalised(C("embedding"))
    return read(s, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"))


@query("embed_md5", "SELECT item_id, round(list_sum(list_transform(range(16), lambda i: (('0x' || substr(md5(text), (i * 2 + 1)::INT, 2))::INT - 128) / 128.0::DOUBLE * (i + 1))), 6) AS mark FROM benchmark")
def _(s, d):
    v = S.md5_embedding(C("text"), 16)
    return read(s, d, "benchmark").select("item_id", F.round(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("mark"))


@query("embed_stub", "SELECT item_id, round(list_sum(list_transform(range(32), lambda i: (('0x' || substr(sha256('42:' || text), (i * 2 + 1)::INT, 2))::INT - 127.5::DOUBLE) / 255.0::DOUBLE * (i + 1))), 6) AS mark FROM benchmark")
def _(s, d):
    v = S.stub_embedding(C("text"), 32)
    return read(s, d, "benchmark").select("item_id", F.round(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("mark"))
