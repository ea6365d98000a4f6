"""Queries of ranking metrics. A query is a source; its results are the source's documents, longest first; gold are those of good quality."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import evaluation as E
from tidemark.operators import validators as V
from tidemark.operators.ordered import numbered
from tidemark.registry import query, read

C = F.col
K = 10


def _rows(s, d):
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).cast("long")
    ranked = read(s, d, "documents").select(C("source").alias("query_id"), "doc_id", rank.alias("rank"))
    gold = read(s, d, "documents").join(read(s, d, "labels").where("quality = 1").select("doc_id"), "doc_id").select(C("source").alias("query_id"), "doc_id")
    return E.judged(ranked, gold)


_ROWS = """rows AS (SELECT source AS query_id, d.doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS rank,
  coalesce(quality, 0) = 1 AS hit, count(*) FILTER (quality = 1) OVER (PARTITION BY source) AS gold_n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_W = "CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 1 / log2(rank) END"
_METRICS = f"""{_ROWS}, metrics AS (SELECT query_id, round(count(*) FILTER (hit)::DOUBLE / count(*), 6) AS precision,
  round(coalesce(count(*) FILTER (hit)::DOUBLE / nullif(max(gold_n), 0), 0), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0), 6) AS rr,
  round(coalesce(sum({_W}) FILTER (hit), 0) / list_sum(list_transform(range(1, least({K}, max(gold_n)) + 1), lambda r: CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 1 / log2(r) END)), 6) AS ndcg,
  max(gold_n) = 0 OR count(*) FILTER (hit) > 0 AS coverage FROM rows WHERE rank <= {K} GROUP BY 1)"""

for _name, _column in (("eval_precision_at_k", "precision"), ("eval_recall_at_k", "recall"), ("eval_mrr_at_k", "rr"), ("eval_ndcg_at_k", "ndcg"), ("eval_coverage", "coverage")):
    query(_name, f"WITH {_METRICS} SELECT query_id, {_column} FROM metrics")(lambda s, d, c=_column: E.metrics(_rows(s, d), K).select("query_id", c))

_SUMMARY = "round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(rr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(coverage::INT), 4) AS coverage"


def _summary(s, d):
    mean = lambda c: F.round(F.avg(c), 4)
    return E.metrics(_rows(s, d), K).agg(mean("precision").alias("precision"), mean("recall").alias("recall"), mean("rr").alias("mrr"), mean("ndcg").alias("ndcg"), mean(C("coverage").cast("int")).alias("coverage"))


@query("eval_summary", f"WITH {_METRICS} SELECT {_SUMMARY} FROM metrics")
def _(s, d):
    return _summary(s, d)


# A lane's targets.
TARGETS = {"precision": 0.40, "recall": 0.70, "mrr": 0.35, "ndcg": 0.55, "coverage": 0.95}
_LONG = f"{_METRICS}, one AS (SELECT {_SUMMARY} FROM metrics), long AS (UNPIVOT one ON precision, recall, mrr, ndcg, coverage INTO NAME metric VALUE actual)"


def _long(s, d):
    return _summary(s, d).unpivot([], list(TARGETS), "metric", "actual")


def _target():
    found = F.lit(None).cast("double")
    for name, value in TARGETS.items():
        found = F.when(C("metric") == name, value).otherwise(found)
    return found


_TARGET_SQL = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in TARGETS.items()) + " END"


@query("metric_bands", f"WITH {_LONG} SELECT metric, CASE WHEN actual >= t THEN 'GREEN' WHEN actual >= t * 0.9::DOUBLE THEN 'AMBER' ELSE 'RED' END AS band FROM (SELECT *, {_TARGET_SQL} AS t FROM long)")
def _(s, d):
    return _long(s, d).select("metric", E.band(C("actual"), _target()).alias("band"))


@query("regression_check", f"WITH {_LONG} SELECT metric, round(actual - {_TARGET_SQL}, 4) AS delta, actual - {_TARGET_SQL} < -0.01::DOUBLE AS regressed FROM long WHERE metric IN ('coverage', 'recall', 'ndcg')")
def _(s, d):
    """Against the targets as a baseline: a loss of more than 0.01."""
    delta = C("actual") - _target()
    return _long(s, d).where(C("metric").isin("coverage", "recall", "ndcg")).select("metric", F.round(delta, 4).alias("delta"), (delta < -0.01).alias("regressed"))


@query("delta_indicator", f"WITH {_LONG} SELECT metric, CASE WHEN abs(actual - {_TARGET_SQL}) < 0.001::DOUBLE THEN 'flat' WHEN actual > {_TARGET_SQL} THEN 'up' ELSE 'down' END AS change FROM long")
def _(s, d):
    delta = C("actual") - _target()
    return _long(s, d).select("metric", F.when(F.abs(delta) < 0.001, "flat").when(delta > 0, "up").otherwise("down").alias("change"))


@query("diversity_topk", f"WITH {_ROWS} SELECT query_id, count(DISTINCT doc_id) AS docs FROM rows WHERE rank <= 8 GROUP BY 1")
def _(s, d):
    return _rows(s, d).where("rank <= 8").groupBy("query_id").agg(F.countDistinct("doc_id").alias("docs"))


@query("semi_gold_hits", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(s, d):
    return read(s, d, "documents").join(read(s, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("anti_unselected", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    return read(s, d, "documents").join(read(s, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("grounding_overlap", """
WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(lower(replace(text, chr(10), ' ')), ' '), lambda w: w <> '')) AS w, role FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.w AS answer, b.w AS context FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND a.role = 'assistant')
SELECT conv_id, turn, round(CASE WHEN len(context) = 0 THEN 1 ELSE 1 + 4 * len(list_intersect(answer, context))::DOUBLE / len(context) END, 6) AS score FROM p""")
def _(s, d):
    """Of an assistant's turn against the turn before it: 1 to 5, by the share of the context's words that it has."""
    w = F.filter(F.array_distinct(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")), lambda x: x != "")
    t = read(s, d, "conversations").select("conv_id", "turn", "role", w.alias("w"))
    before = t.select("conv_id", (C("turn") + 1).alias("turn"), C("w").alias("context"))
    share = F.size(F.array_intersect("w", "context")) / F.nullif(F.size("context"), F.lit(0))
    return t.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(F.coalesce(1 + 4 * share, F.lit(1.0)), 6).alias("score"))


_TAGS = ("the", "idiot-clown", "que de", "trash")


def _alignment(text, tags, empty: float):
    """The share of tags of which the text has the whole or any hyphen- or space-separated word, as substrings."""
    if not tags:
        return F.lit(empty)
    low = F.lower(text)
    return F.round(sum((X.contains_any(low, [t, *t.replace("-", " ").split()]).cast("double") for t in tags), F.lit(0.0)) / len(tags), 6)


_ALIGN = "round((" + " + ".join("(" + " OR ".join(f"contains(lower(text), '{w}')" for w in [t, *t.replace("-", " ").split()]) + ")::INT" for t in _TAGS) + f") / {len(_TAGS)}.0::DOUBLE, 6)"


@query("tag_alignment", f"SELECT doc_id, {_ALIGN} AS aligned, 0.0::DOUBLE AS untagged FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", _alignment(C("text"), _TAGS, 0.0).alias("aligned"), _alignment(C("text"), (), 0.0).alias("untagged"))


@query("tag_alignment_default1", f"SELECT doc_id, {_ALIGN} AS aligned, 1.0::DOUBLE AS untagged FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", _alignment(C("text"), _TAGS, 1.0).alias("aligned"), _alignment(C("text"), (), 1.0).alias("untagged"))


_MUST, _FLAGS = ("the que", "und"), ("idiot clown", "trash")
_WORDS = lambda phrases: " OR ".join(f"contains(lower(text), '{w}')" for p in phrases for w in p.split())


@query("semantic_check", f"SELECT doc_id, NOT ({_WORDS(_FLAGS)}) AND (doc_id % 3 <> 0 OR {_WORDS(_MUST)}) AS passed, CASE WHEN doc_id % 3 = 0 AND NOT ({_WORDS(_MUST)}) THEN 'must_reference_stone_meaning' END AS failed_assertion, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_WORDS((p,))} THEN '{p}' END" for p in _MUST) + "], lambda x: x IS NOT NULL), ',') AS matches FROM documents")
def _(s, d):
    """No red flag, and where the meaning is required, one of what must be there, by any of its words."""
    x = read(s, d, "documents").select("doc_id", V.semantic(C("text"), _MUST, _FLAGS, C("doc_id") % 3 == 0).alias("r"))
    return x.select("doc_id", "r.passed", "r.failed_assertion", F.array_join("r.matches", ",").alias("matches"))


_POINTS = (("length(trim(text)) > 10", 0.3), ("TRUE", 0.2), ("doc_id % 3 <> 0", 0.1), ("doc_id % 4 <> 0", 0.2), ("doc_id % 4 <> 0 AND lang <> 'en'", 0.1), ("doc_id % 4 <> 0 AND doc_id % 5 <> 0", 0.1), ("doc_id % 2 = 0", 0.1), ("length(text) > 100", 0.1), ("length(text) > 500", 0.1))


@query("doc_grounding_score", "SELECT doc_id, round(least(1.0::DOUBLE, " + " + ".join(f"CASE WHEN {c} THEN {v}::DOUBLE ELSE 0 END" for c, v in _POINTS) + "), 6) AS score FROM documents")
def _(s, d):
    """Text, ids, source and span of a chunk; here some documents have no chunk id, source, type, title or span."""
    k = C("doc_id")
    score = V.index_grounding(C("text"), k.cast("string"), F.when(k % 3 != 0, "c"), k % 4 != 0, F.when(C("lang") != "en", C("lang")), F.when(k % 5 != 0, "t").otherwise(""), k % 2 == 0)
    return read(s, d, "documents").select("doc_id", F.round(score, 6).alias("score"))


_ASSERTION = "CASE WHEN quality = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'must_cite' WHEN 1 THEN 'must_reference_stone_meaning' END END"


@query("per_tag_pass_fail", f"""WITH r AS (SELECT source, quality, {_ASSERTION} AS failed FROM documents d JOIN labels USING (doc_id)), f AS (SELECT source, failed, count(*) AS n FROM r WHERE failed IS NOT NULL GROUP BY ALL),
 t AS (SELECT source, arg_min(failed, (-n, failed)) AS top_failed FROM f GROUP BY 1)
SELECT r.source, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0) AS failed, any_value(top_failed) AS top_failed FROM r LEFT JOIN t ON t.source = r.source GROUP BY 1""")
def _(s, d):
    """Of each source how many pass, and the assertion that fails most often; of equally frequent ones the least name."""
    k = C("doc_id")
    failed = F.when(C("quality") == 0, F.when(k % 3 == 0, "must_cite").when(k % 3 == 1, "must_reference_stone_meaning"))
    return E.pass_fail(read(s, d, "documents").join(read(s, d, "labels"), "doc_id").withColumn("assertion", failed), "source", C("quality") == 1, "assertion")


@query("mrr_of_lists", f"WITH {_METRICS}, z AS (SELECT query_id, rr, query_id LIKE '%1' AS ragged FROM metrics) SELECT round(avg(rr) FILTER (NOT ragged), 6) AS even, 0.0::DOUBLE AS ragged FROM z")
def _(s, d):
    """Two lists side by side, results and gold sets: the mean over them, and 0 where one list is longer."""
    rows = _rows(s, d).where(~C("query_id").endswith("1") & (C("rank") <= K))
    found = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    lists = numbered(rows.groupBy("query_id").agg(found.alias("found"), F.collect_list(F.when(C("hit") == 1, C("doc_id"))).alias("wanted")), [], ["query_id"], "at")
    results, gold = lists.select("at", C("found").alias("items")), lists.select("at", C("wanted").alias("items"))
    even = E.mean_reciprocal_rank(results, gold, "at", "items", K)
    ragged = E.mean_reciprocal_rank(results, gold.where("at > 1"), "at", "items", K)
    return even.select(F.round("mrr", 6).alias("even")).crossJoin(F.broadcast(ragged.select(C("mrr").alias("ragged"))))


@query("ensemble_choice", """SELECT l_orderkey, arg_min(l_linenumber, (-score, cost, l_linenumber)) AS l_linenumber, max(score) AS score FROM (SELECT l_orderkey, l_linenumber, l_tax AS cost,
  round(0.45::DOUBLE * l_discount + 0.45::DOUBLE * l_quantity / 50 + 0.1::DOUBLE * (l_linenumber % 3) - 0.05::DOUBLE * l_quantity / 10 - 0.05::DOUBLE * l_tax, 6) AS score FROM lineitem WHERE l_returnflag <> 'R') GROUP BY 1""")
def _(s, d):
    """The lines of an order as answers to one question; those returned do not pass."""
    rows = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", C("l_discount").alias("coherence_gate"), (C("l_quantity") / 50).alias("stones_alignment_filter"), (C("l_linenumber") % 3).cast("double").alias("readability"), (C("l_quantity") / 10).alias("latency_ms"), C("l_tax").alias("cost_usd"))
    return E.ensemble(rows, ["l_orderkey"], "l_linenumber", C("l_returnflag") != "R")
