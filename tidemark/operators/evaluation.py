"""Ranking metrics of a table of ranked results against gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked (query_id, rank, doc_id) with hit, and gold_n of its query; queries without gold have 0."""
    sizes = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold_n"))
    marked = ranked.join(gold.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return marked.join(sizes, "query_id", "left").select("query_id", "doc_id", "rank", F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("gold_n", F.lit(0).cast("long")).alias("gold_n"))


def weight(rank):
    """The first two ranks weigh 1, rank r > 2 weighs 1 / log2(r)."""
    return F.when(rank == 1, F.lit(1.0)).otherwise(1 / F.log2(rank))


def metrics(rows: DataFrame, k: int) -> DataFrame:
    """precision (by what was returned, not k), recall, rr, ndcg and coverage of each query's k first results."""
    top = rows.where(F.col("rank") <= k)
    hits = F.sum("hit")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.max("gold_n")).cast("int")), F.lit(0.0), lambda a, r: a + weight(r))
    first = F.min(F.when(F.col("hit") == 1, F.col("rank")))
    none = F.max("gold_n") == 0
    return top.groupBy("query_id").agg(
        F.round(hits / F.count(F.lit(1)), 6).alias("precision"),
        F.round(F.when(none, 0.0).otherwise(hits / F.nullif(F.max("gold_n"), F.lit(0))), 6).alias("recall"),
        F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6).alias("rr"),
        F.round(F.when(none, 0.0).otherwise(F.sum(F.col("hit") * weight(F.col("rank"))) / F.when(~none, ideal)), 6).alias("ndcg"),
        (none | (hits > 0)).alias("coverage"),
    )


def band(actual, target, tolerance: float = 0.1):
    """GREEN from the target on, AMBER from a tenth below it on, else RED."""
    return F.when(actual >= target, "GREEN").when(actual >= target * (1 - tolerance), "AMBER").otherwise("RED")


def pass_fail(rows: DataFrame, tag: str, passed: Column, assertion: str) -> DataFrame:
    """(tag, passed, failed, top_failed): of each tag the counts, and the assertion that fails most often, the least name in ties."""
    failed = rows.where(F.col(assertion).isNotNull()).groupBy(tag, assertion).agg(F.count(F.lit(1)).alias("n"))
    top = failed.groupBy(tag).agg(F.min_by(assertion, F.struct(-F.col("n"), F.col(assertion))).alias("top_failed"))
    return rows.groupBy(tag).agg(F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed")).join(top, tag, "left")


def mean_reciprocal_rank(results: DataFrame, gold: DataFrame, at: str, items: str, k: int) -> DataFrame:
    """(mrr): one row. results and gold are two lists, whose rows (at, items) belong together by their place; the mean over
    them of 1 / the place of the first gold item among the first k results. Lists of different lengths have 0."""
    both = results.select(at, F.col(items).alias("found")).join(gold.select(at, F.col(items).alias("wanted")), at, "full_outer")
    places = F.filter(F.transform(F.slice("found", 1, k), lambda x, i: F.when(F.array_contains("wanted", x), i + 1)), lambda x: x.isNotNull())
    means = both.agg(F.avg(F.coalesce(1.0 / F.get(places, F.lit(0)), F.lit(0.0))).alias("mean"), F.bool_or(F.col("found").isNull() | F.col("wanted").isNull()).alias("ragged"))
    return means.select(F.when(F.col("ragged"), 0.0).otherwise(F.coalesce("mean", F.lit(0.0))).alias("mrr"))


# Weights of a champion's and its challengers' scores.
ENSEMBLE = {"coherence_gate": 0.45, "stones_alignment_filter": 0.45, "readability": 0.1, "latency_ms": -0.05, "cost_usd": -0.05}


def ensemble(answers: DataFrame, keys: list[str], ident: str, passes: Column, cost: str = "cost_usd", weights: dict[str, float] | None = None) -> DataFrame:
    """The chosen answer of each group: scored first, the weighted sum of its measures, then gated; the best one that passes,
    the cheapest of equally good ones, then the least id. Groups of which none passes have no row."""
    score = sum((F.coalesce(F.col(m), F.lit(0.0)) * w for m, w in (weights or ENSEMBLE).items()), F.lit(0.0))
    scored = answers.withColumn("score", F.round(score, 6)).where(passes)
    best = F.min_by(F.struct(ident, "score"), F.struct(-F.col("score"), F.col(cost), F.col(ident)))
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, f"b.{ident}", "b.score")
