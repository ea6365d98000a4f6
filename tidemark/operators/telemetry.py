"""The retrieval-turn log as a DataFrame: derived from events, with filters, percentiles and budgets over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import numbered, sliding_percentile

# Latency budgets and alert thresholds in milliseconds, by lane.
BUDGET_MS = {"fast": 150, "accurate": 500}
ALERT_MS = {"fast": (200, 500), "accurate": (800, 2000)}
WARMUP_EVENTS = 3
ROLLING_EVENTS = 200
# What a lane's answers must reach.
ALIGNMENT = {"fast": 0.70, "accurate": 0.80}
HALLUCINATION_RATE = {"fast": 0.02, "accurate": 0.01}


def turns(events: DataFrame) -> DataFrame:
    """One turn for each event: lane, topk, total_ms, grounding, fallback, citations."""
    k = F.get_json_object("props", "$.k").cast("long")
    lane = F.when(F.col("event_type").isin("click", "view"), "fast").otherwise("accurate")
    return events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        lane.alias("lane"),
        F.col("value").alias("total_ms"),
        (k % 10).alias("topk"),
        F.round(1 / (1 + F.col("value") / 100), 6).alias("grounding"),
        F.when(k % 7 == 0, "flag_disabled").when(k % 7 == 1, "no_results").alias("fallback"),
        (k % 4).alias("citations"),
        (k % 11 == 0).alias("refusal"),
    )


#: turns() as SQL.
TURNS_SQL = """turns AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_type IN ('click', 'view') THEN 'fast' ELSE 'accurate' END AS lane,
  value AS total_ms, k % 10 AS topk, round(1 / (1 + value / 100), 6) AS grounding, CASE k % 7 WHEN 0 THEN 'flag_disabled' WHEN 1 THEN 'no_results' END AS fallback,
  k % 4 AS citations, k % 11 = 0 AS refusal FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def rolling_p95(df: DataFrame, value: str, order: list[str], keys: list[str], last: int = ROLLING_EVENTS) -> DataFrame:
    """Adds nth, a row's number among those of its keys, and p95: interpolated, over the last `last` of them."""
    rows = numbered(df, keys, order)
    return sliding_percentile(rows, keys, "nth", last, value, 0.95, "p95").withColumn("p95", F.round("p95", 6))


def verdict(p95: Column, budget: Column) -> Column:
    return F.when(p95.isNull(), "unknown").when(p95 <= budget, "ok").otherwise("over")


def turn_outcome(disabled: Column, query: Column, empty: Column, grounding: Column, citations: Column, least: float = 0.25) -> Column:
    """The guardrail that ends a retrieval turn, in order, or success."""
    blank = F.coalesce(F.trim(query), F.lit("")) == ""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(disabled), "disabled").when(blank, "no_query").when(yes(empty), "empty").when(yes(grounding < least), "low_grounding").when(yes(citations == 0), "no_citations").otherwise("success")


def metrics(points: DataFrame, order: list[str]) -> DataFrame:
    """(kind, name, tags, n, total, mean, worst, last) of points (kind, name, tags, value): of a counter its sum, of a timing
    its mean and greatest value, of a gauge the last one by `order`. tags: a map, which is keyed by its entries in order."""
    named = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    return points.withColumn("tags", named).groupBy("kind", "name", "tags").agg(
        F.count(F.lit(1)).alias("n"),
        of("counter", F.round(F.sum("value"), 4)).alias("total"),
        of("timing", F.round(F.avg("value"), 4)).alias("mean"),
        of("timing", F.max("value")).alias("worst"),
        of("gauge", F.max_by("value", F.struct(*order))).alias("last"),
    )
