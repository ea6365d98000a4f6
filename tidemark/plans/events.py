"""Queries of the retrieval-turn log: filters, counts, percentiles, budgets and windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import telemetry as L
from tidemark.operators import validators as V
from tidemark.operators.ordered import among_first, percentile, running, sessions
from tidemark.operators.sessions import grounding_gate
from tidemark.operators.telemetry import TURNS_SQL
from tidemark.registry import query, read

C = F.col


def one():
    return F.count(F.lit(1))


def _turns(s, d):
    return L.turns(read(s, d, "events"))


def _where(name: str, spark_condition: str, sql_condition: str | None = None):
    """Turns that a predicate keeps, by id."""
    query(name, f"WITH {TURNS_SQL} SELECT event_id, lane, total_ms FROM turns WHERE {sql_condition or spark_condition}")(lambda s, d: _turns(s, d).where(spark_condition).select("event_id", "lane", "total_ms"))


_where("log_filter_lane", "lane = 'fast'")
_where("log_filter_slow", "total_ms IS NOT NULL AND total_ms >= 150")
_where("log_filter_grounding", "grounding IS NOT NULL AND grounding >= 0.5")
_where("log_user_filter", "lane = 'accurate' AND topk > 5 AND total_ms < 100")
_where("jq_lane", "lane = 'accurate'")
_where("jq_low_grounding_default1", "coalesce(nullif(grounding, 0.5), 1) < 0.3")
_where("jq_no_citations", "citations = 0")
_where("jq_fallbacks", "fallback IS NOT NULL")
_where("jq_combined", "lane = 'fast' AND total_ms > 100 AND citations > 0 AND fallback IS NULL")
_where("jq_citation_mismatch", "citations <> topk")


@query("log_since_window", f"WITH {TURNS_SQL} SELECT event_id, lane FROM turns, (SELECT max(ts) AS now FROM events) WHERE ts >= now - INTERVAL 60 MINUTE")
def _(s, d):
    """The last hour before the newest event."""
    now = read(s, d, "events").agg(F.max("ts").alias("now"))
    return _turns(s, d).crossJoin(F.broadcast(now)).where("ts >= now - INTERVAL 60 MINUTES").select("event_id", "lane")


_ELIGIBLE = f"{TURNS_SQL}, eligible AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM turns) WHERE nth > {L.WARMUP_EVENTS} AND total_ms IS NOT NULL)"


def _eligible(s, d):
    return among_first(_turns(s, d), ["user_id"], ["ts", "event_id"], L.WARMUP_EVENTS, "warmup").where(~C("warmup") & C("total_ms").isNotNull())


@query("budget_eligible", f"WITH {_ELIGIBLE} SELECT event_id, lane, total_ms FROM eligible")
def _(s, d):
    return _eligible(s, d).select("event_id", "lane", "total_ms")


@query("warmup_flag", f"WITH {TURNS_SQL} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {L.WARMUP_EVENTS} AS warmup FROM turns")
def _(s, d):
    return among_first(_turns(s, d), ["user_id"], ["ts", "event_id"], L.WARMUP_EVENTS, "warmup").select("event_id", "warmup")


@query("budget_check", f"WITH {_ELIGIBLE}, p AS (SELECT lane, quantile_disc(total_ms, 0.95) AS p95, CASE lane WHEN 'fast' THEN 150 ELSE 500 END AS budget FROM eligible GROUP BY lane) SELECT lane, round(p95, 6) AS p95, CASE WHEN p95 <= budget THEN 'ok' ELSE 'over' END AS verdict, round((p95 / budget - 1) * 100, 6) AS over_percent FROM p")
def _(s, d):
    budget = F.when(C("lane") == "fast", L.BUDGET_MS["fast"]).otherwise(L.BUDGET_MS["accurate"])
    p = percentile(_eligible(s, d), ["lane"], "total_ms", 0.95, "p95", nearest=True)
    return p.select("lane", F.round("p95", 6).alias("p95"), L.verdict(C("p95"), budget).alias("verdict"), F.round((C("p95") / budget - 1) * 100, 6).alias("over_percent"))


@query("p95_nearest_rank", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def _(s, d):
    return percentile(read(s, d, "events"), ["event_type"], "value", 0.95, "p95", nearest=True)


@query("p95_interpolated", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def _(s, d):
    return percentile(read(s, d, "events"), ["event_type"], "value", 0.95, "p95").withColumn("p95", F.round("p95", 6))


_ROLL = "round(quantile_cont(total_ms, 0.95) OVER (PARTITION BY lane ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 6)"


@query("rolling_p95_by_lane", f"WITH {TURNS_SQL} SELECT event_id, lane, {_ROLL} AS p95 FROM turns")
def _(s, d):
    return L.rolling_p95(_turns(s, d), "total_ms", ["ts", "event_id"], ["lane"]).select("event_id", "lane", "p95")


@query("rolling_p95_all", f"WITH {TURNS_SQL} SELECT event_id, {_ROLL.replace('PARTITION BY lane', 'PARTITION BY user_id')} AS p95 FROM turns")
def _(s, d):
    """Over all lanes of a user."""
    return L.rolling_p95(_turns(s, d), "total_ms", ["ts", "event_id"], ["user_id"]).select("event_id", "p95")


@query("rolling_p95_every10", f"WITH {TURNS_SQL} SELECT event_id, lane, p95 FROM (SELECT event_id, lane, {_ROLL} AS p95, row_number() OVER (PARTITION BY lane ORDER BY ts, event_id) AS nth FROM turns WHERE topk > 2) WHERE nth % 10 = 0")
def _(s, d):
    rows = L.rolling_p95(_turns(s, d).where("topk > 2"), "total_ms", ["ts", "event_id"], ["lane"])
    return rows.where("nth % 10 = 0").select("event_id", "lane", "p95")


_RUN = "coalesce(sum(total_ms) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


def _used(s, d):
    """Turns with what their user has used before them."""
    return running(_turns(s, d), ["user_id"], ["ts", "event_id"], {"used": C("total_ms")})


@query("budget_cutoff", f"WITH {TURNS_SQL} SELECT event_id, user_id FROM (SELECT *, {_RUN} AS used FROM turns) WHERE used <= 1000")
def _(s, d):
    """Steps that still run: what was used before them is within the budget."""
    return _used(s, d).where("used <= 1000").select("event_id", "user_id")


@query("budget_remaining", f"WITH {TURNS_SQL} SELECT event_id, round(10000 - {_RUN} - total_ms, 4) AS remaining FROM turns")
def _(s, d):
    return _used(s, d).select("event_id", F.round(10000 - C("used") - C("total_ms"), 4).alias("remaining"))


@query("jq_slow_breakdown", f"WITH {TURNS_SQL} SELECT lane, count(*) AS n, round(avg(total_ms), 6) AS mean_ms, max(total_ms) AS max_ms FROM turns WHERE total_ms > 100 GROUP BY 1")
def _(s, d):
    return _turns(s, d).where("total_ms > 100").groupBy("lane").agg(one().alias("n"), F.round(F.avg("total_ms"), 6).alias("mean_ms"), F.max("total_ms").alias("max_ms"))


for _name, _col in (("jq_topk_hist", "topk"), ("jq_lane_counts", "lane"), ("jq_fallback_counts", "fallback")):
    query(_name, f"WITH {TURNS_SQL} SELECT {_col}, count(*) AS n FROM turns GROUP BY 1")(lambda s, d, c=_col: _turns(s, d).groupBy(c).agg(one().alias("n")))


@query("jq_grounding_hist", f"WITH {TURNS_SQL} SELECT floor(grounding * 10)::BIGINT AS tenth, count(*) AS n FROM turns GROUP BY 1")
def _(s, d):
    return _turns(s, d).groupBy(F.floor(C("grounding") * 10).alias("tenth")).agg(one().alias("n"))


@query("jq_citation_coverage", f"WITH {TURNS_SQL} SELECT lane, round(avg((citations > 0)::INT), 6) AS coverage FROM turns GROUP BY 1")
def _(s, d):
    return _turns(s, d).groupBy("lane").agg(F.round(F.avg((C("citations") > 0).cast("int")), 6).alias("coverage"))


@query("jq_refusal_rate", f"WITH {TURNS_SQL} SELECT lane, round(avg(refusal::INT), 6) AS rate FROM turns GROUP BY 1")
def _(s, d):
    return _turns(s, d).groupBy("lane").agg(F.round(F.avg(C("refusal").cast("int")), 6).alias("rate"))


@query("alert_levels", f"WITH {TURNS_SQL}, p AS (SELECT lane, quantile_cont(total_ms, 0.95) AS p95, avg((fallback IS NOT NULL)::INT) AS fb, avg(grounding) AS g FROM turns GROUP BY 1) SELECT lane, CASE WHEN p95 > CASE lane WHEN 'fast' THEN 500 ELSE 2000 END THEN 'critical' WHEN p95 > CASE lane WHEN 'fast' THEN 200 ELSE 800 END THEN 'warning' ELSE 'ok' END AS latency, CASE WHEN fb > 0.15 THEN 'critical' WHEN fb > 0.05 THEN 'warning' ELSE 'ok' END AS fallback, CASE WHEN g < 0.1 THEN 'critical' WHEN g < 0.3 THEN 'warning' ELSE 'ok' END AS grounding FROM p")
def _(s, d):
    means = _turns(s, d).groupBy("lane").agg(F.avg(C("fallback").isNotNull().cast("int")).alias("fb"), F.avg("grounding").alias("g"))
    p = means.join(percentile(_turns(s, d), ["lane"], "total_ms", 0.95, "p95"), "lane")
    at = lambda i: F.when(C("lane") == "fast", L.ALERT_MS["fast"][i]).otherwise(L.ALERT_MS["accurate"][i])
    level = lambda crit, warn: F.when(crit, "critical").when(warn, "warning").otherwise("ok")
    return p.select("lane", level(C("p95") > at(1), C("p95") > at(0)).alias("latency"), level(C("fb") > 0.15, C("fb") > 0.05).alias("fallback"), level(C("g") < 0.1, C("g") < 0.3).alias("grounding"))


@query("window_hourly_p95", "SELECT event_type, date_trunc('hour', ts) AS hour, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    hourly = read(s, d, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    counts = hourly.groupBy("event_type", "hour").agg(one().alias("n"))
    return counts.join(percentile(hourly, ["event_type", "hour"], "value", 0.95, "p95"), ["event_type", "hour"]).withColumn("p95", F.round("p95", 6))


@query("sessionize_30m", "SELECT user_id, session, count(*) AS n, min(ts) AS begun, max(ts) AS ended FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2")
def _(s, d):
    marked = sessions(read(s, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "ts", "30 MINUTES")
    return marked.groupBy("user_id", "session").agg(one().alias("n"), F.min("ts").alias("begun"), F.max("ts").alias("ended"))


@query("tail_last_n", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(s, d):
    return read(s, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("recent5_per_session", "SELECT user_id, event_id, nth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 5")
def _(s, d):
    nth = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).cast("long")
    return read(s, d, "events").select("user_id", "event_id", nth.alias("nth")).where("nth <= 5")


@query("session_duration", "SELECT user_id, date_diff('second', min(ts), max(ts)) AS seconds FROM events GROUP BY 1")
def _(s, d):
    return read(s, d, "events").groupBy("user_id").agg(F.expr("timestampdiff(SECOND, date_trunc('second', min(ts)), date_trunc('second', max(ts)))").alias("seconds"))


@query("metrics_rollup", """WITH m AS (SELECT event_id, ts, event_type AS name, 'lane=' || (user_id % 2) || ',tag=' || (user_id % 10) AS tags, CASE event_type WHEN 'click' THEN 'counter' WHEN 'view' THEN 'counter' WHEN 'purchase' THEN 'timing' ELSE 'gauge' END AS kind, value FROM events)
SELECT kind, name, tags, count(*) AS n, CASE kind WHEN 'counter' THEN round(sum(value), 4) END AS total, CASE kind WHEN 'timing' THEN round(avg(value), 4) END AS mean, CASE kind WHEN 'timing' THEN max(value) END AS worst, CASE kind WHEN 'gauge' THEN arg_max(value, (ts, event_id)) END AS last FROM m GROUP BY kind, name, tags""")
def _(s, d):
    """Counters are summed, timings kept as a spread, gauges keep their last value; by name and tags in order."""
    kind = F.when(C("event_type").isin("click", "view"), "counter").when(C("event_type") == "purchase", "timing").otherwise("gauge")
    tags = F.create_map(F.lit("tag"), (C("user_id") % 10).cast("string"), F.lit("lane"), (C("user_id") % 2).cast("string"))
    return L.metrics(read(s, d, "events").select("event_id", "ts", C("event_type").alias("name"), kind.alias("kind"), tags.alias("tags"), "value"), ["ts", "event_id"])


@query("sample_hash_mod", "SELECT event_id FROM events WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 6))::INT % 10 = 0")
def _(s, d):
    """A tenth of the events, by a hash of the id."""
    return read(s, d, "events").where(F.conv(F.left(F.md5(C("event_id").cast("string")), F.lit(6)), 16, 10).cast("long") % 10 == 0).select("event_id")


@query("expand_both", f"WITH {TURNS_SQL} SELECT event_id, unnest(CASE WHEN topk < 3 THEN ['fast', 'accurate'] ELSE [lane] END) AS lane FROM turns")
def _(s, d):
    both = F.when(C("topk") < 3, F.array(F.lit("fast"), F.lit("accurate"))).otherwise(F.array("lane"))
    return _turns(s, d).select("event_id", F.explode(both).alias("lane"))


@query("snapshot_diff", "SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'added' ELSE 'removed' END AS change FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') a FULL JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id WHERE a.user_id IS NULL OR b.user_id IS NULL")
def _(s, d):
    """Users of two snapshots of the log (of two kinds of events) that only one of them has."""
    e = read(s, d, "events")
    old, new = (e.where(C("event_type") == k).select("user_id").distinct() for k in ("click", "purchase"))
    return new.join(old, "user_id", "left_anti").withColumn("change", F.lit("added")).unionByName(old.join(new, "user_id", "left_anti").withColumn("change", F.lit("removed")))


@query("stats_diff", "WITH h AS (SELECT count(*) FILTER (day(ts) % 2 = 0) AS b, count(*) FILTER (day(ts) % 2 = 1) AS a, event_type FROM events GROUP BY ALL) SELECT event_type, a - b AS added, greatest(0, b - a) AS removed FROM h")
def _(s, d):
    h = read(s, d, "events").groupBy("event_type").agg(F.count_if(F.dayofmonth("ts") % 2 == 0).alias("b"), F.count_if(F.dayofmonth("ts") % 2 == 1).alias("a"))
    return h.select("event_type", (C("a") - C("b")).alias("added"), F.greatest(F.lit(0).cast("long"), C("b") - C("a")).alias("removed"))


_OUTCOME = "CASE WHEN fallback = 'flag_disabled' THEN 'disabled' WHEN event_id % 19 = 0 THEN 'no_query' WHEN fallback = 'no_results' THEN 'empty' WHEN grounding < 0.25 THEN 'low_grounding' WHEN citations = 0 THEN 'no_citations' ELSE 'success' END"


@query("turn_outcome", f"WITH {TURNS_SQL} SELECT outcome, count(*) AS n FROM (SELECT {_OUTCOME} AS outcome FROM turns) GROUP BY 1")
def _(s, d):
    """Each turn by the guardrail that ends it; here some have a blank query."""
    query_text = F.when(C("event_id") % 19 == 0, " ").otherwise("q")
    outcome = L.turn_outcome(C("fallback") == "flag_disabled", query_text, C("fallback") == "no_results", C("grounding"), C("citations"))
    return _turns(s, d).groupBy(outcome.alias("outcome")).agg(one().alias("n"))


_SCORED = """(SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'ai_room' ELSE 'entry_room' END AS room, event_id % 3 <> 0 AS has_context,
  CASE event_id % 4 WHEN 0 THEN grounding WHEN 1 THEN (1 + topk % 5 - 1) / 4.0::DOUBLE WHEN 2 THEN CASE WHEN event_id % 3 <> 0 THEN grounding / 2 END END AS score FROM turns)"""


@query("gate_grounding", f"WITH {TURNS_SQL} SELECT event_id, NOT (reason = 'below threshold') AS allow, reason FROM (SELECT event_id, CASE WHEN room <> 'ai_room' AND NOT has_context THEN 'nothing to evaluate' WHEN score IS NULL THEN 'no score' WHEN score < 0.25 THEN 'below threshold' ELSE 'meets threshold' END AS reason FROM {_SCORED})")
def _(s, d):
    """The score is in one of three places or missing, which is allowed."""
    k, g = C("event_id"), C("grounding")
    context = k % 3 != 0
    gate = grounding_gate(F.when(k % 5 == 0, "ai_room").otherwise("entry_room"), F.when(k % 4 == 0, g), F.when(k % 4 == 1, 1 + C("topk") % 5), F.when((k % 4 == 2) & context, g / 2), context)
    return _turns(s, d).select("event_id", gate.alias("g")).select("event_id", "g.allow", "g.reason")


@query("mean_grounding", f"WITH {TURNS_SQL} SELECT user_id, round(coalesce(avg(grounding), 0), 6) AS grounding FROM turns GROUP BY 1")
def _(s, d):
    return _turns(s, d).groupBy("user_id").agg(F.round(F.coalesce(F.avg("grounding"), F.lit(0.0)), 6).alias("grounding"))


@query("turn_grounding", f"WITH {TURNS_SQL} SELECT event_id, g, round((g - 1) / 4.0::DOUBLE, 6) AS normalised FROM (SELECT event_id, 1 + (citations > 0)::BIGINT + (grounding > 0.5)::BIGINT + (grounding > 0.7)::BIGINT + (NOT refusal)::BIGINT AS g FROM turns)")
def _(s, d):
    bit = lambda c: c.cast("long")
    g = 1 + bit(C("citations") > 0) + bit(C("grounding") > 0.5) + bit(C("grounding") > 0.7) + bit(~C("refusal"))
    return _turns(s, d).select("event_id", g.alias("g")).withColumn("normalised", F.round((C("g") - 1) / 4.0, 6))


@query("sufficient_support", f"WITH {TURNS_SQL} SELECT lane, count(*) FILTER (grounding >= CASE lane WHEN 'fast' THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END AND event_id % 3 <= 1) AS sufficient, count(*) FILTER (grounding >= 0.7::DOUBLE AND event_id % 3 <= 0) AS strict FROM turns GROUP BY 1")
def _(s, d):
    """By the lane's thresholds, whose rates allow one hallucination, and by a rate that allows none."""
    errors = C("event_id") % 3
    fast = C("lane") == "fast"
    own = V.sufficient(C("grounding"), errors, F.when(fast, L.ALIGNMENT["fast"]).otherwise(L.ALIGNMENT["accurate"]), F.when(fast, L.HALLUCINATION_RATE["fast"]).otherwise(L.HALLUCINATION_RATE["accurate"]))
    strict = V.sufficient(C("grounding"), errors, F.lit(L.ALIGNMENT["fast"]), F.lit(0.005))
    return _turns(s, d).groupBy("lane").agg(F.count_if(own).alias("sufficient"), F.count_if(strict).alias("strict"))