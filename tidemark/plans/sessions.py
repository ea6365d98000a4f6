"""Queries of sessions: steps, gates, audit chains, memory and exits. A conversation is a session and its turns are steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import sessions as S
from tidemark.operators.ordered import numbered, running
from tidemark.registry import query, read

C = F.col


def n():
    return F.count(F.lit(1))


def _steps(s, d):
    """conv_id, turn, role, text, declined."""
    return read(s, d, "conversations").withColumn("declined", F.length("text") % 7 == 0)


_STEPS = "steps AS (SELECT *, length(text) % 7 = 0 AS declined FROM conversations)"
_ORDER = "PARTITION BY conv_id ORDER BY turn"


@query("audit_prev_hash", f"SELECT conv_id, turn, coalesce(lag(left(sha256(role || '|' || text), 16)) OVER ({_ORDER}), 'genesis') AS prev_hash FROM conversations")
def _(s, d):
    steps = running(_steps(s, d), ["conv_id"], ["turn"], last={"before": S.digest(C("role"), C("text"))})
    return steps.select("conv_id", "turn", F.coalesce("before", F.lit("genesis")).alias("prev_hash"))


@query("audit_hash_chain", """
WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role || ':' || text AS step FROM conversations),
c AS (SELECT conv_id, 0::BIGINT AS k, 'genesis' AS h FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL
  SELECT o.conv_id, o.k, left(sha256(c.h || '|' || o.step), 16) FROM c JOIN o ON o.conv_id = c.conv_id AND o.k = c.k + 1)
SELECT conv_id, max(k) AS length, arg_max(h, k) AS last FROM c GROUP BY 1""")
def _(s, d):
    return S.hash_chain(read(s, d, "conversations"), "conv_id", "turn", F.concat("role", F.lit(":"), "text"))


_OUTPUT = "'{\"role\":\"' || role || '\",\"size\":' || length(text) || '}'"


@query("audit_step_hash", f"WITH {_STEPS}, h AS (SELECT *, 'sha256:' || sha256({_OUTPUT}) AS step_hash FROM steps) SELECT conv_id, turn, '0.2.0' AS contract_version, CASE WHEN declined THEN 'decline' ELSE 'ok' END AS status, step_hash, lag(step_hash) OVER ({_ORDER}) AS prev_hash, step_hash AS diagnostics_digest, CASE WHEN declined THEN 'gate_denied_or_room_decline' END AS reason, TRUE AS round_trip FROM h")
def _(s, d):
    """Each turn's answer in its envelope, chained by hashes, and whether taking it out again gives the answer."""
    rows = _steps(s, d).withColumn("data", F.to_json(F.struct("role", F.length("text").alias("size"))))
    rows = running(rows, ["conv_id"], ["turn"], last={"prev": F.concat(F.lit("sha256:"), F.sha2("data", 256))})
    rows = rows.withColumn("e", S.envelope(C("role"), C("data"), F.when(C("declined"), "decline").otherwise("ok"), S.gate_chain(("open",), {"open": F.lit(True)}), C("prev")))
    return rows.select("conv_id", "turn", "e.contract_version", "e.status", "e.audit.step_hash", "e.audit.prev_hash", "e.diagnostics_digest", "e.decline.reason", (S.downcast(C("e")) == C("data")).alias("round_trip"))


@query("stop_on_decline", f"WITH {_STEPS} SELECT conv_id, turn, declined FROM (SELECT *, coalesce(sum(declined::INT) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM steps) WHERE b = 0")
def _(s, d):
    return S.until_first(_steps(s, d), ["conv_id"], ["turn"], C("declined")).select("conv_id", "turn", "declined")


_RUN = "CASE WHEN length(text) % 17 = 1 THEN 'gate_chain_failed' WHEN role = 'system' AND conv_id % 2 = 0 THEN 'room_not_found' WHEN length(text) % 13 = 2 THEN 'room_execution_failed' WHEN length(text) % 11 = 3 THEN 'schema_validation_failed' WHEN length(text) % 7 = 0 THEN 'room_declined' END"
_UPTO = "coalesce(sum((reason IS NOT NULL)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query("stage_run_status", f"""WITH r AS (SELECT *, {_RUN} AS reason FROM conversations), b AS (SELECT *, {_UPTO} AS b FROM r),
 g AS (SELECT *, CASE WHEN length(text) % 17 = 1 THEN 'gate_chain_failed' END AS gate FROM conversations),
 x AS (SELECT 'stop' AS mode, conv_id, reason FROM b WHERE b = 0 UNION ALL SELECT 'go_on', conv_id, reason FROM r UNION ALL
  SELECT 'dry_run', conv_id, reason FROM (SELECT conv_id, turn, gate AS reason, {_UPTO.replace("reason", "gate")} AS b FROM g) WHERE b = 0)
SELECT mode, conv_id, count(*) AS ran, mode = 'go_on' OR count(reason) = 0 AS completed, count(reason) AS declined, min(reason) AS reason FROM x GROUP BY 1, 2""")
def _(s, d):
    """Each conversation as a run of stages: stopped at its first decline, going on, and dry."""
    size = F.length("text")
    steps = read(s, d, "conversations")

    def run(mode, **options):
        done = S.run_stages(steps, ["conv_id"], ["turn"], size % 17 != 1, ~((C("role") == "system") & (C("conv_id") % 2 == 0)), size % 13 == 2, size % 11 != 3, size % 7 == 0, **options)
        return done.select(F.lit(mode).alias("mode"), "conv_id", "reason")

    every = run("stop").unionByName(run("go_on", stop_on_decline=False)).unionByName(run("dry_run", dry_run=True))
    return every.groupBy("mode", "conv_id").agg(n().alias("ran"), ((C("mode") == "go_on") | (F.count("reason") == 0)).alias("completed"), F.count("reason").alias("declined"), F.min("reason").alias("reason"))


@query("plan_subset", "SELECT mode, conv_id, turn FROM conversations, (VALUES ('subset'), ('mini'), ('all')) m(mode) WHERE mode = 'all' OR mode = 'mini' AND turn < 3 OR mode = 'subset' AND turn IN (0, 2, 3)")
def _(s, d):
    """A subset wins over the mini walk; the mini walk has the first three places."""
    c = read(s, d, "conversations")
    modes = {"subset": S.planned(c, "turn", "turn", (0, 2, 3), mini=True), "mini": S.planned(c, "turn", "turn", mini=True), "all": S.planned(c, "turn", "turn")}
    return reduce(lambda a, b: a.unionByName(b), (df.select(F.lit(m).alias("mode"), "conv_id", "turn") for m, df in modes.items()))


@query("step_progress", f"SELECT conv_id, turn, row_number() OVER ({_ORDER}) AS done, count(*) OVER (PARTITION BY conv_id) - row_number() OVER ({_ORDER}) AS remaining FROM conversations")
def _(s, d):
    c = read(s, d, "conversations").select("conv_id", "turn")
    done = numbered(c, ["conv_id"], ["turn"], "done").join(c.groupBy("conv_id").agg(n().alias("size")), "conv_id")
    return done.select("conv_id", "turn", "done", (C("size") - C("done")).alias("remaining"))


@query("limit_with_overflow", "SELECT conv_id, array_to_string(list(role ORDER BY turn)[1:3], ',') || CASE WHEN count(*) > 3 THEN ' and ' || (count(*) - 3) || ' more' ELSE '' END AS shown FROM conversations GROUP BY 1")
def _(s, d):
    c = read(s, d, "conversations").select("conv_id", "turn", "role")
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    head = c.withColumn("nth", nth).where("nth <= 3").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    more = F.when(C("n") > 3, F.concat(F.lit(" and "), (C("n") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return c.groupBy("conv_id").agg(n().alias("n")).join(head, "conv_id").select("conv_id", F.concat(F.array_join(C("r.role"), ","), more).alias("shown"))


_ANSWER = """(SELECT *, CASE event_id % 6 WHEN 0 THEN 'later' WHEN 1 THEN 'hold' ELSE 'continue' END AS next_action, event_id % 17 = 0 AS has_reason,
  CASE event_id % 5 WHEN 0 THEN 'retry' WHEN 1 THEN 'halt' WHEN 2 THEN 'fallback' WHEN 3 THEN 'fail' END AS status FROM events)"""


def _answers(s, d):
    """Each event as a stage's answer, a map of text: what comes next, and for some a status or a reason to decline."""
    k = C("event_id")
    following = F.when(k % 6 == 0, "later").when(k % 6 == 1, "hold").otherwise("continue")
    status = F.when(k % 5 == 0, "retry").when(k % 5 == 1, "halt").when(k % 5 == 2, "fallback").when(k % 5 == 3, "fail")
    parts = F.array(F.struct(F.lit("next_action").alias("k"), following.alias("v")), F.struct(F.lit("status").alias("k"), status.alias("v")), F.struct(F.lit("_decline_reason").alias("k"), F.when(k % 17 == 0, "x").alias("v")))
    return read(s, d, "events").select("event_id", F.map_from_entries(F.filter(parts, lambda x: x["v"].isNotNull())).alias("output"))


@query("step_status", f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN has_reason OR next_action IN ('hold', 'later') THEN 'HALT' ELSE coalesce(upper(status), 'OK') END AS status FROM {_ANSWER}) GROUP BY 1")
def _(s, d):
    return _answers(s, d).groupBy(S.step_status(C("output")).alias("status")).agg(n().alias("n"))


@query("is_decline", f"SELECT event_id, has_reason OR next_action IN ('hold', 'later') AS declined FROM {_ANSWER}")
def _(s, d):
    return _answers(s, d).select("event_id", S.is_decline(C("output")).alias("declined"))


@query("gate_coherence", "SELECT conv_id, turn, trim(text) <> '' AND role IN ('system', 'user', 'assistant') AS allow, CASE WHEN trim(text) = '' THEN 'blank' WHEN role NOT IN ('system', 'user', 'assistant') THEN 'unknown stage' ELSE 'ok' END AS reason FROM conversations")
def _(s, d):
    reason = S.first_failure(("blank", F.trim("text") != ""), ("unknown stage", C("role").isin("system", "user", "assistant")))
    return read(s, d, "conversations").select("conv_id", "turn", reason.isNull().alias("allow"), F.coalesce(reason, F.lit("ok")).alias("reason"))


@query("gate_chain_first_failure", """
SELECT conv_id, turn, CASE WHEN length(text) < 30 THEN 1 WHEN NOT contains(text, '.') THEN 2 ELSE 3 END::BIGINT AS decisions, CASE WHEN length(text) < 30 THEN 'length' WHEN NOT contains(text, '.') THEN 'sentence' ELSE 'absent' END AS failed,
       CASE WHEN length(text) < 30 OR NOT contains(text, '.') THEN 'denied' ELSE 'unknown gate' END AS reason, NOT (length(text) < 30 OR NOT contains(text, '.') OR contains(lower(text), 'idiot')) AS known_pass FROM conversations""")
def _(s, d):
    """A chain with a gate that nobody knows, which denies, and the same without it."""
    t = C("text")
    gates = {"length": F.length(t) >= 30, "sentence": F.contains(t, F.lit(".")), "language": ~F.contains(F.lower(t), F.lit("idiot"))}
    x = read(s, d, "conversations").select("conv_id", "turn", S.gate_chain(("length", "sentence", "absent", "language"), gates).alias("g"), S.gate_chain(("length", "sentence", "language"), gates).alias("k"))
    last = F.element_at("g", -1)
    return x.select("conv_id", "turn", F.size("g").cast("long").alias("decisions"), last["gate"].alias("failed"), last["reason"].alias("reason"), F.element_at("k", -1)["allow"].alias("known_pass"))


_COUNT = lambda words: " + ".join(f"contains(t, '{w}')::INT" for w in words)


_ITEM = """(SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'unspecified' WHEN 1 THEN role WHEN 2 THEN 'calm' ELSE left(text, 55) END AS tone,
  CASE conv_id % 4 WHEN 0 THEN 'unspecified' WHEN 1 THEN role WHEN 2 THEN 'calm' WHEN 3 THEN nullif(left(text, 40), '') END AS residue,
  CASE conv_id % 5 WHEN 0 THEN role WHEN 1 THEN 'calm' WHEN 2 THEN left(text, 25) WHEN 3 THEN role ELSE CASE WHEN turn = 0 THEN '' ELSE 'ready' END END AS readiness,
  CASE WHEN (conv_id + turn) % 6 = 0 THEN 'unspecified' ELSE left(text, (150 + 20 * turn)::INT) END AS notes,
  CASE conv_id % 7 WHEN 0 THEN 'Hereby, as per the FRAMEWORK' WHEN 1 THEN 'a paradigm of synergy to leverage' WHEN 2 THEN 'keep control' ELSE role END AS commitments FROM conversations)"""


def _items(s, d):
    k, t, role, text = C("conv_id"), C("turn"), C("role"), C("text")
    tone = F.when(t % 4 == 0, "unspecified").when(t % 4 == 1, role).when(t % 4 == 2, "calm").otherwise(F.left(text, F.lit(55)))
    residue = F.when(k % 4 == 0, "unspecified").when(k % 4 == 1, role).when(k % 4 == 2, "calm").otherwise(F.nullif(F.left(text, F.lit(40)), F.lit("")))
    readiness = F.when(k % 5 == 0, role).when(k % 5 == 1, "calm").when(k % 5 == 2, F.left(text, F.lit(25))).when(k % 5 == 3, role).otherwise(F.when(t == 0, "").otherwise("ready"))
    notes = F.when((k + t) % 6 == 0, "unspecified").otherwise(F.left(text, (150 + 20 * t).cast("int")))
    commitments = F.when(k % 7 == 0, "Hereby, as per the FRAMEWORK").when(k % 7 == 1, "a paradigm of synergy to leverage").when(k % 7 == 2, "keep control").otherwise(role)
    return read(s, d, "conversations").select("conv_id", "turn", tone.alias("tone"), residue.alias("residue"), readiness.alias("readiness"), notes.alias("notes"), commitments.alias("commitments"))


_FIELDS = tuple(S.MAX_LENGTHS)


@query("governance_chain", f"""SELECT conv_id, turn, CASE WHEN {" OR ".join(f"{f} IS NULL OR {f} = ''" for f in _FIELDS)} THEN 'integrity' WHEN {_COUNT(S.MISALIGNED)} > 0 THEN 'alignment'
  WHEN {" OR ".join(f"length({f}) > {m}" for f, m in S.MAX_LENGTHS.items())} OR tone = residue AND residue = readiness AND tone NOT IN ('unspecified', 'neutral', 'calm') OR tone = 'unspecified' AND residue = 'unspecified' AND notes = 'unspecified' THEN 'coherence'
  WHEN {_COUNT(S.JARGON).replace("(t,", "(q,")} > 2 OR {_COUNT(S.FORMAL).replace("(t,", "(q,")} > 1 THEN 'plain_language' END AS failed
  FROM (SELECT *, lower(concat_ws(' ', tone, residue, notes, commitments)) AS t, lower(concat_ws(' ', notes, commitments)) AS q FROM {_ITEM})""")
def _(s, d):
    """Each turn as a memory item of five fields."""
    return _items(s, d).select("conv_id", "turn", S.governance(*map(C, _FIELDS)).alias("failed"))


# session memory: an event is an action on the item user_id % 500 of session user_id
_MEMORY = "memory AS (SELECT event_id, ts, user_id AS session_id, event_type AS protocol, value > 100 AS pinned, event_id % 9 = 0 AS deleted FROM events)"


def _memory(s, d):
    return read(s, d, "events").select("event_id", "ts", C("user_id").alias("session_id"), C("event_type").alias("protocol"), (C("value") > 100).alias("pinned"), (C("event_id") % 9 == 0).alias("deleted"))


_SCOPES = {
    "memory_scope_session": ({"scope": "session", "session": 7, "include_deleted": True, "most": 5, "newest": ["ts", "event_id"]}, "(SELECT * FROM memory WHERE session_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 5)"),
    "memory_scope_protocol": ({"scope": "protocol", "protocol": "click"}, "(SELECT * FROM memory WHERE protocol = 'click' AND NOT deleted)"),
    "memory_scope_global": ({"scope": "global", "include_deleted": True}, "(SELECT * FROM memory WHERE NOT deleted)"),
    "memory_scope_none": ({"scope": "session", "include_deleted": True}, "(SELECT * FROM memory WHERE FALSE)"),
}

for _name, (_options, _from) in _SCOPES.items():
    query(_name, f"WITH {_MEMORY} SELECT event_id, session_id FROM {_from}")(lambda s, d, o=_options: S.scoped(_memory(s, d), **o).select("event_id", "session_id"))


@query("memory_status_counts", f"WITH {_MEMORY} SELECT count(*) FILTER (NOT deleted) AS active, count(*) FILTER (deleted) AS deleted, count(*) FILTER (pinned AND NOT deleted) AS pinned FROM memory")
def _(s, d):
    return _memory(s, d).agg(F.count_if(~C("deleted")).alias("active"), F.count_if("deleted").alias("deleted"), F.count_if(C("pinned") & ~C("deleted")).alias("pinned"))


@query("memory_context", f"WITH {_MEMORY}, g AS (SELECT count(*) AS everywhere FROM memory WHERE NOT deleted), p AS (SELECT protocol, count(*) AS in_protocol FROM memory WHERE NOT deleted GROUP BY 1) SELECT session_id, m.protocol, count(*) AS in_session, any_value(in_protocol) AS in_protocol, any_value(everywhere) AS everywhere FROM memory m JOIN p ON p.protocol = m.protocol, g WHERE NOT deleted GROUP BY 1, 2")
def _(s, d):
    m = _memory(s, d).where("NOT deleted")
    by_protocol = m.groupBy("protocol").agg(n().alias("in_protocol"))
    return m.groupBy("session_id", "protocol").agg(n().alias("in_session")).join(by_protocol, "protocol").crossJoin(F.broadcast(m.agg(n().alias("everywhere")))).select("session_id", "protocol", "in_session", "in_protocol", "everywhere")


_DO = """(SELECT user_id AS item, ts, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 + (user_id % 5 = 0)::INT THEN 'capture'
  ELSE (['pin', 'unpin', 'edit', 'pin', 'edit', 'unpin', 'edit', 'merge'])[event_id % 8 + 1] END AS a0, event_id % 97 = 0 AS del,
  (['tone_label', 'commitments', 'colour'])[event_id % 3 + 1] AS field FROM events)"""
_BEFORE = "OVER (PARTITION BY item ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("memory_replay", f"""WITH a AS (SELECT *, CASE WHEN del AND a0 <> 'capture' THEN 'delete' ELSE a0 END AS a FROM {_DO}),
 t AS (SELECT *, coalesce(bool_or(a = 'capture') {_BEFORE}, FALSE) AS there FROM a),
 w AS (SELECT *, coalesce(bool_or(a = 'delete' AND there) {_BEFORE}, FALSE) AS gone,
   coalesce(last_value(CASE WHEN there AND a IN ('pin', 'unpin') THEN a = 'pin' END IGNORE NULLS) {_BEFORE}, FALSE) AS was FROM t),
 f AS (SELECT *, CASE WHEN a = 'capture' THEN NULL WHEN NOT there THEN 'not found' WHEN gone AND a = 'delete' THEN 'already deleted' WHEN gone THEN 'deleted' WHEN a = 'unpin' AND NOT was THEN 'not pinned'
   WHEN a = 'edit' AND field NOT IN ('tone_label', 'residue_label', 'readiness_state', 'integration_notes', 'commitments') THEN 'invalid field' WHEN a NOT IN ('pin', 'unpin', 'edit', 'delete') THEN 'unknown action' END AS failure FROM w)
SELECT item, coalesce(arg_max(CASE WHEN a = 'capture' THEN FALSE WHEN failure IS NULL AND a IN ('pin', 'unpin') THEN a = 'pin' ELSE was END, (ts, event_id)) FILTER (NOT gone), FALSE) AS pinned,
  count(*) FILTER (a = 'edit' AND failure IS NULL) AS edits, coalesce(bool_or(a = 'delete' AND failure IS NULL), FALSE) AS deleted, count(failure) AS failures,
  count(*) FILTER (failure = 'not pinned') AS not_pinned, arg_max(failure, (ts, event_id)) AS last_failure FROM f GROUP BY 1""")
def _(s, d):
    """The state of each item after all its actions in order, and what failed."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.element_at(F.array(*map(F.lit, ("pin", "unpin", "edit", "pin", "edit", "unpin", "edit", "merge"))), (C("event_id") % 8 + 1).cast("int"))
    field = F.element_at(F.array(*map(F.lit, ("tone_label", "commitments", "colour"))), (C("event_id") % 3 + 1).cast("int"))
    first = F.row_number().over(w) == 1 + (C("user_id") % 5 == 0).cast("int")
    e = read(s, d, "events").select(C("user_id").alias("item"), "ts", "event_id", F.when(first, "capture").when(C("event_id") % 97 == 0, "delete").otherwise(kind).alias("action"), field.alias("field"))
    done, a, ok = S.controlled(e, "item", ["ts", "event_id"]), C("action"), C("failure").isNull()
    at = F.struct("ts", "event_id")
    return done.groupBy("item").agg(
        F.max_by("pinned", at).alias("pinned"), F.count_if((a == "edit") & ok).alias("edits"), F.coalesce(F.bool_or((a == "delete") & ok), F.lit(False)).alias("deleted"), F.count("failure").alias("failures"),
        F.count_if(C("failure") == "not pinned").alias("not_pinned"), F.max_by("failure", F.when(~ok, at)).alias("last_failure"),
    )


@query("missing_requirements", "SELECT conv_id, array_to_string(list_filter([CASE WHEN NOT bool_or(role = 'system') THEN 'system' END, CASE WHEN NOT bool_or(role = 'assistant') THEN 'assistant' END, CASE WHEN count(*) < 4 THEN 'turns' END], lambda x: x IS NOT NULL), ',') AS missing FROM conversations GROUP BY 1")
def _(s, d):
    g = read(s, d, "conversations").groupBy("conv_id").agg(F.bool_or(C("role") == "system").alias("sys"), F.bool_or(C("role") == "assistant").alias("ast"), n().alias("n"))
    missing = F.filter(F.array(F.when(~C("sys"), "system"), F.when(~C("ast"), "assistant"), F.when(C("n") < 4, "turns")), lambda x: x.isNotNull())
    return g.select("conv_id", F.array_join(missing, ",").alias("missing"))


_EXIT = """(SELECT o_orderkey, CASE WHEN o_custkey % 29 = 0 THEN ' ' ELSE 's' || o_custkey END AS session_ref, CASE o_orderstatus WHEN 'P' THEN 'aborted' WHEN 'F' THEN 'left early' WHEN 'O' THEN CASE WHEN o_custkey % 2 = 0 THEN 'normal_completion' END END AS exit_reason,
  o_orderpriority <> '5-LOW' AS required, o_orderkey % 11 <> 0 AS given, o_orderkey % 7 <> 0 AS confirmed, CASE WHEN o_orderkey % 13 = 0 THEN ['summary', 'owner'] ELSE []::VARCHAR[] END AS lacking,
  CASE o_orderkey % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'comprehensive' ELSE 'plain' END AS quality, o_custkey % 3 <> 0 AS session_goals_met, o_custkey % 5 <> 0 AS integration_complete,
  o_custkey % 7 <> 0 AS commitments_recorded, o_custkey % 2 <> 0 AS reflection_done, o_custkey % 17 <> 0 AS stored FROM orders)"""
_LACKS = "list_filter([" + ", ".join(f"CASE WHEN NOT {f} THEN '{f}' END" for f in S.COMPREHENSIVE) + "], lambda x: x IS NOT NULL)"


def _exits(s, d):
    k, c = C("o_orderkey"), C("o_custkey")
    reason = F.when(C("o_orderstatus") == "P", "aborted").when(C("o_orderstatus") == "F", "left early").when((C("o_orderstatus") == "O") & (c % 2 == 0), "normal_completion")
    flags = {f: c % m != 0 for f, m in zip(S.COMPREHENSIVE, (3, 5, 7, 2))}
    lacking = F.when(k % 13 == 0, F.array(F.lit("summary"), F.lit("owner"))).otherwise(F.array().cast("array<string>"))
    quality = F.when(k % 3 == 0, "basic").when(k % 3 == 1, "comprehensive").otherwise("plain")
    ref = F.when(c % 29 == 0, " ").otherwise(F.concat(F.lit("s"), c.cast("string")))
    return read(s, d, "orders"), {"session_ref": ref, "exit_reason": reason, "required": C("o_orderpriority") != "5-LOW", "given": k % 11 != 0, "confirmed": k % 7 != 0, "lacking": lacking, "quality": quality, "stored": c % 17 != 0, **flags}


@query("exit_outcome", f"""SELECT o_orderkey, CASE WHEN trim(session_ref) = '' THEN 'invalid input' WHEN required AND NOT (given AND coalesce(exit_reason IN ('force_closed', 'aborted', 'error_condition'), FALSE)) AND c IS NOT NULL THEN c WHEN NOT stored THEN 'memory commit failed' ELSE 'closed' END AS outcome,
  CASE WHEN exit_reason IS NULL THEN 'normal_completion' WHEN exit_reason IN ('normal_completion', 'aborted', 'force_closed', 'error_condition') THEN exit_reason ELSE 'error_condition' END AS reason
FROM (SELECT *, CASE WHEN NOT given THEN 'completion confirmation required' WHEN NOT confirmed THEN 'completion not confirmed' WHEN len(lacking) > 0 THEN 'missing completion fields: ' || array_to_string(lacking, ', ')
  WHEN quality = 'basic' AND NOT session_goals_met THEN 'goals not confirmed' WHEN quality = 'comprehensive' AND len({_LACKS}) > 0 THEN 'comprehensive completion missing: ' || array_to_string({_LACKS}, ', ') END AS c FROM {_EXIT})""")
def _(s, d):
    """Each order as an exit: input, completion, diagnostics, memory, reset; some reasons bypass completion."""
    rows, p = _exits(s, d)
    return rows.select("o_orderkey", S.exit_outcome(p).alias("outcome"), S.exit_reason(p["exit_reason"]).alias("reason"))


_WALK = """(SELECT user_id, ts, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 + (user_id % 9 = 0)::INT OR event_id % 89 = 0 THEN 'start'
  ELSE (['pace', 'advance', 'pace', 'advance', 'confirm', 'advance', 'skip'])[event_id % 7 + 1] END AS action, (user_id % 4)::INT AS steps, (['NOW', 'HOLD', 'LATER', 'SOFT_HOLD', 'MAYBE'])[event_id % 5 + 1] AS pace FROM events)"""
_ERROR = """CASE WHEN x.action NOT IN ('start', 'pace', 'advance', 'confirm') THEN 'unknown action' WHEN x.action = 'start' THEN CASE WHEN x.steps <= 0 THEN 'no valid steps' END
  WHEN x.action = 'pace' AND x.pace NOT IN ('NOW', 'HOLD', 'LATER', 'SOFT_HOLD') THEN 'invalid pace' WHEN s.state = 'NONE' THEN 'no active walk'
  WHEN x.action = 'advance' THEN CASE WHEN s.state = 'COMPLETED' THEN NULL WHEN s.step >= s.n - 1 THEN 'already at last step' WHEN NOT list_contains(s.paced, s.step) THEN 'pace not set' END
  WHEN x.action = 'confirm' THEN CASE WHEN s.step < s.n - 1 THEN 'not all steps delivered' END END"""


def _walked(field: str, start: str, pace: str, advance: str, confirm: str) -> str:
    return f"CASE WHEN ({_ERROR}) IS NOT NULL THEN s.{field} WHEN x.action = 'start' THEN {start} WHEN x.action = 'pace' THEN {pace} WHEN x.action = 'confirm' THEN {confirm} WHEN s.state <> 'COMPLETED' THEN {advance} ELSE s.{field} END"


@query("walk_replay", f"""WITH l AS (SELECT user_id, list({{'action': action, 'steps': steps, 'pace': pace, 'state': '', 'step': 0, 'n': 0, 'paced': []::INT[], 'errors': 0, 'last_error': NULL::VARCHAR}} ORDER BY ts, event_id) AS acts FROM {_WALK} GROUP BY 1),
 r AS (SELECT user_id, list_reduce(list_prepend({{'action': '', 'steps': 0, 'pace': '', 'state': 'NONE', 'step': 0, 'n': 0, 'paced': []::INT[], 'errors': 0, 'last_error': NULL::VARCHAR}}, acts), lambda s, x: {{'action': '', 'steps': 0, 'pace': '',
   'state': {_walked("state", "'PENDING'", "s.state", "'IN_STEP'", "'COMPLETED'")}, 'step': {_walked("step", "0", "s.step", "s.step + 1", "s.step")}, 'n': {_walked("n", "x.steps", "s.n", "s.n", "s.n")},
   'paced': {_walked("paced", "[]::INT[]", "list_distinct(list_append(s.paced, s.step))", "s.paced", "s.paced")}, 'errors': s.errors + (({_ERROR}) IS NOT NULL)::INT, 'last_error': coalesce({_ERROR}, s.last_error)}}) AS s FROM l)
SELECT user_id, s.state AS state, s.step AS step, len(s.paced)::INT AS paced, s.errors AS errors, s.last_error AS last_error FROM r""")
def _(s, d):
    """Each user's events as the actions of a step walk."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    first = (F.row_number().over(w) == 1 + (C("user_id") % 9 == 0).cast("int")) | (C("event_id") % 89 == 0)
    kind = F.element_at(F.array(*map(F.lit, ("pace", "advance", "pace", "advance", "confirm", "advance", "skip"))), (C("event_id") % 7 + 1).cast("int"))
    pace = F.element_at(F.array(*map(F.lit, ("NOW", "HOLD", "LATER", "SOFT_HOLD", "MAYBE"))), (C("event_id") % 5 + 1).cast("int"))
    e = read(s, d, "events").select("user_id", "ts", "event_id", F.when(first, "start").otherwise(kind).alias("action"), (C("user_id") % 4).alias("steps"), pace.alias("pace"))
    return S.walk(e, "user_id", ["ts", "event_id"])
