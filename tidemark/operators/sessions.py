"""Ordered sessions: audit chains, stop rules, check chains and replays of actions."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import keyword_count

# The words and lengths of the governance checks; one formal phrase is listed twice and counts twice.
MISALIGNED = (
    "surveillance", "tracking", "monitoring", "extraction", "ownership", "possession", "control", "manipulation",
    "deception", "coercion", "pressure", "urgency",
)
JARGON = (
    "paradigm", "synergy", "leverage", "optimize", "facilitate", "methodology", "framework", "infrastructure",
    "implementation", "utilization", "maximization", "minimization",
)
FORMAL = ("pursuant to", "in accordance with", "as per", "hereby", "aforementioned", "aforementioned", "whereas", "therefore")
MAX_LENGTHS = {"tone": 50, "residue": 50, "readiness": 20, "notes": 200, "commitments": 200}
PLAIN_VALUES = ("unspecified", "neutral", "calm")
# Paces, fields of a memory item that may be edited, statuses of a step, exits that need no completion and what a comprehensive one needs.
PACES = ("NOW", "HOLD", "LATER", "SOFT_HOLD")
EDITABLE = ("tone_label", "residue_label", "readiness_state", "integration_notes", "commitments")
STEP_STATUSES = {"retry": "RETRY", "halt": "HALT", "fallback": "FALLBACK", "fail": "FAIL"}
BYPASSING = ("force_closed", "aborted", "error_condition")
EXIT_REASONS = ("normal_completion", "aborted", "force_closed", "error_condition")
COMPREHENSIVE = ("session_goals_met", "integration_complete", "commitments_recorded", "reflection_done")


def digest(*parts: Column) -> Column:
    """The first 16 hex digits of the parts' sha256, joined by |."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def hash_chain(rows: DataFrame, key: str, order: str, step: Column, genesis: str = "genesis") -> DataFrame:
    """(key, length, last): each session's chain, in which a step's hash covers the one before it.

    A chain cannot be cut, so a session is one task's; its rows are sorted, which may spill, and pass one after the other, so
    that a hash is all that is held at any length. Steps of one place go by their text, a null step adds no text, and
    a null key is a key.
    """

    def run(batches):
        present, n, last = None, 0, genesis
        made = lambda out, kind: pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], [key, "length", "last"])
        kind = None
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if present != (k,):
                    if present:
                        out.append((*present, n, last))
                    present, n, last = (k,), 0, genesis
                n, last = n + 1, hashlib.sha256((last if s is None else f"{last}|{s}").encode()).hexdigest()[:16]
            yield made(out, kind)
        if present:
            yield made([(*present, n, last)], kind)

    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("length", T.LongType()), T.StructField("last", T.StringType())])
    steps = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), step.cast("string").alias("s"))
    return steps.repartition("k").sortWithinPartitions("k", "o", "s").select("k", "s").mapInArrow(run, schema)


def until_first(rows: DataFrame, keys: list[str], order: list[str], stops: Column) -> DataFrame:
    """The rows of each key up to and with the first, by `order`, at which `stops` holds; all of a key without one. A null key
    is a key. What is joined is one place for each key, found by a minimum."""
    place = F.struct(*order)
    first = rows.where(stops).groupBy(F.struct(*keys).alias("__g")).agg(F.min(place).alias("__stop"))
    return rows.withColumn("__g", F.struct(*keys)).join(first, "__g", "left").where(F.col("__stop").isNull() | (place <= F.col("__stop"))).drop("__g", "__stop")


def first_failure(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that does not hold; null if all do."""
    found = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        found = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(found)
    return found


def planned(stages: DataFrame, name: str, place: str, subset: tuple = (), mini: bool = False, first: int = 3) -> DataFrame:
    """The stages that run: those of a subset, in their own order, whatever `mini` says; without one the first three places if mini, else all."""
    if subset:
        return stages.where(F.col(name).isin(*subset))
    return stages.where(F.col(place) < first) if mini else stages


def sequence_check(steps: DataFrame, key: str, order: str, index: str) -> DataFrame:
    """(key, missing, duplicates, ordered, valid): the places of 0 to the number of steps that no step has, those that more
    than one has, and whether the indices never fall in the steps' order. A session is one row's array."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(index).cast("int").alias("i")))), lambda x: x["i"])
    found = steps.groupBy(key).agg(listed.alias("i")).withColumn("up", F.array_sort("i"))
    twice = F.array_distinct(F.filter("up", lambda x, k: (k > 0) & (x == F.get("up", k - 1)) & (x >= 0) & (x < F.size("up"))))
    missing = F.array_except(F.sequence(F.lit(0), F.size("i") - 1), F.col("i"))
    ordered = F.col("i") == F.col("up")
    return found.select(key, missing.alias("missing"), twice.alias("duplicates"), ordered.alias("ordered")).withColumn("valid", F.col("ordered") & (F.size("missing") == 0) & (F.size("duplicates") == 0))


def walk(actions: DataFrame, key: str, order: list[str], action: str = "action", steps: str = "steps", pace: str = "pace") -> DataFrame:
    """(key, state, step, paced, errors, last_error): each session's step walk after its actions in order.

    start begins a walk of `steps` steps anew; pace records one for the present step, whichever it is; advance needs a
    recorded pace, and any will do; confirm needs the last step. What is not allowed changes nothing and counts as an
    error. state: NONE, PENDING, IN_STEP or COMPLETED. A session is one row's array.
    """
    listed = F.array_sort(F.collect_list(F.struct(*(F.col(o).alias(f"o{k}") for k, o in enumerate(order)), F.col(action).alias("action"), F.col(steps).cast("int").alias("steps"), F.col(pace).alias("pace"))))
    none = F.array().cast("array<int>")
    begin = F.struct(F.lit("NONE").alias("state"), F.lit(0).alias("step"), F.lit(0).alias("n"), none.alias("paced"), F.lit(0).alias("errors"), F.lit(None).cast("string").alias("last_error"))

    def after(s, x, error):
        done, is_ = s["state"] == "COMPLETED", lambda a: error.isNull() & (x["action"] == a)
        forward = is_("advance") & ~done
        return F.struct(
            F.when(is_("start"), "PENDING").when(is_("confirm"), "COMPLETED").when(forward, "IN_STEP").otherwise(s["state"]).alias("state"),
            F.when(is_("start"), 0).when(forward, s["step"] + 1).otherwise(s["step"]).alias("step"),
            F.when(is_("start"), x["steps"]).otherwise(s["n"]).alias("n"),
            F.when(is_("start"), none).when(is_("pace"), F.array_union(s["paced"], F.array(s["step"]))).otherwise(s["paced"]).alias("paced"),
            (s["errors"] + error.isNotNull().cast("int")).alias("errors"),
            F.coalesce(error, s["last_error"]).alias("last_error"),
        )

    def act(s, x):
        last, a = s["step"] >= s["n"] - 1, x["action"]
        error = (
            F.when(~F.coalesce(a.isin("start", "pace", "advance", "confirm"), F.lit(False)), "unknown action")
            .when(a == "start", F.when(F.coalesce(x["steps"], F.lit(0)) <= 0, "no valid steps"))
            .when((a == "pace") & ~F.coalesce(x["pace"].isin(*PACES), F.lit(False)), "invalid pace")
            .when(s["state"] == "NONE", "no active walk")
            .when(a == "advance", F.when(s["state"] == "COMPLETED", None).when(last, "already at last step").when(~F.array_contains(s["paced"], s["step"]), "pace not set"))
            .when(a == "confirm", F.when(~last, "not all steps delivered"))
        )
        return F.transform(F.array(error), lambda e: after(s, x, e))[0]

    found = actions.groupBy(key).agg(F.aggregate(listed, begin, act).alias("s"))
    return found.select(key, "s.state", "s.step", F.size("s.paced").alias("paced"), "s.errors", "s.last_error")


def controlled(actions: DataFrame, item: str, order: list[str], action: str = "action", field: str = "field") -> DataFrame:
    """actions with failure: why an action on a memory item fails, else null. And pinned: whether the item is, after it.

    An item is there from its capture on and takes no action once it is deleted; pinning a pinned item is allowed, unpinning
    one that is not pinned is not, and only EDITABLE fields are edited. What fails changes nothing.
    """
    before = W.partitionBy(item).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    a = F.col(action)
    last = F.coalesce(F.last(F.when(a.isin("pin", "unpin") & F.col("__there"), a == "pin"), ignorenulls=True).over(before), F.lit(False))
    failure = (
        F.when(a == "capture", None)
        .when(~F.col("__there"), "not found")
        .when(F.col("__gone") & (a == "delete"), "already deleted")
        .when(F.col("__gone"), "deleted")
        .when((a == "unpin") & ~F.col("__pinned"), "not pinned")
        .when((a == "edit") & ~F.coalesce(F.col(field).isin(*EDITABLE), F.lit(False)), "invalid field")
        .when(~a.isin("pin", "unpin", "edit", "delete"), "unknown action")
    )
    gone = F.coalesce(F.bool_or((a == "delete") & F.col("__there")).over(before), F.lit(False))
    there = F.coalesce(F.bool_or(a == "capture").over(before), F.lit(False))
    known = actions.withColumn("__there", there).withColumns({"__gone": gone, "__pinned": last}).withColumn("failure", failure)
    pinned = F.when(F.col("failure").isNull() & a.isin("pin", "unpin"), a == "pin").otherwise(F.col("__pinned"))
    # once an item is deleted, what it was then stays
    upto = W.partitionBy(item).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    kept = F.coalesce(F.last(F.when(~F.col("__gone"), F.col("pinned")), ignorenulls=True).over(upto), F.lit(False))
    return known.withColumn("pinned", pinned).withColumn("pinned", kept).drop("__there", "__gone", "__pinned")


def governance(tone: Column, residue: Column, readiness: Column, notes: Column, commitments: Column) -> Column:
    """The first check of the governance chain that a memory item does not pass; null if it passes all."""
    every = (tone, residue, readiness, notes, commitments)
    text = F.lower(F.concat_ws(" ", tone, residue, notes, commitments))
    plain = F.lower(F.concat_ws(" ", notes, commitments))
    same = (tone == residue) & (residue == readiness) & ~tone.isin(*PLAIN_VALUES)
    vague = (tone == "unspecified") & (residue == "unspecified") & (notes == "unspecified")
    fits = reduce(lambda a, b: a & b, (F.length(c) <= n for c, n in zip(every, MAX_LENGTHS.values())))
    return first_failure(
        ("integrity", reduce(lambda a, b: a & b, (c.isNotNull() & (c != "") for c in every))),
        ("alignment", keyword_count(text, MISALIGNED) == 0),
        ("coherence", fits & ~same & ~vague),
        ("plain_language", (keyword_count(plain, JARGON) <= 2) & (keyword_count(plain, FORMAL) <= 1)),
    )


def gate_chain(chain: tuple[str, ...], gates: dict[str, Column]) -> Column:
    """array of struct(gate, allow, reason): the gates in order up to and with the first that denies. A gate that is not known denies."""

    def decision(name: str) -> Column:
        allow = F.coalesce(gates[name], F.lit(False)) if name in gates else F.lit(False)
        reason = F.when(allow, "allowed").otherwise("denied" if name in gates else "unknown gate")
        return F.struct(F.lit(name).alias("gate"), allow.alias("allow"), reason.alias("reason"))

    every = F.array(*map(decision, chain))
    denied = F.array_position(F.transform(every, lambda x: x["allow"]), False).cast("int")
    return F.when(denied > 0, F.slice(every, 1, denied)).otherwise(every)


def grounding_gate(room: Column, score: Column, one_to_five: Column, context: Column, has_context: Column, least: float = 0.25) -> Column:
    """struct(allow, reason). The score is the payload's own, else the one from 1 to 5 of its meta, else its context's; a missing one is allowed."""
    found = F.coalesce(score, (one_to_five - 1) / 4.0, context)
    reason = F.when((room != "ai_room") & ~has_context, "nothing to evaluate").when(found.isNull(), "no score").when(found < least, "below threshold").otherwise("meets threshold")
    return F.transform(F.array(reason), lambda r: F.struct((r != "below threshold").alias("allow"), r.alias("reason")))[0]


def run_stages(steps: DataFrame, keys: list[str], order: list[str], allowed: Column, known: Column, raised: Column, fits: Column, declined: Column, stop_on_decline: bool = True, dry_run: bool = False) -> DataFrame:
    """steps with status (ok or decline) and reason: gates, then the registry, the run, its schema and its own answer; a dry
    run ends after the gates. Steps after the first that declines are not there, unless they are to go on."""
    checks = [("gate_chain_failed", allowed)]
    if not dry_run:
        checks += [("room_not_found", known), ("room_execution_failed", ~raised), ("schema_validation_failed", fits), ("room_declined", ~declined)]
    done = steps.withColumn("reason", first_failure(*checks)).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("decline"))
    return until_first(done, keys, order, F.col("status") == "decline") if stop_on_decline else done


def is_decline(output: Column) -> Column:
    """Of a map of a stage's answer: it names a reason, or what comes next is hold or later."""
    return F.map_contains_key(output, "_decline_reason") | F.coalesce(output["next_action"].isin("hold", "later"), F.lit(False))


def step_status(output: Column) -> Column:
    """HALT for a decline, else what the answer's status says, else OK."""
    named = F.element_at(F.create_map(*(F.lit(x) for pair in STEP_STATUSES.items() for x in pair)), F.coalesce(output["status"], F.lit("")))
    return F.when(is_decline(output), "HALT").otherwise(F.coalesce(named, F.lit("OK")))


def exit_outcome(p: dict[str, Column]) -> Column:
    """What ends an exit, or closed. p: session_ref, exit_reason, required, given (whether there is a payload), confirmed,
    lacking (array of required fields without a value), quality, the COMPREHENSIVE flags, and stored.

    In order: the input, the completion (which some reasons bypass), the diagnostics, the memory, the reset.
    """
    lacks = F.filter(F.array(*(F.when(~F.coalesce(p[f], F.lit(False)), f) for f in COMPREHENSIVE)), lambda x: x.isNotNull())
    completion = (
        F.when(~p["given"], "completion confirmation required")
        .when(~F.coalesce(p["confirmed"], F.lit(False)), "completion not confirmed")
        .when(F.size(p["lacking"]) > 0, F.concat(F.lit("missing completion fields: "), F.array_join(p["lacking"], ", ")))
        .when((p["quality"] == "basic") & ~F.coalesce(p["session_goals_met"], F.lit(False)), "goals not confirmed")
        .when((p["quality"] == "comprehensive") & (F.size(lacks) > 0), F.concat(F.lit("comprehensive completion missing: "), F.array_join(lacks, ", ")))
    )
    bypass = p["given"] & F.coalesce(p["exit_reason"].isin(*BYPASSING), F.lit(False))
    ended = F.when(F.coalesce(F.trim(p["session_ref"]), F.lit("")) == "", "invalid input").when(p["required"] & ~bypass, completion)
    return F.coalesce(ended, F.when(~p["stored"], "memory commit failed"), F.lit("closed"))


def exit_reason(given: Column) -> Column:
    """A reason that is not known is an error; none is a normal completion."""
    return F.when(given.isNull(), "normal_completion").when(given.isin(*EXIT_REASONS), given).otherwise("error_condition")


def envelope(room: Column, data: Column, status: Column, gates: Column, prev_hash: Column, digest: Column | None = None) -> Column:
    """struct: the v0.2 envelope of a v0.1 answer. data is canonical JSON (keys in order, no spaces) and stays as it is."""
    hashed = F.concat(F.lit("sha256:"), F.sha2(data, 256))
    none = F.lit(None).cast("struct<reason:string,message:string>")
    declined = F.struct(F.lit("gate_denied_or_room_decline").alias("reason"), F.lit("See gate_decisions and data for details").alias("message"))
    return F.struct(
        F.lit("0.2.0").alias("contract_version"), room.alias("room_id"), status.alias("status"), data.alias("data"),
        F.struct(F.lit(True).alias("deterministic"), F.lit(True).alias("no_partial_write")).alias("invariants"), gates.alias("gate_decisions"),
        (hashed if digest is None else F.coalesce(digest, hashed)).alias("diagnostics_digest"),
        F.struct(hashed.alias("step_hash"), prev_hash.alias("prev_hash"), F.lit("0.1.0").alias("room_contract_version")).alias("audit"),
        F.when(status == "decline", declined).otherwise(none).alias("decline"),
    )


def downcast(wrapped: Column) -> Column:
    """The v0.1 answer of an envelope."""
    return wrapped["data"]


def scoped(items: DataFrame, scope: str, session: object = None, protocol: object = None, include_deleted: bool = False, most: int | None = None, newest: list[str] = ()) -> DataFrame:
    """Memory items of a session, of a protocol or of all; deleted ones only where asked for, and never of all. A session or
    protocol that is not given has none. most: so many of the newest, by the columns of `newest`."""
    wanted = {"session": F.col("session_id") == F.lit(session), "protocol": F.col("protocol") == F.lit(protocol), "global": F.lit(True)}[scope]
    found = items.where(F.coalesce(wanted, F.lit(False)))
    if not include_deleted or scope == "global":
        found = found.where("NOT deleted")
    return found if most is None else found.orderBy(*(F.desc(c) for c in newest)).limit(most)
