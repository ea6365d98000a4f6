"""Walks, memory, governance, exits, mappings and validators against plain Python on small rows."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.operators import mapping, sessions, validators
from tidemark.operators.ordered import among_first, running

C = F.col


def walk_plainly(actions):
    """The rules of a step walk, one action after the other."""
    state, step, n, paced, errors, last = "NONE", 0, 0, set(), 0, None
    for action, steps, pace in actions:
        error = None
        if action not in ("start", "pace", "advance", "confirm"):
            error = "unknown action"
        elif action == "start":
            if not steps or steps <= 0:
                error = "no valid steps"
            else:
                state, step, n, paced = "PENDING", 0, steps, set()
        elif action == "pace" and pace not in sessions.PACES:
            error = "invalid pace"
        elif state == "NONE":
            error = "no active walk"
        elif action == "pace":
            paced.add(step)
        elif action == "advance" and state != "COMPLETED":
            if step >= n - 1:
                error = "already at last step"
            elif step not in paced:
                error = "pace not set"
            else:
                step, state = step + 1, "IN_STEP"
        elif action == "confirm":
            if step < n - 1:
                error = "not all steps delivered"
            else:
                state = "COMPLETED"
        errors, last = errors + (error is not None), error or last
    return state, step, len(paced), errors, last


def test_walks_equal_plain_python(spark):
    rng = random.Random(1)
    rows = {k: [(rng.choice(["start", "pace", "pace", "advance", "advance", "confirm", "jump", None]), rng.choice([0, 1, 2, 3, None]), rng.choice([*sessions.PACES, "SOON", None])) for _ in range(rng.randrange(1, 25))] for k in range(60)}
    rows[99] = [("start", 2, None), ("pace", None, "HOLD"), ("advance", None, None), ("pace", None, "LATER"), ("confirm", None, None)]
    flat = [(k, i, *a) for k, acts in rows.items() for i, a in enumerate(acts)]
    rng.shuffle(flat)
    found = sessions.walk(spark.createDataFrame(flat, "k int, i int, action string, steps int, pace string"), "k", ["i"]).collect()
    assert {r["k"]: tuple(r)[1:] for r in found} == {k: walk_plainly(a) for k, a in rows.items()}
    assert walk_plainly(rows[99])[0] == "COMPLETED"


def control_plainly(actions):
    there, gone, pinned, failures = False, False, False, []
    for action, field in actions:
        failure = None
        if action == "capture":
            there = True
        elif not there:
            failure = "not found"
        elif gone:
            failure = "already deleted" if action == "delete" else "deleted"
        elif action == "unpin" and not pinned:
            failure = "not pinned"
        elif action == "edit" and field not in sessions.EDITABLE:
            failure = "invalid field"
        elif action in ("pin", "unpin"):
            pinned = action == "pin"
        elif action == "delete":
            gone = True
        elif action != "edit":
            failure = "unknown action"
        failures.append((failure, pinned))
    return failures


def test_memory_control_equals_plain_python(spark):
    rng = random.Random(2)
    rows = {k: [("capture", None)] * (k % 9 > 0) + [(rng.choice(["pin", "unpin", "edit", "edit", "pin", "delete" if rng.random() < 0.2 else "unpin", "merge"]), rng.choice([*sessions.EDITABLE, "colour", None])) for _ in range(rng.randrange(1, 15))] for k in range(60)}
    flat = [(k, i, *a) for k, acts in rows.items() for i, a in enumerate(acts)]
    found = sessions.controlled(spark.createDataFrame(flat, "k int, i int, action string, field string"), "k", ["i"]).collect()
    got = {(r["k"], r["i"]): (r["failure"], r["pinned"]) for r in found}
    wanted = {(k, i): x for k, acts in rows.items() for i, x in enumerate(control_plainly(acts))}
    # an item is not there before its capture, so nothing of it is pinned
    assert got == wanted


def govern_plainly(tone, residue, readiness, notes, commitments):
    every = (tone, residue, readiness, notes, commitments)
    if any(x is None or x == "" for x in every):
        return "integrity"
    count = lambda words, text: sum(w in text for w in words)
    if count(sessions.MISALIGNED, " ".join((tone, residue, notes, commitments)).lower()):
        return "alignment"
    if any(len(x) > n for x, n in zip(every, sessions.MAX_LENGTHS.values())) or (tone == residue == readiness and tone not in ("unspecified", "neutral", "calm")) or (tone == residue == notes == "unspecified"):
        return "coherence"
    plain = f"{notes} {commitments}".lower()
    return "plain_language" if count(sessions.JARGON, plain) > 2 or count(sessions.FORMAL, plain) > 1 else None


def test_governance_equals_plain_python(spark):
    rng = random.Random(3)
    short = [None, "", "unspecified", "calm", "warm", "Tracking", "x" * 51, "neutral"]
    long = [*short, "Hereby we begin", "the aforementioned", "paradigm, synergy and leverage", "y" * 201]
    rows = [(i, *(rng.choice(short[2:] if rng.random() < 0.9 else short) for _ in range(3)), *(rng.choice(long[2:] if rng.random() < 0.9 else long) for _ in range(2))) for i in range(600)]
    names = ("tone", "residue", "readiness", "notes", "commitments")
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in names))
    got = {r["i"]: r["f"] for r in df.select("i", sessions.governance(*map(C, names)).alias("f")).collect()}
    assert got == {r[0]: govern_plainly(*r[1:]) for r in rows} and set(got.values()) == {None, "integrity", "alignment", "coherence", "plain_language"}


def test_sequences_equal_plain_python(spark):
    rng = random.Random(4)
    rows = {k: [rng.randrange(-1, n + 1) for _ in range(n)] if rng.random() < 0.7 else list(range(n)) for k, n in ((k, rng.randrange(1, 8)) for k in range(50))}
    df = spark.createDataFrame([(k, i, x) for k, xs in rows.items() for i, x in enumerate(xs)], "k int, o int, x int")
    for r in sessions.sequence_check(df, "k", "o", "x").collect():
        xs = rows[r["k"]]
        places = range(len(xs))
        assert (r["missing"], r["duplicates"], r["ordered"]) == ([p for p in places if p not in xs], [p for p in places if xs.count(p) > 1], xs == sorted(xs))
        assert r["valid"] == (xs == list(places))


def test_a_subset_wins_over_the_mini_walk(spark):
    stages = spark.createDataFrame([(n, i) for i, n in enumerate("abcde")], "name string, place int")
    names = lambda df: [r["name"] for r in df.orderBy("place").collect()]
    assert names(sessions.planned(stages, "name", "place", ("e", "a"), mini=True)) == ["a", "e"]
    assert names(sessions.planned(stages, "name", "place", mini=True)) == ["a", "b", "c"] and names(sessions.planned(stages, "name", "place")) == list("abcde")


def test_gates_statuses_and_envelopes(spark):
    df = spark.createDataFrame([(1, True, False), (2, False, True), (3, None, True)], "i int, a boolean, b boolean")
    chain = sessions.gate_chain(("a", "absent", "b"), {"a": C("a"), "b": C("b")})
    got = {r["i"]: [(x["gate"], x["allow"], x["reason"]) for x in r["g"]] for r in df.select("i", chain.alias("g")).collect()}
    assert got == {1: [("a", True, "allowed"), ("absent", False, "unknown gate")], 2: [("a", False, "denied")], 3: [("a", False, "denied")]}
    answers = [({"status": "retry"}, "RETRY"), ({"status": "fail"}, "FAIL"), ({}, "OK"), ({"status": "other"}, "OK"), ({"status": "retry", "next_action": "hold"}, "HALT"), ({"_decline_reason": "x"}, "HALT"), ({"next_action": "continue", "status": "fallback"}, "FALLBACK")]
    table = spark.createDataFrame([(a, s) for a, s in answers], "m map<string,string>, s string")
    assert all(r["s"] == r["got"] for r in table.select("s", sessions.step_status(C("m")).alias("got")).collect())
    e = spark.createDataFrame([('{"a":1}', "decline")], "d string, s string").select(sessions.envelope(F.lit("r"), C("d"), C("s"), F.array(), F.lit(None).cast("string")).alias("e")).select("e.*", sessions.downcast(C("e")).alias("back")).first()
    assert e["back"] == '{"a":1}' and e["audit"]["step_hash"] == e["diagnostics_digest"] == "sha256:" + "015abd7f5cc57a2dd94b7590f04ad8084273905ee33ec5cebeae62276a97f862" and e["decline"]["reason"] == "gate_denied_or_room_decline"


def test_runs_stop_or_go_on(spark):
    rows = [(1, 0, True, True, False, True, False), (1, 1, True, False, False, True, False), (1, 2, False, True, False, True, False), (2, 0, True, True, False, True, True), (2, 1, True, True, True, True, False), (2, 2, True, True, False, False, False)]
    df = spark.createDataFrame(rows, "k int, i int, allowed boolean, known boolean, raised boolean, fits boolean, declined boolean")
    run = lambda **o: [(r["k"], r["i"], r["reason"]) for r in sessions.run_stages(df, ["k"], ["i"], C("allowed"), C("known"), C("raised"), C("fits"), C("declined"), **o).orderBy("k", "i").collect()]
    assert run() == [(1, 0, None), (1, 1, "room_not_found"), (2, 0, "room_declined")]
    assert run(stop_on_decline=False) == [(1, 0, None), (1, 1, "room_not_found"), (1, 2, "gate_chain_failed"), (2, 0, "room_declined"), (2, 1, "room_execution_failed"), (2, 2, "schema_validation_failed")]
    assert run(dry_run=True) == [(1, 0, None), (1, 1, None), (1, 2, "gate_chain_failed"), (2, 0, None), (2, 1, None), (2, 2, None)]


def map_plainly(label, registry, default):
    if label is None:
        return default
    low = label.lower().strip()
    for a, b in registry:
        if a.lower() == low:
            return b
    return next((b for a, b in registry if low in a.lower() or a.lower() in low), default)


def test_mappings_equal_plain_python(spark):
    registry = (("stress", "a"), ("Team Conflict", "b"), ("conflict", "c"), ("stuck", "d"))
    labels = ["Stress", " conflict ", "a conflict of teams", "team", "distress", "", "unknown", None, "STUCK here", "Team Conflict", "t"]
    df = spark.createDataFrame(list(enumerate(labels)), "i int, x string")
    got = {r["i"]: r["t"] for r in df.select("i", mapping.priority_match(C("x"), registry, "z").alias("t")).collect()}
    assert got == {i: map_plainly(x, registry, "z") for i, x in enumerate(labels)}
    with pytest.raises(ValueError):
        mapping.priority_match(C("x"), (("a", "b"),) * (mapping.MAX_ENTRIES + 1), "z")


@pytest.mark.parametrize("blank", [True, False])
def test_first_substrings_equal_plain_python(spark, blank):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abC é") for _ in range(rng.randrange(1, 7)))
    left, right = [word() for _ in range(80)] + ["", None], [word() for _ in range(25)] + ([""] if blank else []) + [None]
    found = mapping.first_substring(spark.createDataFrame(list(enumerate(left)), "i int, x string"), "i", C("x"), spark.createDataFrame(list(enumerate(right)), "o int, y string"), "o", "y")
    wanted = {}
    for i, x in enumerate(left):
        hits = [o for o, y in enumerate(right) if x is not None and y is not None and (x.lower() in y.lower() or y.lower() in x.lower())]
        if hits:
            wanted[i] = hits[0]
    assert {r["i"]: r["o"] for r in found.collect()} == wanted


def test_commitments_and_answers(spark):
    kind = "array<struct<text:string,context:string,pace_state:string,session_ref:string>>"
    cases = [(None, "commitments are required"), ([], "at least one commitment is required"), ([("do it", "work", "NOW", "s")], None), ([("do it", "work", "NOW", "s"), ("  x ", "work", "NOW", "s")], "invalid commitment at index 1: text below 3 characters"), ([("abc", "w", "NOW", "s")], "invalid commitment at index 0: context below 2 characters"), ([("abc", "ww", "SOON", "s")], "invalid commitment at index 0: invalid pace_state"), ([("abc", "ww", "NOW", "")], "invalid commitment at index 0: empty session_ref"), ([("abc", None, "NOW", "s")], "invalid commitment at index 0: missing required fields")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], f"i int, c {kind}")
    assert {r["i"]: r["w"] for r in df.select("i", validators.commitments_decline(C("c")).alias("w")).collect()} == {i: w for i, (_, w) in enumerate(cases)}
    texts = [("We trust slowly", True, (True, None)), ("nothing here", True, (False, "must_reference_stone_meaning")), ("nothing here", False, (True, None)), ("a quick fix, with trust", False, (False, None))]
    df = spark.createDataFrame([(i, t, q) for i, (t, q, _) in enumerate(texts)], "i int, t string, q boolean")
    got = df.select("i", validators.semantic(C("t"), ("trust grows",), ("quick win",), C("q")).alias("r")).select("i", "r.*").collect()
    assert {r["i"]: (r["passed"], r["failed_assertion"]) for r in got} == {i: w for i, (_, _, w) in enumerate(texts)}


def test_exits(spark):
    base = {"session_ref": "s", "exit_reason": None, "required": True, "given": True, "confirmed": True, "lacking": [], "quality": "basic", "stored": True, "session_goals_met": True, "integration_complete": True, "commitments_recorded": True, "reflection_done": True}
    cases = [({}, "closed"), ({"session_ref": "  "}, "invalid input"), ({"given": False}, "completion confirmation required"), ({"confirmed": False}, "completion not confirmed"), ({"confirmed": False, "exit_reason": "aborted"}, "closed"), ({"confirmed": False, "required": False}, "closed"), ({"lacking": ["a", "b"]}, "missing completion fields: a, b"), ({"session_goals_met": False}, "goals not confirmed"), ({"quality": "comprehensive", "reflection_done": False, "integration_complete": None}, "comprehensive completion missing: integration_complete, reflection_done"), ({"stored": False}, "memory commit failed"), ({"quality": "other", "session_goals_met": False}, "closed")]
    kinds = "session_ref string, exit_reason string, required boolean, given boolean, confirmed boolean, lacking array<string>, quality string, stored boolean, session_goals_met boolean, integration_complete boolean, commitments_recorded boolean, reflection_done boolean"
    df = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(cases)], f"i int, {kinds}")
    assert {r["i"]: r["o"] for r in df.select("i", sessions.exit_outcome({k: C(k) for k in base}).alias("o")).collect()} == {i: w for i, (_, w) in enumerate(cases)}


def test_running_first_and_stop_against_lists(spark):
    """A hot key, a null key, ties of keys and an empty table; ranges are more than keys."""
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice([None, 1, 2, 3])) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    total, before, early, kept = {}, {}, {}, set()
    for k in {r[0] for r in rows}:
        own, stopped = sorted((r for r in rows if r[0] == k), key=lambda r: r[1]), False
        for at, (_, i, v) in enumerate(own):
            total[i], before[i], early[i] = sum(x[2] or 0 for x in own[:at]), own[at - 1][2] if at else None, at < 4
            if not stopped:
                kept.add(i)
            stopped = stopped or (v == 3 and i % 5 == 0)
    found = {r["i"]: r for r in running(df, ["k"], ["i"], {"total": F.col("v")}, {"before": F.col("v")}).collect()}
    assert {i: r["total"] for i, r in found.items()} == total and {i: r["before"] for i, r in found.items()} == before
    assert {r["i"]: r["first"] for r in among_first(df, ["k"], ["i"], 4, "first").collect()} == early
    assert {r["i"] for r in sessions.until_first(df, ["k"], ["i"], (F.col("v") == 3) & (F.col("i") % 5 == 0)).collect()} == kept
    none = df.limit(0)
    assert running(none, ["k"], ["i"], {"total": F.col("v")}).columns == ["k", "i", "v", "total"]
    assert running(none, ["k"], ["i"], {"total": F.col("v")}).count() == among_first(none, ["k"], ["i"], 4, "first").count() == 0


def test_running_sums_of_doubles_do_not_depend_on_borders_of_ranges(spark):
    values = [round(random.Random(k).uniform(0, 120), 2) for k in range(60)]
    names = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(3).withColumn("k", F.lit(1))
        dealt = df.repartitionByRange("k", "i").select(F.spark_partition_id().alias("p")).distinct().count()
        found = {r["i"]: r["used"] for r in running(df, ["k"], ["i"], {"used": F.col("v")}).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert dealt == 2
    used = 0.0
    for i, v in enumerate(values):
        assert found[i] == used
        used += v


def test_snapshots_hold_all_events_of_a_kind(spark, tmp_path):
    rows = [(1, "click", 5.0), (1, "purchase", 500.0), (2, "click", 5.0), (3, "purchase", 5.0), (4, "purchase", 500.0), (5, "view", 500.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(map(tuple, catalogue.queries()["snapshot_diff"](spark, str(tmp_path)).collect())) == [(2, "removed"), (3, "added"), (4, "added")]


def test_chains_of_hashes_against_hashlib(spark):
    """Null keys and steps, steps of one place, a session that is most of the rows, more batches than one, and an empty table."""
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.randrange(400), rng.choice(["", "é", "a|b", None, "x"])) for _ in range(900)]
    df = spark.createDataFrame(rows, "k long, o int, s string").repartition(5)
    want = {}
    for k in {r[0] for r in rows}:
        last, own = "genesis", sorted(((o, s is not None, s or "") for key, o, s in rows if key == k))
        for _, there, s in own:
            last = hashlib.sha256(f"{last}|{s}".encode() if there else last.encode()).hexdigest()[:16]
        want[k] = (len(own), last)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = sessions.hash_chain(df, "k", "o", C("s")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["k"]: (r["length"], r["last"]) for r in found} == want and len(found) == len(want)
    assert sessions.hash_chain(df.limit(0), "k", "o", C("s")).count() == 0
