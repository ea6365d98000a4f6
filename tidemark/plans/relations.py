"""Queries of validation, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import mapping as M
from tidemark.operators import sessions as S
from tidemark.operators import validators as V
from tidemark.registry import query, read

C = F.col


def n():
    return F.count(F.lit(1))


def errors(*checks):
    """array of the messages of the checks (condition, message) that fail."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), message) for ok, message in checks)), lambda e: e.isNotNull())


def _checks():
    return ((F.length("text") >= 20, "text too short"), (C("lang").isin("en", "de", "fr"), "unknown lang"), (C("n_chars") <= 10000, "text too long"), (C("source").rlike("^src[0-9]$"), "unknown source"))


_ERRORS = "list_filter([CASE WHEN NOT length(text) >= 20 THEN 'text too short' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unknown lang' END, CASE WHEN n_chars > 10000 THEN 'text too long' END, CASE WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'unknown source' END], lambda e: e IS NOT NULL)"


@query("validate_collect_errors", f"SELECT doc_id, array_to_string({_ERRORS}, '; ') AS errors, len({_ERRORS}) = 0 AS valid FROM documents")
def _(s, d):
    return read(s, d, "documents").withColumn("e", errors(*_checks())).select("doc_id", F.array_join("e", "; ").alias("errors"), (F.size("e") == 0).alias("valid"))


@query("validate_first_error", f"SELECT doc_id, list_sort({_ERRORS})[1] AS error FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.get(F.array_sort(errors(*_checks())), F.lit(0)).alias("error"))


@query("validation_summary", f"SELECT lang, count(*) AS checked, count(*) FILTER (n = 0) AS valid, count(*) FILTER (n > 0) AS invalid, sum(n)::BIGINT AS errors FROM (SELECT lang, len({_ERRORS}) AS n FROM documents) GROUP BY 1")
def _(s, d):
    e = read(s, d, "documents").select("lang", F.size(errors(*_checks())).cast("long").alias("n"))
    return e.groupBy("lang").agg(n().alias("checked"), F.count_if(C("n") == 0).alias("valid"), F.count_if(C("n") > 0).alias("invalid"), F.sum("n").alias("errors"))


@query("quarantine_split", f"SELECT CASE WHEN len({_ERRORS}) = 0 THEN 'accepted' ELSE 'quarantine' END AS route, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    """Bad rows go aside with their errors; the batch goes on."""
    rows = read(s, d, "documents").withColumn("errors", errors(*_checks()))
    good, bad = rows.where(F.size("errors") == 0), rows.where(F.size("errors") > 0)
    return good.select(F.lit("accepted").alias("route")).unionByName(bad.select(F.lit("quarantine").alias("route"))).groupBy("route").agg(n().alias("n"))


@query("fullouter_orphans", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey WHERE c_custkey IS NULL OR o_orderkey IS NULL")
def _(s, d):
    """Customers in credit without a finished order, and finished orders without such a customer."""
    c, o = read(s, d, "customer").where("c_acctbal > 0"), read(s, d, "orders").where("o_orderstatus = 'F'")
    return c.join(o, C("c_custkey") == C("o_custkey"), "full_outer").where("c_custkey IS NULL OR o_orderkey IS NULL").select("c_custkey", "o_orderkey")


@query("anti_unknown_refs", "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT 'src' || r FROM range(0, 10) t(r))")
def _(s, d):
    known = s.range(10).select(F.concat(F.lit("src"), C("id").cast("string")).alias("source"))
    return read(s, d, "documents").join(known, "source", "left_anti").select("doc_id", "source")


@query("registry_dependencies", "SELECT n_name, array_to_string(list_sort(list(DISTINCT need)), ',') AS missing FROM (SELECT n_name, unnest(['gate' || n_regionkey, 'gate' || (n_regionkey + 2), 'gate' || (n_nationkey % 7)]) AS need FROM nation) WHERE need NOT IN (SELECT 'gate' || r_regionkey FROM region) GROUP BY 1")
def _(s, d):
    """Nations as contracts that depend on gates, of which each region is one."""
    gate = lambda c: F.concat(F.lit("gate"), c.cast("string"))
    contracts = read(s, d, "nation").select("n_name", F.array(gate(C("n_regionkey")), gate(C("n_regionkey") + 2), gate(C("n_nationkey") % 7)).alias("needs"))
    found = V.missing_dependencies(contracts, read(s, d, "region").select(gate(C("r_regionkey")).alias("gate")), "n_name", "needs", "gate")
    return found.select("n_name", F.array_join("missing", ",").alias("missing"))


@query("version_groups", "SELECT p_brand, count(*) AS n, array_to_string(list_sort(list(p_partkey))[1:3], ',') AS first_three, count(DISTINCT p_size) > 1 AS inconsistent FROM part GROUP BY 1")
def _(s, d):
    p = read(s, d, "part")
    nth = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    first = p.withColumn("nth", nth).where("nth <= 3").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",").alias("first_three"))
    return p.groupBy("p_brand").agg(n().alias("n"), (F.countDistinct("p_size") > 1).alias("inconsistent")).join(first, "p_brand").select("p_brand", "n", "first_three", "inconsistent")


_PROMPTS = """(SELECT c_custkey AS query_id, CASE WHEN c_custkey % 19 <> 0 THEN c_name END AS prompt, CASE WHEN c_custkey % 13 = 0 THEN 'NATION_99' WHEN c_custkey % 17 <> 0 THEN 'NATION_' || c_nationkey END AS stone,
  CASE WHEN c_custkey % 23 <> 0 THEN ' region ' || (CASE WHEN c_custkey % 4 = 0 THEN c_nationkey % 3 ELSE r END) END AS stone_meaning, c_mktsegment AS field, CASE WHEN c_custkey % 29 <> 0 THEN 'easy' END AS difficulty FROM customer, (SELECT n_nationkey, n_regionkey AS r FROM nation) n WHERE n_nationkey = c_nationkey)"""
_MISSING = ", ".join(f"CASE WHEN {f} IS NULL THEN 'missing {f}' END" for f in V.PROMPT_FIELDS if f != "assertions")


@query("validate_lookup_mismatch", f"""SELECT query_id, array_to_string(list_filter([{_MISSING}, CASE WHEN stone IS NOT NULL AND n_name IS NULL THEN 'unknown stone ' || stone END,
  CASE WHEN n_name IS NOT NULL AND trim(stone_meaning) <> 'region ' || n_regionkey THEN 'meaning mismatch for ' || stone END], lambda x: x IS NOT NULL), '; ') AS errors FROM {_PROMPTS} p LEFT JOIN nation ON n_name = stone""")
def _(s, d):
    """Each customer as a prompt of a nation, whose meaning is its region."""
    k = C("c_custkey")
    nation = read(s, d, "nation")
    c = read(s, d, "customer").join(nation, C("c_nationkey") == C("n_nationkey"))
    region = F.when(k % 4 == 0, C("c_nationkey") % 3).otherwise(C("n_regionkey"))
    prompts = c.select(
        k.alias("query_id"), F.when(k % 19 != 0, C("c_name")).alias("prompt"), F.when(k % 13 == 0, "NATION_99").when(k % 17 != 0, F.concat(F.lit("NATION_"), C("c_nationkey").cast("string"))).alias("stone"),
        F.when(k % 23 != 0, F.concat(F.lit(" region "), region.cast("string"))).alias("stone_meaning"), C("c_mktsegment").alias("field"), F.when(k % 29 != 0, "easy").alias("difficulty"), F.lit("x").alias("assertions"),
    )
    registry = nation.select(C("n_name").alias("slug"), F.concat(F.lit("region "), C("n_regionkey").cast("string")).alias("meaning"))
    return V.prompt_errors(prompts, registry).select("query_id", F.array_join("errors", "; ").alias("errors"))


_PACE = "(['NOW', 'HOLD', 'LATER', 'SOFT_HOLD', 'SOON'])[(conv_id + turn + {i}) % 5 + 1]"


def _why(i: int) -> str:
    """SQL: the first rule that commitment i of a turn does not meet."""
    text, context, pace = f"CASE WHEN turn % 9 <> {8 - i} THEN left(text, (turn + {i})::INT) END", f"CASE WHEN conv_id % 9 = {i} THEN 'x' ELSE role END", _PACE.format(i=i)
    ref = f"CASE WHEN conv_id % 8 = {i} THEN '' ELSE 's' || conv_id END"
    return f"CASE WHEN {text} IS NULL THEN 'missing required fields' WHEN length(trim({text})) < 3 THEN 'text below 3 characters' WHEN length(trim({context})) < 2 THEN 'context below 2 characters' WHEN {pace} NOT IN ('NOW', 'HOLD', 'LATER', 'SOFT_HOLD') THEN 'invalid pace_state' WHEN {ref} = '' THEN 'empty session_ref' END"


_HOLDS = lambda c: " OR ".join(f"contains(lower({c}), '{w}')" for w in V.PLACEHOLDERS)


@query("decline_reason_commit", f"""SELECT conv_id, turn, CASE WHEN coalesce(notes, '') = '' OR coalesce(context, '') = '' THEN 'missing integration fields' WHEN length(trim(notes)) < 10 THEN 'notes too brief' WHEN length(trim(context)) < 5 THEN 'context too brief'
  WHEN {_HOLDS("notes")} THEN 'notes are a placeholder' WHEN {_HOLDS("context")} THEN 'context is a placeholder' END AS integration,
  CASE conv_id % 10 WHEN 0 THEN 'at least one commitment is required' WHEN 1 THEN 'commitments are required' ELSE coalesce('invalid commitment at index 0: ' || {_why(0)}, 'invalid commitment at index 1: ' || {_why(1)}) END AS commitments
FROM (SELECT *, CASE turn % 6 WHEN 0 THEN left(text, 12) WHEN 1 THEN 'To Be Filled in' WHEN 2 THEN text WHEN 3 THEN NULL ELSE left(text, 9) || ' ' || text END AS notes, CASE conv_id % 6 WHEN 0 THEN 'abcd ' WHEN 1 THEN 'N/A so far' ELSE 'with ' || role END AS context FROM conversations)""")
def _(s, d):
    """Each turn as the integration and the commitments of a session."""
    k, t, text, role = C("conv_id"), C("turn"), C("text"), C("role")
    notes = F.when(t % 6 == 0, F.left(text, F.lit(12))).when(t % 6 == 1, "To Be Filled in").when(t % 6 == 2, text).when(t % 6 == 3, None).otherwise(F.concat(F.left(text, F.lit(9)), F.lit(" "), text))
    context = F.when(k % 6 == 0, "abcd ").when(k % 6 == 1, "N/A so far").otherwise(F.concat(F.lit("with "), role))

    def one(i):
        return F.struct(
            F.when(t % 9 != 8 - i, F.left(text, (t + i).cast("int"))).alias("text"), F.when(k % 9 == i, "x").otherwise(role).alias("context"),
            F.element_at(F.array(*map(F.lit, ("NOW", "HOLD", "LATER", "SOFT_HOLD", "SOON"))), ((k + t + i) % 5 + 1).cast("int")).alias("pace_state"), F.when(k % 8 == i, "").otherwise(F.concat(F.lit("s"), k.cast("string"))).alias("session_ref"),
        )

    both = F.array(one(0), one(1))
    commitments = F.when(k % 10 == 0, F.slice(both, 1, 0)).when(k % 10 != 1, both)
    return read(s, d, "conversations").select("conv_id", "turn", V.integration_decline(notes, context).alias("integration"), V.commitments_decline(commitments).alias("commitments"))


@query("decline_reason_exit", """SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'missing session ID' WHEN o_orderstatus = 'P' THEN 'missing exit reason' WHEN o_totalprice < 1000 THEN 'missing diagnostics' WHEN o_orderkey % 5 = 0 THEN 'diagnostics not captured' END AS memory,
  CASE WHEN o_custkey % 5 = 0 THEN 'session still active' WHEN o_orderkey % 4 > 2 THEN 'buffers not cleared' WHEN o_orderkey % 6 > 4 THEN 'data not cleared' WHEN o_orderstatus = 'F' THEN 'reset flag not set' END AS reset FROM orders""")
def _(s, d):
    """Each order as what an exit commits to memory, and as the session after its reset."""
    k, c = C("o_orderkey"), C("o_custkey")
    memory = V.memory_commit_decline(F.when(c % 7 != 0, c.cast("string")), F.when(C("o_orderstatus") != "P", "aborted").otherwise(""), C("o_totalprice") >= 1000, k % 5 != 0)
    reset = V.reset_decline(c % 5 == 0, F.greatest(k % 4 - 2, F.lit(0)), F.greatest(k % 6 - 4, F.lit(0)), C("o_orderstatus") != "F")
    return read(s, d, "orders").select("o_orderkey", memory.alias("memory"), reset.alias("reset"))


_STEP_INDEX = "(CASE conv_id % 4 WHEN 0 THEN turn WHEN 1 THEN CASE WHEN turn = 2 THEN 1 ELSE turn END WHEN 2 THEN CASE WHEN turn >= 1 THEN turn + 1 ELSE turn END ELSE count(*) OVER (PARTITION BY conv_id) - 1 - turn END)::INT"


@query("sequence_integrity", f"""WITH l AS (SELECT conv_id, list(i ORDER BY turn) AS i FROM (SELECT conv_id, turn, {_STEP_INDEX} AS i FROM conversations) GROUP BY 1)
SELECT conv_id, array_to_string(list_filter(range(len(i)), lambda p: NOT list_contains(i, p)), ',') AS missing, array_to_string(list_filter(range(len(i)), lambda p: len(list_filter(i, lambda x: x = p)) > 1), ',') AS duplicates,
  i = list_sort(i) AS ordered, i = range(len(i)) AS valid FROM l""")
def _(s, d):
    """The turns as steps, of which some conversations have a place twice, skip one or go backwards."""
    t, k = C("turn"), C("conv_id") % 4
    size = n().over(W.partitionBy("conv_id"))
    index = F.when(k == 0, t).when(k == 1, F.when(t == 2, 1).otherwise(t)).when(k == 2, F.when(t >= 1, t + 1).otherwise(t)).otherwise(size - 1 - t)
    found = S.sequence_check(read(s, d, "conversations").withColumn("i", index), "conv_id", "turn", "i")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("conv_id", joined("missing"), joined("duplicates"), "ordered", "valid")


#: A document as a nested one: its lines are themes, and their lengths say what is lacking.
_NESTED = """(SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:8] AS l,
  CASE doc_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['clarity-over-cleverness'] WHEN 2 THEN ['the-speed-of-trust', 'clarity-over-cleverness'] ELSE ['the-speed-of-trust', 'clarity-over-cleverness', 'presence'] END AS tags,
  lower(text || CASE doc_id % 3 WHEN 0 THEN ' trust and care' WHEN 1 THEN ' Pressure, urgency, DEMAND, confusion' ELSE '' END) AS whole FROM documents)"""
_NAME = "CASE WHEN length(l[i + 1]) % 10 = 0 THEN 'Theme ' || (i + 1) ELSE split_part(l[i + 1], ' ', 1) END"
_LACKING = "list_filter([" + ", ".join(f"CASE WHEN (length(l[i + 1]) + {j}) % 17 = 0 THEN '{x}' END" for j, x in enumerate(V.LEVELS)) + "], lambda x: x IS NOT NULL)"
_SHALLOW = ", ".join(f"CASE WHEN (length(l[i + 1]) + {j}) % 17 <> 0 AND (length(l[i + 1]) + {13 * j}) % 200 < 28 THEN 'theme ' || (i + 1) || ': {x} outcome too shallow' END" for j, x in enumerate(V.LEVELS))
_THEMES = f"""flatten(list_transform(range(len(l)), lambda i: list_filter([CASE WHEN {_NAME} IN ('', 'Theme ' || (i + 1)) THEN 'theme ' || (i + 1) || ': missing or generic name' END,
  CASE WHEN length(l[i + 1]) % 5 + 2 < 3 THEN 'theme ' || (i + 1) || ': too few questions' END, CASE WHEN length(l[i + 1]) % 5 + 2 > 5 THEN 'theme ' || (i + 1) || ': too many questions' END,
  CASE WHEN len({_LACKING}) > 0 THEN 'theme ' || (i + 1) || ': missing outcomes ' || array_to_string({_LACKING}, ', ') END, {_SHALLOW}], lambda x: x IS NOT NULL)))"""
_COHERENT = f"""list_filter([CASE WHEN doc_id % 10 = 0 THEN 'missing Title' END, CASE WHEN len(l) = 0 THEN 'no themes' WHEN len(l) < 5 THEN 'too few themes' WHEN len(l) > 7 THEN 'too many themes' END], lambda x: x IS NOT NULL) || {_THEMES} ||
  list_filter([CASE WHEN len(list_distinct(list_transform(range(len(l)), lambda i: {_NAME}))) < len(l) THEN 'duplicate theme names' END, CASE doc_id % 8 WHEN 0 THEN 'no prompts' WHEN 1 THEN 'too few prompts' WHEN 6 THEN 'too many prompts' WHEN 7 THEN 'too many prompts' END], lambda x: x IS NOT NULL)"""
_COUNTED = lambda words: " + ".join(f"contains(whole, '{w}')::INT" for w in words)
_ALIGNED = f"""CASE WHEN len(tags) = 0 THEN ['no tags'] ELSE list_filter([CASE WHEN len(tags) < 2 THEN 'too few tags' END, CASE WHEN NOT list_contains(tags, 'the-speed-of-trust') THEN 'missing tags: the-speed-of-trust' END,
  CASE WHEN {_COUNTED(V.MISALIGNED_WORDS)} > {_COUNTED(V.INTEGRITY_WORDS)} THEN ({_COUNTED(V.MISALIGNED_WORDS)}) || ' negative indicators vs ' || ({_COUNTED(V.INTEGRITY_WORDS)}) || ' positive' END], lambda x: x IS NOT NULL) END"""


def _nested(s, d):
    k, size = C("doc_id"), lambda x: F.length(x)
    lines = F.slice(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), 1, 8)

    def theme(x, i):
        name = F.when(size(x) % 10 == 0, F.concat(F.lit("Theme "), (i + 1).cast("string"))).otherwise(F.split_part(x, F.lit(" "), F.lit(1)))
        outcome = lambda j: F.when((size(x) + j) % 17 != 0, F.struct(F.repeat(F.lit("x"), (size(x) + 13 * j) % 200).alias("Present pattern")))
        return F.struct(name.alias("Name"), F.array_repeat(F.lit("?"), size(x) % 5 + 2).alias("Guiding Questions"), F.struct(*(outcome(j).alias(level) for j, level in enumerate(V.LEVELS))).alias("Outcomes"))

    both = F.array(*map(F.lit, V.REQUIRED_TAGS))
    tags = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.slice(both, 2, 1)).when(k % 4 == 2, both).otherwise(F.concat(both, F.array(F.lit("presence"))))
    more = F.when(k % 3 == 0, " trust and care").when(k % 3 == 1, " Pressure, urgency, DEMAND, confusion").otherwise("")
    return read(s, d, "documents").select(
        "doc_id", F.when(k % 10 != 0, "t").alias("Title"), F.lit("p").alias("Overall Purpose"), F.lit("w").alias("When To Use This Protocol"), F.transform(lines, theme).alias("Themes"),
        F.array_repeat(F.lit("p"), (k % 8).cast("int")).alias("Completion Prompts"), tags.alias("tags"), F.concat("text", more).alias("whole"),
    )


@query("coherence_checks", f"SELECT doc_id, array_to_string({_COHERENT}, '; ') AS reasons FROM {_NESTED}")
def _(s, d):
    """All reasons why a nested document is not coherent."""
    return _nested(s, d).select("doc_id", F.array_join(V.coherence_reasons(), "; ").alias("reasons"))


@query("integrity_gate", f"SELECT doc_id, len(a) = 0 AS aligned, len(c) = 0 AS coherent, len(a) = 0 AND len(c) = 0 AS passed, array_to_string(a, '; ') AS reasons FROM (SELECT doc_id, {_ALIGNED} AS a, {_COHERENT} AS c FROM {_NESTED})")
def _(s, d):
    """Its tags and words, and its coherence."""
    x = _nested(s, d).select("doc_id", V.alignment_reasons(C("tags"), C("whole")).alias("a"), V.coherence_reasons().alias("c"))
    return x.select("doc_id", (F.size("a") == 0).alias("aligned"), (F.size("c") == 0).alias("coherent"), ((F.size("a") == 0) & (F.size("c") == 0)).alias("passed"), F.array_join("a", "; ").alias("reasons"))


@query("filter_valid_names", "SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '\\.html$') AND NOT regexp_matches(lower(url), 'template|schema|locked')")
def _(s, d):
    u = F.lower("url")
    return read(s, d, "pages").where(u.rlike("\\.html$") & ~u.rlike("template|schema|locked")).select("page_id", "url")


# Blocked paths; a pattern counts at the start of the path only.
BLOCKED = ("^\\.vector/", "\\.faiss$", "\\.index$", "https://spam")


@query("blocklist_match", "SELECT page_id, regexp_matches(url, '^(?:^\\.vector/|\\.faiss$|\\.index$|https://spam)') AS blocked FROM pages")
def _(s, d):
    return read(s, d, "pages").select("page_id", C("url").rlike("^(?:" + "|".join(BLOCKED) + ")").alias("blocked"))


@query("capture_defaults", "SELECT event_id, coalesce(nullif(CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN event_type END, ''), 'unspecified') AS tone FROM events")
def _(s, d):
    raw = F.when(C("user_id") % 3 == 0, "").when(C("user_id") % 3 == 1, C("event_type"))
    return read(s, d, "events").select("event_id", F.coalesce(F.nullif(raw, F.lit("")), F.lit("unspecified")).alias("tone"))


@query("dispatch_by_keys", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'capture' WHEN event_id % 4 = 1 THEN 'edit' WHEN event_id % 4 = 2 THEN 'delete' ELSE 'unknown' END AS op FROM events")
def _(s, d):
    """The first key that a payload has decides."""
    keys = F.element_at(F.array(*map(F.lit, ("capture", "edit", "delete", "other"))), (C("event_id") % 4 + 1).cast("int"))
    payload = F.create_map(keys, F.lit(1))
    op = F.lit("unknown")
    for k in ("delete", "edit", "capture"):
        op = F.when(F.map_contains_key(payload, k), k).otherwise(op)
    return read(s, d, "events").select("event_id", op.alias("op"))


@query("join_registry_repair", "SELECT c_custkey, coalesce(n_name, 'unknown') AS nation, coalesce(r_name, 'unknown') AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def _(s, d):
    c = read(s, d, "customer").join(read(s, d, "nation"), C("n_nationkey") == C("c_nationkey"), "left").join(read(s, d, "region"), C("r_regionkey") == C("n_regionkey"), "left")
    return c.select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


@query("join_substring_first", """WITH canned AS (SELECT min(p_partkey) AS ord, CASE WHEN min(p_partkey) % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE upper(p_name) || ' SET' END AS label FROM part GROUP BY p_name)
SELECT p_partkey, min(ord) AS ord FROM part JOIN canned ON contains(lower(p_name), lower(label)) OR contains(lower(label), lower(p_name)) GROUP BY 1""")
def _(s, d):
    """Each part's first canned answer whose label holds its name or is held by it."""
    canned = read(s, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord"))
    label = F.when(C("ord") % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.concat(F.upper("p_name"), F.lit(" SET")))
    return M.first_substring(read(s, d, "part"), "p_partkey", C("p_name"), canned.select("ord", label.alias("label")), "ord", "label")


@query("join_lane_wildcard", "WITH rules AS (SELECT * FROM (VALUES (1, 'click', 100), (2, 'both', 50), (3, 'view', 10)) t(priority, lane, cut)) SELECT event_id, arg_min(cut, priority) AS cut FROM events JOIN rules ON lane IN (event_type, 'both') GROUP BY 1")
def _(s, d):
    """The lane's own rule or the one for both, whichever is first."""
    rules = F.explode(F.array(*(F.struct(F.lit(p).alias("priority"), F.lit(lane).alias("lane"), F.lit(cut).alias("cut")) for p, lane, cut in ((1, "click", 100), (2, "both", 50), (3, "view", 10)))))
    e = read(s, d, "events").select("event_id", "event_type", rules.alias("r"))
    return e.where((C("r.lane") == C("event_type")) | (C("r.lane") == "both")).groupBy("event_id").agg(F.min_by("r.cut", "r.priority").alias("cut"))


_REGISTRY = (("ring", "rings"), ("Red Widget", "red"), ("widget", "widgets"), ("small", "small"), ("blue bolt and nut", "sets"), ("green gear", "gears"))


@query("map_priority_match", "SELECT p_partkey, CASE " + " ".join(f"WHEN x = '{a.lower()}' THEN '{b}'" for a, b in _REGISTRY) + " " + " ".join(f"WHEN contains('{a.lower()}', x) OR contains(x, '{a.lower()}') THEN '{b}'" for a, b in _REGISTRY) + " ELSE 'other' END AS target FROM (SELECT p_partkey, lower(trim(CASE p_partkey % 5 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN ' ' || upper(p_name) || ' ' ELSE p_name END)) AS x FROM part)")
def _(s, d):
    """Exact first, then either way by substring in the registry's order, then the default."""
    k = C("p_partkey")
    label = F.when(k % 5 == 0, F.split_part("p_name", F.lit(" "), F.lit(2))).when(k % 5 == 1, F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "))).otherwise(C("p_name"))
    return read(s, d, "part").select("p_partkey", M.priority_match(label, _REGISTRY, "other").alias("target"))


@query("latest_per_session", "SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations GROUP BY 1")
def _(s, d):
    return read(s, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


@query("manifest_missing", "SELECT doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000)")
def _(s, d):
    have = read(s, d, "documents").where("n_chars > 1000").select("doc_id")
    return read(s, d, "labels").where("quality = 1").join(have, "doc_id", "left_anti").select("doc_id")


@query("union_sources", "SELECT kind, count(*) AS n, sum(chars)::BIGINT AS chars FROM (SELECT 'document' AS kind, length(text) AS chars FROM documents UNION ALL SELECT 'turn', length(text) FROM conversations UNION ALL SELECT 'item', length(text) FROM benchmark) GROUP BY 1")
def _(s, d):
    part = lambda t, k: read(s, d, t).select(F.lit(k).alias("kind"), F.length("text").cast("long").alias("chars"))
    return part("documents", "document").unionByName(part("conversations", "turn")).unionByName(part("benchmark", "item")).groupBy("kind").agg(n().alias("n"), F.sum("chars").alias("chars"))


@query("tokens_intersect", "SELECT item_id, len(list_intersect(list_distinct(string_split(lower(text), ' ')), ['the', 'of', 'and', 'que', 'de']))::BIGINT AS shared FROM benchmark")
def _(s, d):
    return read(s, d, "benchmark").select("item_id", F.size(F.array_intersect(F.split(F.lower("text"), " "), F.array(*map(F.lit, ("the", "of", "and", "que", "de"))))).cast("long").alias("shared"))


@query("missing_tags", "SELECT 'src' || r AS tag FROM range(0, 25) t(r) WHERE 'src' || r NOT IN (SELECT source FROM documents)")
def _(s, d):
    return s.range(25).select(F.concat(F.lit("src"), C("id").cast("string")).alias("tag")).join(read(s, d, "documents").select(C("source").alias("tag")), "tag", "left_anti")


@query("distinct_tags", "SELECT DISTINCT lang, source FROM documents")
def _(s, d):
    return read(s, d, "documents").select("lang", "source").distinct()
