"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.registry import query, read

C = F.col


def _documents(spark, d):
    return read(spark, d, "documents")


def _sql_redact(name: str, pattern: str | None = None) -> str:
    found = {n: (p, r) for n, p, r in X.REDACTIONS}[name]
    return "regexp_replace(text, '{}', '{}', 'g')".format((pattern or found[0]).replace("'", "''"), found[1])


@query("slug_hyphen", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def _(s, d):
    return read(s, d, "part").select("p_partkey", X.slug_hyphen(C("p_name")).alias("slug"))


@query("slug_snake", "SELECT p_partkey, lower(regexp_replace(trim(regexp_replace(strip_accents(p_name || ' é-' || p_type), '[^A-Za-z0-9 _-]', '', 'g')), '[\\s-]+', '_', 'g')) AS slug FROM part")
def _(s, d):
    return read(s, d, "part").select("p_partkey", X.slug_snake(F.concat("p_name", F.lit(" é-"), "p_type")).alias("slug"))


@query("is_clean_slug", "SELECT p_partkey, regexp_matches(replace(lower(p_name), ' ', '_'), '^[a-z0-9]+(_[a-z0-9]+)*$') AND NOT regexp_matches(replace(lower(p_name), ' ', '_'), '^auto_[0-9]+(_[0-9]+)?$') AS clean FROM part")
def _(s, d):
    return read(s, d, "part").select("p_partkey", X.is_clean_slug(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_"))).alias("clean"))


@query("derive_doc_id", """
WITH p AS (SELECT page_id, regexp_extract(url, '([^/?#]*)[?#]?[^/]*$', 1) AS stem, split_part(split_part(url, '://', 2), '/', 1) AS given FROM pages)
SELECT page_id, CASE WHEN regexp_matches(given, '^[a-z0-9]+(_[a-z0-9]+)*$') THEN given ELSE trim(regexp_replace(lower(stem), '[^a-z0-9]+', '-', 'g'), '-') END AS doc_id,
       NOT regexp_matches(given, '^[a-z0-9]+(_[a-z0-9]+)*$') AS changed FROM p""")
def _(s, d):
    p = read(s, d, "pages").select("page_id", F.regexp_extract("url", "([^/?#]*)[?#]?[^/]*$", 1).alias("stem"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("given"))
    ok = C("given").rlike("^[a-z0-9]+(_[a-z0-9]+)*$")
    return p.select("page_id", F.when(ok, C("given")).otherwise(X.slug_hyphen(C("stem"))).alias("doc_id"), (~ok).alias("changed"))


@query("canonical_filename", "SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(regexp_extract(url, '/([^/?#]*)/?([?#].*)?$', 1)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled') || '.json' AS name FROM pages")
def _(s, d):
    stem = X.slug_hyphen(F.regexp_extract("url", "/([^/?#]*)/?([?#].*)?$", 1))
    return read(s, d, "pages").select("page_id", F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("untitled")), F.lit(".json")).alias("name"))


@query("safe_filename", "SELECT page_id, lower(trim(regexp_replace(regexp_replace(url, '[^\\w\\-_.]', '_', 'g'), '_+', '_', 'g'), '_')) AS name FROM pages")
def _(s, d):
    return read(s, d, "pages").select("page_id", X.safe_filename(C("url")).alias("name"))


for _name, _key in (("email", "redact_email"), ("api_key", "redact_api_key"), ("url_sensitive", "redact_url"), ("credit_card", "redact_card")):

    def _one(s, d, name=_name):
        return _documents(s, d).select("doc_id", F.sha2(X.redact(C("text"), name), 256).alias("redacted"))

    query(_key, f"SELECT doc_id, sha256({_sql_redact(_name)}) AS redacted FROM documents")(_one)


@query("redact_phone", "SELECT doc_id, sha256({}) AS redacted FROM documents".format(
    "regexp_replace(" * 5 + "text" + "".join(", '{}', '{}', 'g')".format(p, r) for n, p, r in X.REDACTIONS if n.startswith("phone"))))
def _(s, d):
    t = C("text")
    for n, _, _ in X.REDACTIONS:
        t = X.redact(t, n) if n.startswith("phone") else t
    return _documents(s, d).select("doc_id", F.sha2(t, 256).alias("redacted"))


#: RE2 has no look-ahead: the same numbers by alternation.
_SSN = r"\b(?:00[1-9]|0[1-9][0-9]|[1-57-8][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])[-.\s]?(?:0[1-9]|[1-9][0-9])[-.\s]?(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})\b"


@query("redact_ssn", f"SELECT doc_id, sha256({_sql_redact('ssn', _SSN)}) AS redacted FROM documents")
def _(s, d):
    return _documents(s, d).select("doc_id", F.sha2(X.redact(C("text"), "ssn"), 256).alias("redacted"))


@query("redact_name_ascii", f"SELECT doc_id, sha256({_sql_redact('name_basic')}) AS redacted FROM documents")
def _(s, d):
    """Words end where an ASCII letter, digit or underscore does not follow, as in SQL and in the other redactions."""
    _, _, put = next(r for r in X.REDACTIONS if r[0] == "name_basic")
    return _documents(s, d).select("doc_id", F.sha2(F.regexp_replace("text", "(?<![A-Za-z0-9_])[A-Z][a-z]+ [A-Z][a-z]+(?![A-Za-z0-9_])", put), 256).alias("redacted"))


@query("redact_text")
def _(s, d):
    return _documents(s, d).select("doc_id", X.redact(C("text")).alias("redacted"))


@query("redact_query_hash", "SELECT item_id, sha256(text) AS hash, length(text) AS len FROM benchmark")
def _(s, d):
    return read(s, d, "benchmark").select("item_id", F.sha2("text", 256).alias("hash"), F.length("text").cast("long").alias("len"))


@query("truncate_chars", "SELECT doc_id, CASE WHEN length(text) > 140 THEN left(text, 140) || '...' ELSE text END AS preview FROM documents")
def _(s, d):
    return _documents(s, d).select("doc_id", X.truncate_chars(C("text"), 140).alias("preview"))


_WORDS = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"


@query("truncate_words", f"SELECT doc_id, CASE WHEN len(w) > 40 THEN array_to_string(w[1:40], ' ') || '...' ELSE text END AS preview FROM (SELECT doc_id, text, {_WORDS.format('text')} AS w FROM documents)")
def _(s, d):
    return _documents(s, d).select("doc_id", X.truncate_words(C("text"), 40).alias("preview"))


_KEYWORDS = ("the", "and", "idiot", "clown", "que")


@query("keyword_counts", "SELECT doc_id, {} AS hits FROM documents".format(" + ".join(f"contains(lower(text), '{k}')::BIGINT" for k in _KEYWORDS)))
def _(s, d):
    return _documents(s, d).select("doc_id", X.keyword_count(F.lower("text"), _KEYWORDS).alias("hits"))


@query("label_tone_entry", f"SELECT conv_id, turn, {X.sql_case('text', X.ENTRY_TONE)} AS tone, {X.sql_case('text', X.ENTRY_RESIDUE)} AS residue, {X.sql_case('text', X.ENTRY_READINESS, chr(39) + 'neutral' + chr(39))} AS readiness FROM conversations")
def _(s, d):
    t = C("text")
    return read(s, d, "conversations").select("conv_id", "turn", X.first_rule(t, X.ENTRY_TONE).alias("tone"), X.first_rule(t, X.ENTRY_RESIDUE).alias("residue"), X.first_rule(t, X.ENTRY_READINESS, "neutral").alias("readiness"))


@query("label_tone_diag", f"SELECT conv_id, turn, {X.sql_case('text', X.DIAGNOSTIC_TONE, chr(39) + 'unspecified' + chr(39))} AS tone, {X.sql_case('text', X.DIAGNOSTIC_RESIDUE, chr(39) + 'unspecified' + chr(39))} AS residue FROM conversations")
def _(s, d):
    t = C("text")
    return read(s, d, "conversations").select("conv_id", "turn", X.first_rule(t, X.DIAGNOSTIC_TONE, "unspecified").alias("tone"), X.first_rule(t, X.DIAGNOSTIC_RESIDUE, "unspecified").alias("residue"))


def _signals(s, d):
    p = C("l_partkey")
    tone = F.element_at(F.array(*map(F.lit, ("overwhelm", "urgency", "worry", "calm", "calm"))), (p % 5 + 1).cast("int"))
    residue = F.element_at(F.array(*map(F.lit, ("unresolved_previous", "previous_attempts", "deferring", "none"))), (C("l_suppkey") % 4 + 1).cast("int"))
    ready = F.element_at(F.array(*map(F.lit, ("HOLD", "LATER", "SOFT_HOLD", "NOW"))), (C("l_linenumber") % 4 + 1).cast("int"))
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", tone.alias("tone"), residue.alias("residue"), ready.alias("readiness"))


_SIGNALS_SQL = """signals AS (SELECT l_orderkey, l_linenumber, l_quantity, (['overwhelm', 'urgency', 'worry', 'calm', 'calm'])[l_partkey % 5 + 1] AS tone,
  (['unresolved_previous', 'previous_attempts', 'deferring', 'none'])[l_suppkey % 4 + 1] AS residue, (['HOLD', 'LATER', 'SOFT_HOLD', 'NOW'])[l_linenumber % 4 + 1] AS readiness FROM lineitem)"""
# What a signal suggests, first match first.
SIGNAL_RULES = (
    ("tone", "overwhelm", "resourcing_mini_walk"), ("tone", "urgency", "clearing_entry"), ("tone", "worry", "pacing_adjustment"),
    ("residue", "unresolved_previous", "integration_pause"), ("residue", "previous_attempts", "clearing_entry"), ("residue", "deferring", "pacing_adjustment"),
    ("readiness", "HOLD", "integration_pause"), ("readiness", "LATER", "pacing_adjustment"), ("readiness", "SOFT_HOLD", "clearing_entry"),
)


@query("map_signal", f"WITH {_SIGNALS_SQL} SELECT readiness, tone, residue, CASE {' '.join(f'WHEN {a} = {chr(39)}{b}{chr(39)} THEN {chr(39)}{c}{chr(39)}' for a, b, c in SIGNAL_RULES)} ELSE 'default' END AS document, count(*) AS n FROM signals GROUP BY ALL")
def _(s, d):
    found = F.lit("default")
    for a, b, c in reversed(SIGNAL_RULES):
        found = F.when(C(a) == b, c).otherwise(found)
    return _signals(s, d).withColumn("document", found).groupBy("readiness", "tone", "residue", "document").agg(F.count(F.lit(1)).alias("n"))


@query("select_depth", f"WITH {_SIGNALS_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 50 THEN 'full' WHEN readiness = 'HOLD' THEN 'scenario' WHEN readiness IN ('LATER', 'SOFT_HOLD') THEN 'theme' WHEN l_quantity < 5 THEN 'scenario' WHEN l_quantity < 15 THEN 'theme' ELSE 'full' END AS depth FROM signals")
def _(s, d):
    q = C("l_quantity")
    depth = F.when(q == 50, "full").when(C("readiness") == "HOLD", "scenario").when(C("readiness").isin("LATER", "SOFT_HOLD"), "theme").when(q < 5, "scenario").when(q < 15, "theme").otherwise("full")
    return _signals(s, d).select("l_orderkey", "l_linenumber", depth.alias("depth"))


@query("pace_action", f"WITH {_SIGNALS_SQL} SELECT readiness AS pace, CASE readiness WHEN 'NOW' THEN 'continue' WHEN 'LATER' THEN 'later' ELSE 'hold' END AS walk_action, CASE readiness WHEN 'LATER' THEN 'later' WHEN 'HOLD' THEN 'hold' WHEN 'SOFT_HOLD' THEN 'hold' ELSE 'continue' END AS entry_action, count(*) AS n FROM signals GROUP BY ALL")
def _(s, d):
    p = C("readiness")
    walk = F.when(p == "NOW", "continue").when(p == "LATER", "later").otherwise("hold")
    entry = F.when(p == "LATER", "later").when(p.isin("HOLD", "SOFT_HOLD"), "hold").otherwise("continue")
    return _signals(s, d).select(p.alias("pace"), walk.alias("walk_action"), entry.alias("entry_action")).groupBy("pace", "walk_action", "entry_action").agg(F.count(F.lit(1)).alias("n"))


@query("reflect_lines", "WITH l AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM conversations) SELECT conv_id, turn, CASE WHEN len(lines) <= 1 THEN 1 ELSE len(lines) END AS n_lines, CASE WHEN len(lines) <= 1 THEN trim(text) ELSE array_to_string(lines, '|') END AS joined FROM l")
def _(s, d):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    one = F.size("lines") <= 1
    rows = read(s, d, "conversations").select("conv_id", "turn", "text", lines.alias("lines"))
    return rows.select("conv_id", "turn", F.when(one, 1).otherwise(F.size("lines")).cast("long").alias("n_lines"), F.when(one, F.trim("text")).otherwise(F.array_join("lines", "|")).alias("joined"))


@query("strip_markers", "SELECT conv_id, turn, contains(text || ' [[DONE]] tail', '[[DONE]]') AS marked, rtrim(regexp_replace(text || ' [[DONE]] tail', '(?s)\\[\\[DONE\\]\\].*$', '')) AS stripped FROM conversations")
def _(s, d):
    t = F.concat("text", F.lit(" [[DONE]] tail"))
    return read(s, d, "conversations").select("conv_id", "turn", F.contains(t, F.lit("[[DONE]]")).alias("marked"), F.rtrim(F.regexp_replace(t, "(?s)\\[\\[DONE\\]\\].*$", "")).alias("stripped"))


_LABEL = lambda part: "CASE depth " + " ".join(f"WHEN '{k}' THEN '{v[part]}'" for k, v in X.DEPTHS.items()) + f" ELSE '{X.ANY_DEPTH[part]}' END"


@query("render_by_depth", f"""SELECT conv_id, turn, '# ' || role || chr(10) || '*' || {_LABEL(0)} || '*: ' || {_LABEL(1)} || chr(10) || chr(10) || CASE depth WHEN 'scenario' THEN '> ' || split_part(text, chr(10), 1) WHEN 'theme' THEN text ELSE text || chr(10) || chr(10) || reverse(text) END AS page
FROM (SELECT *, (['full', 'theme', 'scenario', 'deeper'])[turn % 4 + 1] AS depth FROM conversations)""")
def _(s, d):
    """A depth that nobody knows is rendered in full under a general label."""
    depth = F.element_at(F.array(*map(F.lit, ("full", "theme", "scenario", "deeper"))), (C("turn") % 4 + 1).cast("int"))
    return read(s, d, "conversations").select("conv_id", "turn", X.rendered(depth, C("role"), C("text"), F.reverse("text")).alias("page"))


@query("canonical_json_hash", """
SELECT l_orderkey, l_linenumber, sha256('{"flag":"' || l_returnflag || '","order":' || l_orderkey || ',"status":"' || l_linestatus || '"}') AS digest FROM lineitem""")
def _(s, d):
    pairs = F.array_sort(F.array(
        F.struct(F.lit("status").alias("k"), F.to_json(F.struct(C("l_linestatus").alias("v"))).alias("v")),
        F.struct(F.lit("order").alias("k"), F.to_json(F.struct(C("l_orderkey").alias("v"))).alias("v")),
        F.struct(F.lit("flag").alias("k"), F.to_json(F.struct(C("l_returnflag").alias("v"))).alias("v")),
    ))
    body = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), p["k"], F.lit('":'), F.regexp_extract(p["v"], '^\\{"v":(.*)\\}$', 1))), ",")
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256).alias("digest"))


@query("est_tokens_bucket", "SELECT doc_id, length(text) // 4 AS est_tokens, CASE WHEN length(text) // 4 <= 800 THEN 'short' WHEN length(text) // 4 <= 2000 THEN 'medium' ELSE 'long' END AS bucket FROM documents")
def _(s, d):
    n = X.token_estimate(C("text"))
    return _documents(s, d).select("doc_id", n.alias("est_tokens"), X.length_bucket(n).alias("bucket"))


@query("map_merge_last_wins", "SELECT o_orderkey, 'o=' || o_orderstatus || ';p=' || o_orderpriority || ';s=merged' AS merged FROM orders")
def _(s, d):
    first = F.create_map(F.lit("o"), C("o_orderstatus"), F.lit("s"), F.lit("first"))
    second = F.create_map(F.lit("p"), C("o_orderpriority"), F.lit("s"), F.lit("merged"))
    # keys of the second map replace those of the first, whatever the session's policy for duplicate keys is
    merged = F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k)), second)
    flat = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return read(s, d, "orders").select("o_orderkey", flat.alias("merged"))


@query("map_filter_private", "SELECT o_orderkey, 'status' AS kept FROM orders")
def _(s, d):
    m = F.create_map(F.lit("_key"), C("o_orderkey").cast("string"), F.lit("status"), C("o_orderstatus"))
    return read(s, d, "orders").select("o_orderkey", F.array_join(F.map_keys(F.map_filter(m, lambda k, v: ~k.startswith("_"))), ",").alias("kept"))


@query("upcast_fields", "SELECT conv_id, turn, 'stage=' || role || ';version=0.2' AS envelope FROM conversations")
def _(s, d):
    old = F.create_map(F.lit("room"), C("role"), F.lit("v"), F.lit("0.2"))
    new = F.transform_keys(old, lambda k, v: F.when(k == "room", "stage").when(k == "v", "version").otherwise(k))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries(new)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return read(s, d, "conversations").select("conv_id", "turn", flat.alias("envelope"))


@query("event_day_partition", "SELECT strftime(ts, '%Y-%m-%d') || '.jsonl' AS file, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return read(s, d, "events").groupBy(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(".jsonl")).alias("file")).agg(F.count(F.lit(1)).alias("n"))


@query("recent_24h", "SELECT event_type, count(*) FILTER (ts >= m - INTERVAL 24 HOUR) AS recent FROM events, (SELECT max(ts) AS m FROM events) GROUP BY 1")
def _(s, d):
    e = read(s, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.crossJoin(F.broadcast(now)).groupBy("event_type").agg(F.count_if(C("ts") >= C("now") - F.expr("INTERVAL 24 HOURS")).alias("recent"))
