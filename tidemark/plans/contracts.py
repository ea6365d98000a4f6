"""Queries of contracts over JSON, of redaction inside nested values and of canonical dumps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import contracts as K
from tidemark.functions import nested as N
from tidemark.registry import query, read

C = F.col

#: Documents as JSON: the lines of a text are its parts.
PART = {"type": "object", "required": ["Name", "Length"], "properties": {"Name": {"type": "string", "minLength": 3, "maxLength": 400, "pattern": "^[^ ]"}, "Length": {"type": "integer", "minimum": 4}}, "additionalProperties": False}
CONTRACT = K.Schema({
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "type": "object",
    "required": ["Id", "Language", "Size"],
    "properties": {
        "Id": {"type": "integer", "minimum": 0},
        "Language": {"enum": ["en", "de", "fr"]},
        "Size": {"type": "integer", "maximum": 10000},
        "Origin": {"type": "object", "properties": {"Source": {"type": "string", "pattern": "^src[0-4]$"}}, "required": ["Source"]},
        "Parts": {"type": "array", "minItems": 2, "items": {"$ref": "#/$defs/part"}},
    },
    "additionalProperties": False,
    "$defs": {"part": PART},
})


def _documents(s, d):
    """The size is text in each seventh document, and each eleventh has a key too many."""
    k = C("doc_id")
    parts = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("Name"), F.length(x).alias("Length")))
    origin = F.struct(C("source").alias("Source"))
    whole = F.to_json(F.struct(k.alias("Id"), C("lang").alias("Language"), F.when(k % 7 != 0, C("n_chars")).alias("Size"), F.when(k % 7 == 0, C("n_chars").cast("string")).alias("size"), origin.alias("Origin"), parts.alias("Parts")))
    named = F.replace(whole, F.lit('"size":"'), F.lit('"Size":"'))
    return read(s, d, "documents").select("doc_id", F.when(k % 11 == 0, F.concat(F.lit('{"More":1,'), F.substring(named, 2, 1 << 30))).otherwise(named).alias("json"))


#: (doc_id, place, place to sort by, keyword) of each error of these documents.
_SQL_ERRORS = """
p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS name, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
e AS (
  SELECT doc_id, [''] AS path, 'additionalProperties' AS keyword FROM documents WHERE doc_id % 11 = 0
  UNION ALL SELECT doc_id, ['', 'Language'], 'enum' FROM documents WHERE lang NOT IN ('en', 'de', 'fr')
  UNION ALL SELECT doc_id, ['', 'Size'], 'type' FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, ['', 'Size'], 'maximum' FROM documents WHERE doc_id % 7 <> 0 AND n_chars > 10000
  UNION ALL SELECT doc_id, ['', 'Origin', 'Source'], 'pattern' FROM documents WHERE NOT regexp_matches(source, '^src[0-4]$')
  UNION ALL SELECT doc_id, ['', 'Parts'], 'minItems' FROM documents WHERE NOT contains(text, chr(10))
  UNION ALL SELECT doc_id, ['', 'Parts', i::VARCHAR, 'Name'], unnest(list_filter([CASE WHEN length(name) < 3 THEN 'minLength' END, CASE WHEN length(name) > 400 THEN 'maxLength' END, CASE WHEN NOT regexp_matches(name, '^[^ ]') THEN 'pattern' END], lambda x: x IS NOT NULL)) FROM p
  UNION ALL SELECT doc_id, ['', 'Parts', i::VARCHAR, 'Length'], 'minimum' FROM p WHERE length(name) < 4
)"""


@query("schema_all_errors", f"WITH {_SQL_ERRORS} SELECT d.doc_id, count(keyword) AS n, coalesce(string_agg(array_to_string(path[2:], ' -> ') || ' ' || keyword, '; ' ORDER BY array_to_string(path[2:], ' -> ') || ' ' || keyword), '') AS errors FROM documents d LEFT JOIN e USING (doc_id) GROUP BY 1")
def _(s, d):
    found = K.checked(_documents(s, d), "json", CONTRACT)
    each = F.array_sort(F.transform("errors", lambda e: F.concat(F.array_join(e["path"], " -> "), F.lit(" "), e["keyword"])))
    return found.select("doc_id", F.size("errors").cast("long").alias("n"), F.array_join(each, "; ").alias("errors"))


_RANK = "CASE keyword WHEN 'minLength' THEN 1 WHEN 'maxLength' THEN 2 WHEN 'pattern' THEN 3 ELSE 0 END"


@query("schema_first_error", f"""WITH {_SQL_ERRORS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_transform(path, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN lpad(x, 12, '0') ELSE x END), {_RANK}) AS nth FROM e)
SELECT d.doc_id, CASE WHEN keyword IS NOT NULL THEN CASE WHEN len(path) = 1 THEN '<root>' ELSE array_to_string(path[2:], '.') END || ' -> ' || keyword END AS error FROM documents d LEFT JOIN (SELECT * FROM r WHERE nth = 1) r USING (doc_id)""")
def _(s, d):
    return K.first_error(_documents(s, d), "json", CONTRACT).select("doc_id", "error")


@query("schema_described", "SELECT keyword, count(*) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Expected integer, got str at ''Size''' END AS keyword FROM documents UNION ALL SELECT doc_id, CASE WHEN NOT contains(text, chr(10)) THEN 'Array too short (minimum 2 items) at ''Parts''' END FROM documents UNION ALL SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Additional properties not allowed: ''More'' at root level' END FROM documents) WHERE keyword IS NOT NULL GROUP BY 1")
def _(s, d):
    """Errors of the whole and of two fields, as sentences, counted."""
    found = K.checked(_documents(s, d), "json", CONTRACT).select(F.explode("errors").alias("e")).where(F.size("e.path") <= 1).where("e.keyword IN ('type', 'minItems', 'additionalProperties')")
    return found.groupBy(K.described(C("e")).alias("keyword")).agg(F.count(F.lit(1)).alias("n"))


_EMAIL = r"regexp_replace({}, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b', '[EMAIL_REDACTED]', 'g')"
_LINES = "array_to_string(list_transform(string_split(text, chr(10)), lambda x: " + _EMAIL.format("x || ' me@' || doc_id || '.example.org'") + "), chr(10))"


def _letters(s, d):
    """Each document as an object with an address as key, one in each line and one in a nested object."""
    address = F.concat(F.lit(" me@"), C("doc_id").cast("string"), F.lit(".example.org"))
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.concat(x, address))
    return read(s, d, "documents").select("doc_id", F.struct(F.struct(C("text"), lines.alias("lines")).alias("body"), F.create_map(F.concat(F.lit("to"), address), F.array(F.create_map(F.lit("text"), address))).alias("more")).alias("letter"))


_REDACTED = f"SELECT doc_id, sha256({_EMAIL.format('text')}) AS text_sha256, sha256({_LINES}) AS lines_sha256, 'to me@' || doc_id || '.example.org' AS key, ' [EMAIL_REDACTED]' AS value FROM documents"


@query("redact_nested", _REDACTED)
def _(s, d):
    key = F.get(F.map_keys("letter.more"), F.lit(0))
    found = N.redact_nested(_letters(s, d), ["letter"], only="email")
    return found.select("doc_id", F.sha2("letter.body.text", 256).alias("text_sha256"), F.sha2(F.array_join("letter.body.lines", "\n"), 256).alias("lines_sha256"), key.alias("key"), F.get(F.element_at("letter.more", key), F.lit(0))["text"].alias("value"))


@query("redact_jsonl", _REDACTED)
def _(s, d):
    kind = "struct<body:struct<text:string,lines:array<string>>,more:map<string,array<map<string,string>>>>"
    found = _letters(s, d).select("doc_id", F.from_json(N.redact_jsonl(F.to_json("letter"), only="email"), kind).alias("letter"))
    key = F.get(F.map_keys("letter.more"), F.lit(0))
    return found.select("doc_id", F.sha2("letter.body.text", 256).alias("text_sha256"), F.sha2(F.array_join("letter.body.lines", "\n"), 256).alias("lines_sha256"), key.alias("key"), F.get(F.element_at("letter.more", key), F.lit(0))["text"].alias("value"))


def _sql_string(x: str) -> str:
    """json_string() as SQL, character by character."""
    unit = "printf('\\u%04x', {})"
    pair = f"{unit.format('55296 + ((unicode(c) - 65536) >> 10)')} || {unit.format('56320 + ((unicode(c) - 65536) & 1023)')}"
    short = " ".join(f"WHEN {code} THEN '\\{letter}'" for code, letter in ((8, "b"), (9, "t"), (10, "n"), (12, "f"), (13, "r"), (34, '"'), (92, "\\")))
    return f"""'"' || array_to_string(list_transform(string_split({x}, ''), lambda c: CASE unicode(c) {short} ELSE CASE WHEN unicode(c) BETWEEN 32 AND 126 OR c = '' THEN c WHEN unicode(c) > 65535 THEN {pair} ELSE {unit.format('unicode(c)')} END END), '') || '"'"""


@query("canonical_nested_hash", f"""SELECT doc_id, sha256('{{"body":{{"lines":[' || array_to_string(list_transform(string_split(text, chr(10)), lambda x: {_sql_string('x')}), ',') || '],"size":' || n_chars || '}},"id":' || doc_id || ',"lang":' || {_sql_string('lang')} || ',"none":null,"tags":{{"a b":true,"z":[' || doc_id || ']}}}}') AS hash FROM documents""")
def _(s, d):
    """Fields and keys are written in the order of their names, whatever order they have here."""
    rows = read(s, d, "documents").select("doc_id", C("lang"), F.lit(None).cast("string").alias("none"), C("doc_id").alias("id"), F.struct(C("n_chars").alias("size"), F.split("text", "\n", -1).alias("lines")).alias("body"), F.struct(F.array("doc_id").alias("z"), F.lit(True).alias("a b")).alias("tags"))
    return N.canonical_columns(rows, ["tags", "none", "lang", "id", "body"]).select("doc_id", F.sha2("canonical", 256).alias("hash"))


@query("canonical_of_tables", """WITH l AS (SELECT l_orderkey, string_agg('{"discount":' || l_discount::VARCHAR || ',"number":' || l_linenumber || ',"ship":{"on":"' || strftime(l_shipdate, '%Y-%m-%d') || '"}}', ',' ORDER BY l_linenumber, strftime(l_shipdate, '%Y-%m-%d'), l_discount) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, sha256('{"customer":{"name":"' || c_name || '","segment":"' || c_mktsegment || '"},"key":' || o_orderkey || ',"lines":[' || coalesce(lines, '') || '],"price":' || o_totalprice::VARCHAR || '}') AS hash FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey""")
def _(s, d):
    """Orders with their customer and lines as one object each, with floats as Python writes them."""
    lines = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(C("l_linenumber").alias("number"), F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("on")).alias("ship"), C("l_discount").alias("discount")))).alias("lines"))
    both = read(s, d, "orders").join(read(s, d, "customer"), C("c_custkey") == C("o_custkey")).join(lines, C("l_orderkey") == C("o_orderkey"), "left")
    rows = both.select("o_orderkey", C("o_totalprice").alias("price"), F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)).alias("lines"), C("o_orderkey").alias("key"), F.struct(C("c_mktsegment").alias("segment"), C("c_name").alias("name")).alias("customer"))
    return N.canonical_columns(rows, ["price", "lines", "key", "customer"]).select("o_orderkey", F.sha2("canonical", 256).alias("hash"))
