"""URL filters: host and path rules, whose decisions reach redirect and canonical-link aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, table
from tidemark.llm.components import connected_components

#: More rules than this are refused: they are compiled into one expression.
MAX_RULES = 1000
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://, else null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _bound(value: Column, f) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def _plain_dots(path: Column) -> Column:
    """A path without its segments . and .., by RFC 3986."""
    none = F.array().cast("array<string>")

    def step(done, s):
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(s == "..", up).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    def walked(p):
        ends = F.when(p.rlike("/\\.\\.?$"), F.array(F.lit(""))).otherwise(none)
        return F.array_join(F.concat(F.aggregate(F.split(p, "/", -1), none, step), ends), "/")

    return _bound(path, lambda p: F.when(p.rlike("/\\.\\.?(/|$)"), walked(p)).otherwise(p))


def node_of(url: Column) -> Column:
    """What stands for a url in links: scheme and host in lower case, a path of / at least and without . and .., its query
    and no fragment. Null for a url without a scheme or a host."""
    head = F.translate(F.regexp_extract(url, "^[^:/?#]+://[^/?#]+", 0), UPPER, LOWER)
    path = F.regexp_replace(F.regexp_extract(url, "(?s)^[^:/?#]+://[^/?#]+(/[^?#]*)", 1), "^$", "/")
    query = F.regexp_extract(url, "(?s)^[^?#]*(\\?[^#]*)", 1)
    return F.concat(F.nullif(head, F.lit("")), _plain_dots(path), query)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; of equally long ones an allowing rule comes first, then the lesser."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r))
    for where, start, verdict in reversed(ordered):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(where + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


#: Character references that a link is decoded of, besides numeric ones.
ENTITIES = (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"))
COMMENT = "(?s)<!--.*?(?:-->|$)"
ATTRIBUTE = "([^\\s\"'<>/=]+)\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"
CANONICAL = "(?i)(?:^|\\s)canonical(?:\\s|$)"
REFRESH = "(?is)\\burl\\s*=\\s*[\"']?([^\"']*)"


def _tags(html: Column, name: str) -> Column:
    """All tags of a name, outside comments; a > inside quotes ends no tag."""
    return F.regexp_extract_all(html, F.lit(f"(?is)<{name}\\b(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute without quotes and character references; null if it has none."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), lambda n: F.lower(n))
    value = F.get(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)), F.array_position(names, name).cast("int") - 1)
    return _bound(F.regexp_replace(value, "^[\"']|[\"']$", ""), _decoded)


def _decoded(value: Column) -> Column:
    """Character references as what they stand for; those of no character stay."""
    named = "|".join(n for n, _ in ENTITIES)
    parts = F.regexp_extract_all(value, F.lit(f"(?s)&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{named});|[^&]+|&"), F.lit(0))

    def one(p: Column) -> Column:
        code = F.when(p.rlike("^&#[xX].*;$"), F.conv(F.regexp_extract(p, "^&#[xX](.*);$", 1), 16, 10)).when(p.rlike("^&#.*;$"), F.regexp_extract(p, "^&#(.*);$", 1)).cast("int")
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        found = F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(p)
        for name, sign in ENTITIES:
            found = F.when(p == f"&{name};", sign).otherwise(found)
        return found

    return F.when(F.contains(value, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(value)


def resolved(base: Column, to: Column) -> Column:
    """The url that a link `to` on the page `base` leads to, by RFC 3986; null if that has no host."""
    site = F.regexp_extract(base, "^[^:/?#]+://[^/?#]*", 0)
    path = F.regexp_extract(base, "(?s)^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    whole = (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), to)
        .when(to.startswith("//"), F.concat(F.substring_index(base, "//", 1), to))
        .when(to.startswith("/"), F.concat(site, to))
        .when(to.startswith("?"), F.concat(site, path, to))
        .when((to == "") | to.startswith("#"), base)
        .otherwise(F.concat(site, folder, to))
    )
    return _bound(whole, lambda w: F.when(w.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"), w))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): from each page to its canonical links and to the targets of its refreshes, each resolved against the page's
    first <base> or else its url. Comments and targets without a host give no link."""
    given = pages.where(F.col(url).isNotNull() & F.col(html).rlike("(?i)canonical|http-equiv")).select(F.col(f"`{url}`").alias("u"), F.regexp_replace(F.col(f"`{html}`"), COMMENT, "").alias("h"))
    links = F.transform(F.filter(_tags(F.col("h"), "link"), lambda t: _attribute(t, "rel").rlike(CANONICAL)), lambda t: _attribute(t, "href"))
    metas = F.filter(_tags(F.col("h"), "meta"), lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh")
    refreshes = F.transform(metas, lambda t: F.nullif(F.regexp_extract(_attribute(t, "content"), REFRESH, 1), F.lit("")))
    trimmed = lambda c: F.translate(F.regexp_replace(c, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "\t\r\n", "")
    base = F.get(F.filter(F.transform(_tags(F.col("h"), "base"), lambda t: _attribute(t, "href")), lambda x: x.isNotNull()), F.lit(0))
    found = given.select("u", trimmed(base).alias("base"), F.explode(F.concat(links, refreshes)).alias("to")).where("to IS NOT NULL").withColumn("to", trimmed(F.col("to")))
    whole = _bound(F.coalesce(resolved(F.col("u"), F.col("base")), "u"), lambda b: resolved(b, F.col("to")))
    # a generated row, so that filters on a and b are no copies of all that makes them
    return found.select(F.inline(F.array(F.struct(node_of(F.col("u")).alias("a"), _bound(whole, node_of).alias("b"))))).where("a <> b")


def inherited(links: DataFrame, work: Workspace, rules=RULES) -> DataFrame:
    """(node, inherited): the decision that all aliases of a node share. One explicit allow among them outweighs any block."""
    parts = work.write(connected_components(links, work), "components")
    ruled = parts.select("component", rule_for(host_of(F.col("id")), path_of(F.col("id")), rules)["verdict"].alias("v")).where("v IS NOT NULL")
    decided = work.write(ruled.groupBy("component").agg(F.min("v").alias("inherited")), "decided")
    return work.write(parts.join(decided, "component").select(F.col("id").alias("node"), "inherited"), "inherited")


def judge(pages: DataFrame, work: Workspace, rules=RULES, redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """Adds host, path, rule, verdict and decided_by (rule, alias or default) to each row, in place of columns of these names.

    A page's own longest rule decides; else an allow, then a block, of any alias (pages and targets that redirects
    (src, dst), canonical links and refreshes join, by any path); else it is allowed. Null urls and those without ://
    have an empty host and path and no alias, nor has a url without a scheme or a host; redirects with such an end are left out. Rows that repeat get the same verdict each; an empty table stays empty.
    """
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.where("src IS NOT NULL AND dst IS NOT NULL").select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")))
    found = inherited(links, work, rules).withColumnsRenamed({"node": "__node", "inherited": "__inherited"})
    made = ("host", "path", "rule", "verdict", "decided_by")
    link = F.col(f"`{url}`")
    base = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in made), host_of(link).alias("host"), path_of(link).alias("path"), node_of(link).alias("__node"))
    base = base.withColumn("__own", rule_for(F.col("host"), F.col("path"), rules))
    joined = base.join(found, "__node", "left")
    return joined.select(
        *(F.col(f"`{c}`") for c in pages.columns if c not in made),
        "host",
        "path",
        F.col("__own.rule").alias("rule"),
        F.coalesce("__own.verdict", "__inherited", F.lit("allow")).alias("verdict"),
        F.when(F.col("__own").isNotNull(), "rule").when(F.col("__inherited").isNotNull(), "alias").otherwise("default").alias("decided_by"),
    )


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages, Workspace(spark, "urls")).select("page_id", "host", "path", "rule", "verdict", "decided_by")


def _sql_case(host: str, path: str, rules=RULES, verdict: bool = False) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r))
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{v if verdict else h + p}'" for h, p, v in ordered) + " END"


def _sql_node(url: str) -> str:
    head, path = f"translate(regexp_extract({url}, '^[^:/?#]+://[^/?#]+'), '{UPPER}', '{LOWER}')", f"regexp_replace(regexp_extract({url}, '(?s)^[^:/?#]+://[^/?#]+(/[^?#]*)', 1), '^$', '/')"
    walked = f"list_reduce(list_transform(string_split({path}, '/'), lambda s: [s]), lambda d, s: CASE WHEN s[1] = '..' THEN CASE WHEN len(d) > 1 THEN d[:len(d) - 1] ELSE d END WHEN s[1] = '.' THEN d ELSE list_concat(d, s) END)"
    plain = f"CASE WHEN regexp_matches({path}, '/\\.\\.?(/|$)') THEN array_to_string({walked} || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN [''] ELSE [] END, '/') ELSE {path} END"
    return f"nullif({head}, '') || {plain} || regexp_extract({url}, '(?s)^[^?#]*(\\?[^#]*)', 1)"


def _sql_decoded(value: str) -> str:
    parts = f"regexp_extract_all({value}, '(?s)&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|amp|lt|gt|quot|apos);|[^&]+|&')"
    code = "CASE WHEN regexp_matches(p, '^&#[xX].*;$') THEN ('0x' || p[4:-2])::INT WHEN regexp_matches(p, '^&#.*;$') THEN p[3:-2]::INT END"
    signs = " ".join("WHEN p = '&{};' THEN '{}'".format(n, c.replace("'", "''")) for n, c in ENTITIES)
    return f"array_to_string(list_transform({parts}, lambda p: CASE {signs} WHEN ({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111 THEN chr({code}) ELSE p END), '')"


def _sql_attribute(tag: str, name: str) -> str:
    pattern = ATTRIBUTE.replace("'", "''")
    at = f"list_position(list_transform(regexp_extract_all({tag}, '{pattern}', 1), lambda n: lower(n)), '{name}')"
    value = f"regexp_replace(regexp_extract_all({tag}, '{pattern}', 2)[{at}], '^[\"'']|[\"'']$', '', 'g')"
    return f"CASE WHEN {at} IS NOT NULL THEN {_sql_decoded(value)} END"


def _sql_resolved(base: str, to: str) -> str:
    site, path = f"regexp_extract({base}, '^[^:/?#]+://[^/?#]*')", f"regexp_extract({base}, '(?s)^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
    whole = f"""CASE WHEN regexp_matches({to}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {to} WHEN starts_with({to}, '//') THEN split_part({base}, '//', 1) || {to}
      WHEN starts_with({to}, '/') THEN {site} || {to} WHEN starts_with({to}, '?') THEN {site} || {path} || {to} WHEN {to} = '' OR starts_with({to}, '#') THEN {base}
      ELSE {site} || coalesce(nullif(regexp_extract({path}, '(?s)^(.*/)', 1), ''), '/') || {to} END"""
    return f"CASE WHEN regexp_matches({whole}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') THEN {whole} END"


_TAG = "(?is)<{}\\b(?:[^\"''>]|\"[^\"]*\"|''[^'']*'')*>"
_TRIM = "translate(regexp_replace({}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), chr(9) || chr(13) || chr(10), '')"

OP8_SQL = f"""
WITH RECURSIVE n AS (
  SELECT page_id, html, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, html, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, {_sql_node("url")} AS node FROM n
), c AS (
  SELECT url AS u, regexp_replace(html, '{COMMENT}', '', 'g') AS h FROM p WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|http-equiv')
), tags AS (
  SELECT u, list_filter(list_transform(regexp_extract_all(h, '{_TAG.format("base")}'), lambda t: {_sql_attribute("t", "href")}), lambda x: x IS NOT NULL)[1] AS base,
         unnest(regexp_extract_all(h, '{_TAG.format("link")}') || regexp_extract_all(h, '{_TAG.format("meta")}')) AS t FROM c
), given AS (
  SELECT u, base, CASE WHEN lower(t[2:5]) = 'link' THEN CASE WHEN regexp_matches({_sql_attribute("t", "rel")}, '{CANONICAL}') THEN {_sql_attribute("t", "href")} END
         WHEN lower(trim({_sql_attribute("t", "http-equiv")})) = 'refresh' THEN nullif(regexp_extract({_sql_attribute("t", "content")}, '{REFRESH.replace("'", "''")}', 1), '') END AS target FROM tags
), trimmed AS (
  SELECT u, {_TRIM.format("base")} AS base, {_TRIM.format("target")} AS target FROM given WHERE target IS NOT NULL
), based AS (
  SELECT u, coalesce({_sql_resolved("u", "base")}, u) AS base, target FROM trimmed
), whole AS (
  SELECT u, {_sql_resolved("base", "target")} AS target FROM based
), k AS (
  SELECT {_sql_node("u")} AS a, {_sql_node("target")} AS b FROM whole
), e AS (
  SELECT a, b FROM k WHERE a <> b UNION SELECT b, a FROM k WHERE a <> b
), r AS (
  SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a
), h AS (
  SELECT x, translate(regexp_extract(regexp_extract(y, '(?s)://(.*)', 1), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(regexp_extract(y, '(?s)://(.*)', 1), '^[^/?#]*([^?#]*)', 1) AS path FROM r
), i AS (
  SELECT x, min({_sql_case("host", "path", verdict=True)}) AS v FROM h GROUP BY x
)
SELECT page_id, host, path, {_sql_case("host", "path")} AS rule,
       coalesce({_sql_case("host", "path", verdict=True)}, i.v, 'allow') AS verdict,
       CASE WHEN {_sql_case("host", "path")} IS NOT NULL THEN 'rule' WHEN i.v IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM p LEFT JOIN i ON i.x = p.node
"""
