"""String functions over Columns: slugs, file names, redaction, truncation, keyword rules."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The redaction patterns and their replacements, applied in this order.
REDACTIONS = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    ("phone_us_parens", r"\([0-9]{3}\)\s*[0-9]{3}[-.\s]?[0-9]{4}\b", "[PHONE_REDACTED]"),
    ("phone_us_dashes", r"\b[0-9]{3}-[0-9]{3}-[0-9]{4}\b", "[PHONE_REDACTED]"),
    ("phone_us_dots", r"\b[0-9]{3}\.[0-9]{3}\.[0-9]{4}\b", "[PHONE_REDACTED]"),
    ("phone_us_spaces", r"\b[0-9]{3}\s[0-9]{3}\s[0-9]{4}\b", "[PHONE_REDACTED]"),
    ("phone_international", r"\+[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,4}\b", "[PHONE_REDACTED]"),
    ("credit_card", r"\b[0-9]{4}[-.\s]?[0-9]{4}[-.\s]?[0-9]{4}[-.\s]?[0-9]{4}\b", "[CARD_REDACTED]"),
    ("ssn", r"\b(?!000|666|9[0-9]{2})[0-9]{3}[-.\s]?(?!00)[0-9]{2}[-.\s]?(?!0000)[0-9]{4}\b", "[SSN_REDACTED]"),
    ("name_basic", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", "[NAME_REDACTED]"),
    ("api_key", r"\b[A-Za-z0-9]{20,}\b", "[API_KEY_REDACTED]"),
    ("url_sensitive", r"https?://[^\s]+", "[URL_REDACTED]"),
)
# The tone, residue and readiness rules of the two sensing stages; the first rule that fits wins.
ENTRY_TONE = (("urgent", ("urgent", "asap", "quick")), ("calm", ("calm", "patient", "gentle")), ("excited", ("excited", "enthusiastic", "great")), ("worried", ("worried", "concerned", "anxious")))
ENTRY_RESIDUE = (("unresolved_previous", ("still", "again", "still not")), ("previous_attempts", ("tried", "attempted", "failed")))
ENTRY_READINESS = (("ready", ("ready", "let's go", "start")), ("deferring", ("wait", "hold", "later")))
DIAGNOSTIC_TONE = (("overwhelm", ("overwhelm", "overwhelmed")), ("urgency", ("urgency", "urgent")), ("calm", ("calm", "peaceful")), ("excitement", ("excitement", "excited")), ("worry", ("worry", "worried")))
DIAGNOSTIC_RESIDUE = (("unresolved_previous", ("still", "again")), ("previous_attempts", ("tried", "attempted")), ("deferring", ("wait", "hold")))


def slug_hyphen(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one hyphen, none at the ends. Null gives null."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


@F.pandas_udf(T.StringType())
def _unaccented(s: pd.Series) -> pd.Series:
    def plain(x):
        return x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return s.map(plain, na_action="ignore")


def slug_snake(text: Column) -> Column:
    """Accents dropped (NFKD, which the JVM functions lack, so Arrow batches of it), only letters, digits, spaces, _ and - kept; runs of spaces and hyphens as _."""
    kept = F.regexp_replace(_unaccented(text), "[^A-Za-z0-9 _-]", "")
    return F.lower(F.regexp_replace(F.trim(kept), "[\\s-]+", "_"))


def is_clean_slug(text: Column) -> Column:
    return text.rlike("^[a-z0-9]+(_[a-z0-9]+)*$") & ~text.rlike("^auto_[0-9]+(_[0-9]+)?$")


def safe_filename(name: Column) -> Column:
    """Anything but word characters, hyphens and dots as one underscore, none at the ends, lower case."""
    swapped = F.regexp_replace(F.regexp_replace(name, "(?U)[^\\w\\-_.]", "_"), "_+", "_")
    return F.lower(F.regexp_replace(swapped, "^_+|_+$", ""))


def _ascii_edges(name: str, pattern: str) -> str:
    r"""The pattern with \b between ASCII word characters and all others, as SQL has it; Java's \b takes accented letters for word
    characters too. Only email's ends may be other than word characters, so that the rest look at one side alone."""
    first, last = (r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))",) * 2 if name == "email" else (r"(?<!\w)", r"(?!\w)")
    return re.sub(r"^\\b", lambda _: first, re.sub(r"\\b$", lambda _: last, pattern))


def redact(text: Column, only: str | None = None) -> Column:
    """The patterns in order, each on what the one before left; or one of them alone. A word ends where ASCII letters, digits and _ do."""
    chosen = [r for r in REDACTIONS if only is None or r[0] == only]
    return reduce(lambda s, r: F.regexp_replace(s, _ascii_edges(r[0], r[1]), r[2]), chosen, text)


def truncate_chars(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.filter(F.split(text, "[ \\t\\n\\r\\f\\v]+"), lambda w: w != "")


def truncate_words(text: Column, n: int) -> Column:
    w = words(text)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("..."))).otherwise(text)


def token_estimate(text: Column) -> Column:
    """A token for four characters, rounded down."""
    return F.expr("1") * F.floor(F.length(text) / 4)


def contains_any(text: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(n)) for n in needles))


def keyword_count(text: Column, needles) -> Column:
    """How many of the needles the text has as substrings; one that is listed twice counts twice."""
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(n)).cast("long") for n in needles))


def first_rule(text: Column, rules, otherwise: str | None = None) -> Column:
    """The label of the first rule with a needle in the lower-cased text."""
    low = F.lower(text)
    found = F.lit(otherwise) if otherwise is not None else F.lit(None).cast("string")
    for label, needles in reversed(rules):
        found = F.when(contains_any(low, needles), label).otherwise(found)
    return found


def length_bucket(tokens: Column) -> Column:
    return F.when(tokens <= 800, "short").when(tokens <= 2000, "medium").otherwise("long")


def sentences(text: Column) -> Column:
    """Cut after . ! or ? before white space; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, "(?<=[.!?])\\s+"), lambda s: F.trim(s)), lambda s: s != "")


def sql_case(column: str, rules, otherwise: str = "NULL") -> str:
    """first_rule() as SQL."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({column}), {lit(n)})' for n in needles)} THEN {lit(label)}" for label, needles in rules) + f" ELSE {otherwise} END"


# Labels of depths, and what stands for one that is not known.
DEPTHS = {"full": ("Full Protocol", "Complete protocol with all steps, details, and guidance"), "theme": ("Theme Summary", "Core theme and purpose without detailed steps"), "scenario": ("Scenario Entry", "Quick entry point for immediate application")}
ANY_DEPTH = ("Protocol", "Protocol guidance")


def depth_text(depth: Column, part: int) -> Column:
    """The label (0) or the description (1) of a depth."""
    return reduce(lambda found, d: F.when(depth == d[0], d[1][part]).otherwise(found), DEPTHS.items(), F.lit(ANY_DEPTH[part]))


def rendered(depth: Column, title: Column, purpose: Column, body: Column) -> Column:
    """A page at a depth: scenario has the first line of the purpose, theme the purpose, full and depths that are not known all."""
    head = F.concat(F.lit("# "), title, F.lit("\n*"), depth_text(depth, 0), F.lit("*: "), depth_text(depth, 1))
    first = F.substring_index(purpose, "\n", 1)
    return F.when(depth == "scenario", F.concat(head, F.lit("\n\n> "), first)).when(depth == "theme", F.concat(head, F.lit("\n\n"), purpose)).otherwise(F.concat(head, F.lit("\n\n"), purpose, F.lit("\n\n"), body))
