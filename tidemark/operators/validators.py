"""Checks of commitments, exits, prompts, answers and nested documents, each with its reasons as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import contains_any, keyword_count
from tidemark.operators.sessions import PACES, first_failure

# Words of a text that is none, fields of a prompt, and the words and tags of a document's integrity.
PLACEHOLDERS = ("unspecified", "none", "n/a", "placeholder", "to be filled")
PROMPT_FIELDS = ("query_id", "prompt", "stone", "stone_meaning", "field", "difficulty", "assertions")
REQUIRED_TAGS = ("the-speed-of-trust", "clarity-over-cleverness")
INTEGRITY_WORDS = ("integrity", "honesty", "authenticity", "truth", "clarity", "simplicity", "directness", "care", "respect", "safety", "trust", "presence")
MISALIGNED_WORDS = ("manipulation", "deception", "complexity", "confusion", "pressure", "urgency", "demand")
LEVELS = ("Poor", "Expected", "Excellent", "Transcendent")


def listed(*found: tuple[Column, Column | str]) -> Column:
    """array of the reasons (holds, reason) that hold."""
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), says if isinstance(says, Column) else F.lit(says)) for bad, says in found)), lambda x: x.isNotNull())


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def integration_decline(notes: Column, context: Column) -> Column:
    """The first rule that the integration of a session does not meet; null if it meets all."""
    size = lambda c: F.length(F.trim(c))
    return first_failure(
        ("missing integration fields", ~_blank(notes) & ~_blank(context)),
        ("notes too brief", size(notes) >= 10),
        ("context too brief", size(context) >= 5),
        ("notes are a placeholder", ~contains_any(F.lower(notes), PLACEHOLDERS)),
        ("context is a placeholder", ~contains_any(F.lower(context), PLACEHOLDERS)),
    )


def commitment_decline(text: Column, context: Column, pace: Column, session_ref: Column) -> Column:
    """The first rule that one commitment does not meet; null if it meets all. A null is a field that is missing."""
    return first_failure(
        ("missing required fields", text.isNotNull() & context.isNotNull() & pace.isNotNull() & session_ref.isNotNull()),
        ("text below 3 characters", F.length(F.trim(text)) >= 3),
        ("context below 2 characters", F.length(F.trim(context)) >= 2),
        ("invalid pace_state", pace.isin(*PACES)),
        ("empty session_ref", session_ref != ""),
    )


def commitments_decline(commitments: Column) -> Column:
    """The same of an array of struct(text, context, pace_state, session_ref): the first one's with its place."""
    each = F.transform(commitments, lambda c, i: F.struct(i.alias("i"), commitment_decline(c["text"], c["context"], c["pace_state"], c["session_ref"]).alias("why")))
    first = F.get(F.filter(each, lambda e: e["why"].isNotNull()), F.lit(0))
    said = F.concat(F.lit("invalid commitment at index "), first["i"].cast("string"), F.lit(": "), first["why"])
    return F.when(commitments.isNull(), "commitments are required").when(F.size(commitments) == 0, "at least one commitment is required").otherwise(said)


def memory_commit_decline(session_id: Column, reason: Column, has_diagnostics: Column, captured: Column) -> Column:
    return first_failure(("missing session ID", ~_blank(session_id)), ("missing exit reason", ~_blank(reason)), ("missing diagnostics", has_diagnostics), ("diagnostics not captured", captured))


def reset_decline(active: Column, buffers: Column, data: Column, flagged: Column) -> Column:
    return first_failure(("session still active", ~active), ("buffers not cleared", buffers == 0), ("data not cleared", data == 0), ("reset flag not set", flagged))


def prompt_errors(prompts: DataFrame, registry: DataFrame, slug: str = "slug", meaning: str = "meaning") -> DataFrame:
    """prompts with errors: the required fields that are null, a stone that the registry does not have, or one whose meaning
    there, outer spaces aside, is another."""
    known = registry.select(F.col(slug).alias("__slug"), F.trim(meaning).alias("__meaning"))
    joined = prompts.join(known, F.col("stone") == F.col("__slug"), "left")
    missing = [(F.col(f).isNull(), f"missing {f}") for f in PROMPT_FIELDS]
    unknown = F.col("stone").isNotNull() & F.col("__slug").isNull()
    other = F.col("__slug").isNotNull() & (F.trim("stone_meaning") != F.col("__meaning"))
    found = listed(*missing, (unknown, F.concat(F.lit("unknown stone "), "stone")), (other, F.concat(F.lit("meaning mismatch for "), "stone")))
    return joined.withColumn("errors", found).drop("__slug", "__meaning")


def semantic(answer: Column, must_have: tuple[str, ...], red_flags: tuple[str, ...], required: Column) -> Column:
    """struct(passed, failed_assertion, matches, flags): a phrase is matched by any word of it as a substring. A red flag
    fails; where the meaning is required, so does an answer that matches no must-have."""
    low = F.lower(answer)
    hits = lambda phrases: listed(*((contains_any(low, p.lower().split()), p) for p in phrases))
    found, flags = hits(must_have), hits(red_flags)
    lacks = required & (F.size(found) == 0)
    return F.struct(((F.size(flags) == 0) & ~lacks).alias("passed"), F.when(lacks, "must_reference_stone_meaning").alias("failed_assertion"), found.alias("matches"), flags.alias("flags"))


def index_grounding(text: Column, doc_id: Column, chunk_id: Column, has_source: Column, doc_type: Column, title: Column, has_span: Column) -> Column:
    """0 to 1: how much a chunk's metadata says about where it is from."""
    points = ((F.length(F.trim(text)) > 10, 0.3), (~_blank(doc_id), 0.2), (~_blank(chunk_id), 0.1), (has_source, 0.2), (has_source & ~_blank(doc_type), 0.1), (has_source & ~_blank(title), 0.1), (has_span, 0.1), (F.length(text) > 100, 0.1), (F.length(text) > 500, 0.1))
    return F.least(F.lit(1.0), sum((F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0) for c, v in points), F.lit(0.0)))


def sufficient(alignment: Column, hallucinations: Column, threshold: Column, rate: Column) -> Column:
    """Enough alignment, and no hallucination where the lane's rate is below a hundredth, else one at most."""
    return (alignment >= threshold) & (hallucinations <= F.when(rate < 0.01, 0).otherwise(1))


def alignment_reasons(tags: Column, text: Column) -> Column:
    """Why a document is not aligned: its tags are too few or lack a required one, or its whole text, lower-cased, has more words against than for."""
    missing = F.array_except(F.array(*map(F.lit, REQUIRED_TAGS)), tags)
    some = F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0
    positive, negative = keyword_count(F.lower(text), INTEGRITY_WORDS), keyword_count(F.lower(text), MISALIGNED_WORDS)
    against = F.concat(negative.cast("string"), F.lit(" negative indicators vs "), positive.cast("string"), F.lit(" positive"))
    return F.when(~some, F.array(F.lit("no tags"))).otherwise(listed((F.size(tags) < 2, "too few tags"), (F.size(missing) > 0, F.concat(F.lit("missing tags: "), F.array_join(missing, ", "))), (negative > positive, against)))


def coherence_reasons(c=lambda name: F.col(f"`{name}`")) -> Column:
    """Why a nested document (schemas.DOCUMENT) is not coherent: five to seven themes, each with a name of its own, three to
    five questions and all four outcomes, none below 50 characters as JSON; two to five prompts; and three texts."""
    none = F.array().cast("array<string>")
    themes, prompts = c("Themes"), c("Completion Prompts")
    n, p = F.coalesce(F.size(themes), F.lit(-1)), F.coalesce(F.size(prompts), F.lit(-1))

    def of_theme(t, i):
        name, at = F.coalesce(t["Name"], F.lit("")), F.concat(F.lit("theme "), (i + 1).cast("string"))
        asked = F.greatest(F.size(F.coalesce(t["Guiding Questions"], none)), F.lit(0))
        says = lambda text: F.concat(at, F.lit(f": {text}"))
        outcome = lambda level: t["Outcomes"][level]
        lacking = F.filter(F.array(*(F.when(outcome(x).isNull(), x) for x in LEVELS)), lambda x: x.isNotNull())
        shallow = [(outcome(x).isNotNull() & (F.length(F.to_json(outcome(x))) < 50), says(f"{x} outcome too shallow")) for x in LEVELS]
        return listed(
            ((name == "") | (name == F.concat(F.lit("Theme "), (i + 1).cast("string"))), says("missing or generic name")),
            (asked < 3, says("too few questions")),
            (asked > 5, says("too many questions")),
            (F.size(lacking) > 0, F.concat(says("missing outcomes "), F.array_join(lacking, ", "))),
            *shallow,
        )

    names = F.transform(themes, lambda t: F.coalesce(t["Name"], F.lit("")))
    head = listed(
        *((_blank(c(f)), f"missing {f}") for f in ("Title", "Overall Purpose", "When To Use This Protocol")),
        (n <= 0, "no themes"), ((n > 0) & (n < 5), "too few themes"), (n > 7, "too many themes"),
    )
    tail = listed((F.size(F.array_distinct(names)) < n, "duplicate theme names"), (p <= 0, "no prompts"), (p == 1, "too few prompts"), (p > 5, "too many prompts"))
    inner = F.coalesce(F.flatten(F.transform(themes, of_theme)), none)
    return F.concat(head, inner, tail)


def missing_dependencies(contracts: DataFrame, available: DataFrame, name: str, needs: str, gate: str) -> DataFrame:
    """(name, missing): the contracts that depend on gates that are not there, and which, in order."""
    asked = contracts.select(name, F.explode(needs).alias("__need"))
    lacking = asked.join(available.select(F.col(gate).alias("__need")), "__need", "left_anti")
    return lacking.groupBy(name).agg(F.array_sort(F.collect_set("__need")).alias("missing"))
