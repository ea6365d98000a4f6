"""Nested documents as ordered sections and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.chunk import fixed_windows, greedy_chunks
from tidemark.functions.text import words

# Field names and levels of the nested documents.
SCALARS = ("Title", "Short Title", "Overall Purpose", "Why This Matters", "When To Use This Protocol")
LEVELS = ("Poor", "Expected", "Excellent", "Transcendent")


# The lines of an outcome of a theme.
OUTCOME = ("Present pattern", "Immediate cost", "30-90 day system effect", "Signals", "Edge condition", "Example moves", "Future effect")


def sections(docs: DataFrame, key: str = "Protocol ID") -> DataFrame:
    """(doc_id, section, name, text) of documents with the nested schema: five scalar sections, the overall outcomes, a
    section for each theme with its outcomes and questions, the completion prompts, and the tag lists where there are any.
    Texts begin with what they are of; lines of what is null are left out, as are sections of which nothing is left."""
    part = lambda name, text: F.struct(name.alias("name") if not isinstance(name, str) else F.lit(name).alias("name"), text.alias("text"))
    c = lambda *path: F.col(".".join(f"`{p}`" for p in path))
    said = lambda name, value: F.when(F.trim(value) != "", F.concat(F.lit(f"{name}: "), value))
    under = lambda name, *lines: F.when(F.concat_ws("", *lines) != "", F.concat_ws("\n", F.lit(f"{name}:"), *lines))
    bullets = lambda name, items: F.when(F.size(items) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")))
    numbered = lambda lines: F.array_join(F.transform(lines, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n")
    outcomes = under("Overall Outcomes", *(said(level, c("Overall Outcomes", level)) for level in LEVELS))

    def theme(t, i):
        levels = (under(level, *(F.concat(F.lit("  "), said(line, t["Outcomes"][level][line])) for line in OUTCOME)) for level in LEVELS)
        asked = F.when(F.size(t["Guiding Questions"]) > 0, F.concat(F.lit("Guiding Questions:\n"), numbered(t["Guiding Questions"])))
        head = F.concat_ws("\n", said("Theme", t["Name"]), said("Purpose", t["Purpose of This Theme"]), said("Why This Matters", t["Why This Matters"]))
        blocks = F.concat_ws("\n\n", *levels)
        body = F.concat_ws("\n\n", head, F.when(blocks != "", F.concat(F.lit("Outcomes:\n"), blocks)), asked)
        return part(F.concat_ws(": ", F.concat(F.lit("Theme "), (i + 1).cast("string")), t["Name"]), body)

    themes = F.coalesce(F.transform(c("Themes"), theme), F.array().cast("array<struct<name:string,text:string>>"))
    tags = [part(name, bullets(name, c("Metadata", name))) for name in ("Stones", "Tags")]
    every = F.concat(F.array(*(part(name, said(name, c(name))) for name in SCALARS), part("Overall Outcomes", outcomes)), themes, F.array(part("Completion Prompts", bullets("Completion Prompts", c("Completion Prompts"))), *tags))
    kept = F.filter(every, lambda s: F.coalesce(F.trim(s["text"]) != "", F.lit(False)))
    return docs.select(c(key).alias("doc_id"), F.posexplode(kept).alias("section", "s")).select("doc_id", "section", "s.name", "s.text")


def chunked(parts: DataFrame, most: int, overlap: int) -> DataFrame:
    """(chunk_id, doc_id, section, name, n_tokens, text, hash) of sections, by greedy packing of sentences."""
    c = parts.select("doc_id", "section", "name", F.posexplode(greedy_chunks(F.col("text"), most, overlap)).alias("chunk", "s"))
    text = F.array_join("s", " ")
    ident = F.concat("doc_id", F.lit("::s"), F.col("section").cast("string"), F.lit("::c"), F.col("chunk").cast("string"))
    return c.select(ident.alias("chunk_id"), "doc_id", "section", "name", F.floor(F.length(text) / 4).alias("n_tokens"), text.alias("text"), F.sha2(text, 256).alias("hash"))


# Tokens of a chunk and its overlap, and whether documents are checked first.
PROFILES = {"speed": (600, 20, False), "accuracy": (240, 48, True)}


def profile(docs: DataFrame, name: str, key: str = "Protocol ID") -> tuple[DataFrame, DataFrame | None]:
    """The chunks by a profile, and with a profile that checks the documents that did not pass, with their errors."""
    from tidemark.functions.validation import split_valid
    from tidemark.schemas import DOCUMENT_RULES

    most, overlap, checks = PROFILES[name]
    good, bad = split_valid(docs, DOCUMENT_RULES) if checks else (docs, None)
    return chunked(sections(good, key), most, overlap), bad


def field_chunks(docs: DataFrame, key: str, title: str = "title", content: str = "content", stones: str = "stones", fields: tuple[str, ...] = (), themes: str = "themes", size: int = 500, overlap: int = 50) -> DataFrame:
    """(key, place, type, chunk, start, stop, text): a document's title, content, principles, other fields and themes.

    Title and principles are one chunk each; the others are cut by word windows, numbered from 0 in each field, so chunk
    numbers are not unique in a document. The principles have the number of chunks before them. themes: an array of
    struct(name, purpose, why), of which those without a name are left out, as fields without text are. place: the field's.
    """
    kind = "struct<chunk:int,start:bigint,stop:bigint,text:string>"
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    words_in = lambda c: F.size(words(c)).cast("long")
    whole = lambda c, n, stop: F.struct(n.cast("int").alias("chunk"), F.lit(0).cast("long").alias("start"), stop.alias("stop"), c.alias("text"))
    cut = lambda c: F.transform(fixed_windows(c, size, overlap), lambda w, i: F.struct(i.alias("chunk"), w["start"].alias("start"), w["stop"].alias("stop"), w["text"].alias("text")))
    none = F.array().cast(f"array<{kind}>")
    said = F.concat(F.lit("Title: "), text(title))
    heads = F.when(text(title) != "", F.array(whole(said, F.lit(0), words_in(text(title))))).otherwise(none)
    bodies = cut(text(content))
    principles = F.concat(F.lit("Principles: "), F.array_join(stones, "; "))
    listed = F.when(F.size(F.coalesce(F.col(stones), F.array().cast("array<string>"))) > 0, F.array(whole(principles, F.size(heads) + F.size(bodies), words_in(principles)))).otherwise(none)
    part = lambda name, chunks: F.struct(F.lit(name).alias("type"), chunks.alias("chunks"))
    more = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(" - "), c)).otherwise("")
    of_themes = F.transform(F.coalesce(F.col(themes), F.array().cast(docs.schema[themes].dataType)), lambda t: part("theme", F.when(F.coalesce(t["name"], F.lit("")) != "", cut(F.concat(F.lit("Theme: "), t["name"], more(t["purpose"]), more(t["why"])))).otherwise(none)))
    every = F.concat(F.array(part("title", heads), part("content", bodies), part("stones", listed), *(part(f.lower().replace(" ", "_"), cut(text(f))) for f in fields)), of_themes)
    rows = docs.select(key, F.posexplode(every).alias("place", "f")).select(key, F.col("place").cast("long"), "f.type", F.explode("f.chunks").alias("c"))
    return rows.select(key, "place", "type", F.col("c.chunk").cast("long").alias("chunk"), "c.start", "c.stop", "c.text")
