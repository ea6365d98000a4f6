"""Schemas of the nested documents, chunks, requests and log events, and the rules of the contracts."""

from __future__ import annotations

from tidemark.functions.validation import Rule

# Field names of the nested documents, chunks and requests.
LEVEL = "STRUCT<`Present pattern`:STRING,`Immediate cost`:STRING,`30-90 day system effect`:STRING,`Signals`:STRING,`Edge condition`:STRING,`Example moves`:STRING,`Future effect`:STRING>"
DOCUMENT = (
    "`Title` STRING, `Short Title` STRING, `Overall Purpose` STRING, `Why This Matters` STRING, `When To Use This Protocol` STRING, "
    "`Overall Outcomes` STRUCT<`Poor`:STRING,`Expected`:STRING,`Excellent`:STRING,`Transcendent`:STRING>, "
    f"`Themes` ARRAY<STRUCT<`Name`:STRING,`Purpose of This Theme`:STRING,`Why This Matters`:STRING,`Outcomes`:STRUCT<`Poor`:{LEVEL},`Expected`:{LEVEL},`Excellent`:{LEVEL},`Transcendent`:{LEVEL}>,`Guiding Questions`:ARRAY<STRING>>>, "
    "`Completion Prompts` ARRAY<STRING>, `Version` STRING, `Protocol ID` STRING, `Category` STRING, `Metadata` STRUCT<`Tags`:ARRAY<STRING>,`Stones`:ARRAY<STRING>,`Fields`:ARRAY<STRING>>"
)
CHUNK = "doc_id STRING, chunk_id STRING, text STRING, token_count INT, span STRUCT<start:INT,`end`:INT>, section STRING, tags ARRAY<STRING>, source STRUCT<doc_type:STRING,title:STRING,url:STRING>"
REQUEST = "v STRING, trace_id STRING, query STRING, mode STRING, top_k INT, filters STRUCT<doc_types:ARRAY<STRING>,tags:ARRAY<STRING>>, include_spans BOOLEAN, max_chunk_tokens INT"

# What the contracts demand.
DOCUMENT_RULES = [
    *(Rule(f"`{f}`", required=True, shortest=1) for f in ("Title", "Short Title", "Overall Purpose", "Why This Matters", "When To Use This Protocol")),
    Rule("`Overall Outcomes`", required=True),
    Rule("`Themes`", required=True, shortest=1),
    Rule("`Completion Prompts`", required=True, shortest=1),
]
CHUNK_RULES = [Rule("doc_id", required=True), Rule("chunk_id", required=True), Rule("text", required=True), Rule("token_count", required=True, least=1), Rule("span.start", least=0), Rule("span.end", least=0)]
REQUEST_RULES = [
    Rule("trace_id", required=True, shortest=8),
    Rule("query", required=True, shortest=1, longest=2000),
    Rule("mode", required=True, among=("latency", "accuracy")),
    Rule("top_k", required=True, least=1, most=10),
    Rule("max_chunk_tokens", least=64, most=2048),
]
