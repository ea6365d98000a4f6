"""The registered queries of the llm operators, and SQL where it can express them."""

from __future__ import annotations

from tidemark.llm.chat import OP4_SQL, op4_chat
from tidemark.llm.contamination import OP13_SQL, op13_decontamination
from tidemark.llm.fingerprints import op3_fingerprints
from tidemark.llm.lines import OP7_SQL, op7_lines
from tidemark.llm.media import op6_media
from tidemark.llm.merkle import OP12_SQL, op12_merkle
from tidemark.llm.mixing import op1_mixing
from tidemark.llm.neardup import OP2_SQL, op2_neardup
from tidemark.llm.pieces import op9_pieces
from tidemark.llm.quality import op5_quality
from tidemark.llm.repair import OP11_SQL, op11_repair
from tidemark.llm.shards import OP10_SQL, op10_shards
from tidemark.llm.urls import OP8_SQL, op8_urls

QUERIES = {"op1_mixing": op1_mixing, "op2_neardup": op2_neardup, "op3_fingerprints": op3_fingerprints, "op4_chat": op4_chat, "op5_quality": op5_quality, "op6_media": op6_media, "op7_lines": op7_lines, "op8_urls": op8_urls, "op9_pieces": op9_pieces, "op10_shards": op10_shards, "op11_repair": op11_repair, "op12_merkle": op12_merkle, "op13_decontamination": op13_decontamination}

ORACLE_SQL: dict[str, str] = {"op2_neardup": OP2_SQL, "op4_chat": OP4_SQL, "op7_lines": OP7_SQL, "op8_urls": OP8_SQL, "op10_shards": OP10_SQL, "op11_repair": OP11_SQL, "op12_merkle": OP12_SQL, "op13_decontamination": OP13_SQL}
