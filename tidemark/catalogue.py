"""All registered queries of the engine with their SQL."""

from __future__ import annotations

from tidemark import registry
from tidemark.plans import aggregates, chunks, contracts, curation, events, ranking, relations, scans, sessions, streams, texts, vectors  # noqa: F401

FLAGSHIP = "knn_prefilter"


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
