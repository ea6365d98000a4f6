"""Where a lane's index is, and whether all of it is there."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

# Keys of the settings and environment, and the default places.
PARTS = {"index": ("path", "VECTOR_PATH", ".vector/{lane}.index.faiss"), "meta": ("meta", "VECTOR_META", ".vector/{lane}.meta.jsonl"), "stats": ("stats", "VECTOR_STATS", ".vector/{lane}.stats.json")}
LEGACY_KEY, LEGACY_INDEX, LEGACY_BESIDE = "path_or_index", ".vector/index.faiss", {"meta": "meta.jsonl", "stats": "stats.json"}


@dataclass(frozen=True)
class IndexPaths:
    index: str
    meta: str
    stats: str
    legacy: bool


def index_paths(lane: str, settings: Mapping, environ: Mapping[str, str] | None = None) -> IndexPaths:
    """The environment's places for a lane, else the settings', else defaults by its name; where neither the environment
    nor the settings name the lane, one index for all, with its other files beside it."""
    environ = os.environ if environ is None else environ
    own = settings.get(lane) or {}
    if own or environ.get(f"{PARTS['index'][1]}_{lane.upper()}"):
        found = {part: environ.get(f"{variable}_{lane.upper()}") or own.get(key, default.format(lane=lane)) for part, (key, variable, default) in PARTS.items()}
        return IndexPaths(**found, legacy=False)
    index = settings.get(LEGACY_KEY, LEGACY_INDEX)
    folder = os.path.dirname(index)
    return IndexPaths(index, *(os.path.join(folder, LEGACY_BESIDE[k]) for k in ("meta", "stats")), legacy=True)


def missing(spark: SparkSession, folder: str, required: tuple[str, ...]) -> list[str]:
    """The required files that a folder does not have; all of them if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    return [name for name in required if not fs.exists(path(folder, name))]


def require(spark: SparkSession, folder: str, required: tuple[str, ...]) -> None:
    if lacking := missing(spark, folder, required):
        raise FileNotFoundError(f"{folder} lacks {', '.join(lacking)}")
