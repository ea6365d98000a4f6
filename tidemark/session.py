"""A SparkSession with the settings the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, shared: str | None = None, **more: str) -> SparkSession:
    """shared: the folder that driver and executors share, as spark.checkpoint.dir; more: other settings with _ for dots."""
    builder = SparkSession.builder if master is None else SparkSession.builder.master(master)
    settings = SETTINGS | ({"spark.checkpoint.dir": shared} if shared else {}) | {k.replace("_", "."): v for k, v in more.items()}
    return builder.config(map=settings).getOrCreate()
