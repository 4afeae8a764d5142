"""Session settings that the engine is planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; keyword names have _ for the dots."""
    builder = SparkSession.builder.appName("textquarry")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()
