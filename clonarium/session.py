"""Session builder with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Pandas groups are one batch each; other Arrow batches stay small with long sequences in them.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def session(app: str = "clonarium", master: str | None = None, **settings: str) -> SparkSession:
    """A session with ``SETTINGS``; a cluster's own master and checkpoint folder stay as they are set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
