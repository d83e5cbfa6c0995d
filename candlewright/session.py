"""Spark session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "candlewright", master: str | None = None, **conf: str) -> SparkSession:
    """UTC session with adaptive execution; further settings by keyword (dots as double underscores)."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
