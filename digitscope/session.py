"""Spark session for command-line runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "digitscope", **config: str) -> SparkSession:
    """Session with the settings the plans count on; cluster sizes are left to the submitter."""
    builder = (SparkSession.builder.appName(name)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               # Recording the call site of every expression costs more than building it.
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               # Text work is heavy per byte, so smaller splits than the default keep tasks even.
               .config("spark.sql.files.maxPartitionBytes", "64m"))
    for key, value in config.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
