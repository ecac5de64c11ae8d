"""A Spark session with the settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "keyframe", **conf: str) -> SparkSession:
    """ANSI SQL, UTC, adaptive execution; further settings by name with dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
