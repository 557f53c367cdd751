"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "helixframe", **settings: str) -> SparkSession:
    """Adaptive execution (which splits skewed joins) and UTC; settings override."""
    builder = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
