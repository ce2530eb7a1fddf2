"""Session settings that suit wide text projections."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Parsing a row is one long projection. Fused into one method it passes the size up to which the JVM compiles
# methods, and would run interpreted. Under this limit Spark falls back to smaller methods that do get compiled.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session; all of them can change at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
