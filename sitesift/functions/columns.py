"""Reuse of built column expressions.

The feature columns are large expressions of fixed column names. Building one costs thousands of
calls into the JVM, so each is built once per Spark application and reused by later queries and
micro-batches.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import SparkSession


def built_once(build):
    """Cache ``build(*names)`` per application; arguments must be plain values."""
    built: dict = {}

    @wraps(build)
    def reuse(*names):
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        key = (spark.sparkContext.applicationId, names)
        if key not in built:
            built[key] = build(*names)
        return built[key]

    return reuse
