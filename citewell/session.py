"""The Spark session the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI stays on: bad casts and divisions by zero fail unless an expression says otherwise.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with the engine's settings; ``more`` overrides them."""
    builder = SparkSession.builder.appName("citewell").config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()
