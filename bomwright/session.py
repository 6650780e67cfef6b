"""The session settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def allow_deep_trees(spark: SparkSession) -> None:
    """Recursion over part trees needs more rows and levels than Spark's defaults; a session's own settings stay."""
    for key, default, needed in (("spark.sql.cteRecursionLevelLimit", "100", "1000"), ("spark.sql.cteRecursionRowLimit", "1000000", "-1")):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, needed)


def session_builder(master: str | None = None, app: str = "bomwright") -> SparkSession.Builder:
    """A builder with UTC, AQE and the recursion limits deep part trees need."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # looking up call sites doubles the time in which plans are built
        .config("spark.sql.cteRecursionLevelLimit", "1000")
        .config("spark.sql.cteRecursionRowLimit", "-1")
    )
    return builder.master(master) if master else builder
