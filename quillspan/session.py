"""Spark session defaults."""

from pyspark.sql import SparkSession


def session(app: str = "quillspan", master: str | None = None) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI arithmetic; master is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    return (builder.master(master) if master else builder).getOrCreate()
