"""The Spark session that the engine's rules assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that decide results; they are set on whatever session is used.
SETTINGS = {"spark.sql.ansi.enabled": "true", "spark.sql.caseSensitive": "true", "spark.sql.session.timeZone": "UTC"}


def get_session() -> SparkSession:
    """The active session, or a local one."""
    found = SparkSession.getActiveSession()
    if found is None:
        found = SparkSession.builder.master("local[*]").appName("sparkrel").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        found.sparkContext.setLogLevel("ERROR")
    return found
