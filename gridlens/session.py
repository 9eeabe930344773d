"""The session the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What reading arbitrary parquet and text dates needs; also set on sessions made elsewhere.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` adds to them, dots written as double underscores."""
    builder = SparkSession.builder.appName("gridlens")
    if master:
        builder = builder.master(master)
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def prepared(spark: SparkSession) -> SparkSession:
    """``spark`` with the settings above."""
    for k, v in SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def activate(spark: SparkSession) -> None:
    """Make ``spark`` the session of this thread, whose settings then hold; a new thread has none."""
    spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)
