"""Session helpers. On a cluster the submitter's settings win; these are the defaults for a laptop and for tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "tidewright", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with UTC time, Arrow transfer and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
