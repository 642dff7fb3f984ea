"""Session settings this library is tested with; any session will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8, folder: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks; `folder` becomes spark.checkpoint.dir, which can
    only be set when a session starts."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    return builder.getOrCreate()
