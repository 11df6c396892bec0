"""Session for local runs and tests; on a cluster the session is given."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str = "8", **options: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("normspark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("NORMSPARK_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
    )
    for name, value in options.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
