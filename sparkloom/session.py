"""Session construction for local runs; on a cluster the caller passes its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(cores: str | None = None, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution on, UTC, and modest shuffle parallelism."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
