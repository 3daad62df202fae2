"""Session factory for local runs; on a cluster the submitted configuration wins."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "tidemark", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on. Submitted programs keep their master, memory and partitions; a plain Python run gets ``cpus`` local threads."""
    builder = SparkSession.builder.appName(app)
    if "PYSPARK_GATEWAY_PORT" not in os.environ and "--master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
        builder = builder.master(f"local[{n}]").config("spark.sql.shuffle.partitions", str(shuffle_partitions or n)).config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
