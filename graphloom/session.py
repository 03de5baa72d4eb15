"""A session with the settings that the plans are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(name: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    """AQE with coalescing and skew joins, UTC, Arrow; ``conf`` overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
