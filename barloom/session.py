"""A session for one machine. On a cluster, sessions come from its own submit command."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, memory: str = "8g") -> SparkSession:
    n = cpus or os.cpu_count() or 1
    s = (
        SparkSession.builder.master(f"local[{n}]").appName("barloom")
        .config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(n)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s
