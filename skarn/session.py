"""Session factory: UTC, AQE and Arrow; everything else is left to the cluster."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "skarn", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the running session is returned as it is."""
    if active := SparkSession.getActiveSession():
        return active
    n = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.appName(app).master(f"local[{n}]")
    settings = {**DEFAULTS, "spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
