"""Session helper: UTC, adaptive execution, optional memory and spill settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def connect(
    memory_limit: str | None = None,
    temp_directory: str | None = None,
    master: str | None = None,
    shuffle_partitions: int | None = None,
) -> SparkSession:
    """Return the active session, or build one.

    Memory and the spill folder only take effect when this call starts the JVM;
    an active session belongs to its caller and is returned as it is.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName("finwake").config(map=DEFAULTS)
    if master:
        builder = builder.master(master)
    if memory_limit:
        builder = builder.config("spark.driver.memory", memory_limit).config("spark.executor.memory", memory_limit)
    if temp_directory:
        os.makedirs(temp_directory, exist_ok=True)
        builder = builder.config("spark.local.dir", temp_directory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
