"""Feature table and metrics outputs."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from finwake.operators.features import FEATURES, PASSTHROUGH


def write_features(features: DataFrame, dest: str, mode: str = "static") -> str:
    """Parquet partitioned by event_date.

    ``static`` replaces the whole folder; ``dynamic`` replaces only the dates
    that are written and leaves the others. Rows are clustered by date before the
    write; a rebalance lets adaptive execution split one very large day.
    """
    clustered = features.hint("rebalance", "event_date")
    writer = clustered.write.mode("overwrite").option("partitionOverwriteMode", mode)
    writer.partitionBy("event_date").parquet(dest)
    return dest


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*PASSTHROUGH, *FEATURES)


def write_metrics(metrics: dict, path: str, spark: SparkSession | None = None) -> str:
    """One JSON file; with a session it goes through Hadoop's file systems, so any store that Spark writes to will do."""
    text = json.dumps(metrics, indent=2, default=str)
    if spark is None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w") as out:
            out.write(text)
        return path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path
