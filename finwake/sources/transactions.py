"""The 13-column transfer relation: reading, normalising and checking."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("txn_id", T.LongType()),
        T.StructField("event_time", T.TimestampNTZType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("sender_id", T.StringType()),
        T.StructField("receiver_id", T.StringType()),
        T.StructField("sender_bank", T.StringType()),
        T.StructField("receiver_bank", T.StringType()),
        T.StructField("amount_paid", T.DoubleType()),
        T.StructField("amount_received", T.DoubleType()),
        T.StructField("payment_currency", T.StringType()),
        T.StructField("receiving_currency", T.StringType()),
        T.StructField("payment_format", T.StringType()),
        T.StructField("is_laundering", T.ByteType()),
    ]
)
COLUMNS = SCHEMA.names


def is_nested(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds folders other than hive partitions (``name=value``) and hidden ones, at any depth.

    Lists folders only until one is found, through Hadoop's file systems.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    todo = [where] if files.exists(where) else []
    while todo:
        here = todo.pop()
        inner = [s.getPath() for s in files.listStatus(here) if s.isDirectory() and s.getPath().getName()[0] not in "._"]
        if any("=" not in p.getName() and not p.getName().endswith(".parquet") for p in inner):
            return True
        todo += inner[:1]  # partitions of one level look alike
    return False


def read_parquet(spark: SparkSession, path: str, recursive: bool | None = None) -> DataFrame:
    """Scan one file, or every Parquet file below a folder.

    Hive-partitioned folders keep their partition columns; folders nested in any other way are
    read, too, unless ``recursive`` is False. Files whose timestamps are in nanoseconds, which
    Spark refuses, are read as integers and cut to microseconds.
    """
    reader = spark.read.option("pathGlobFilter", "*.parquet") if not os.path.isfile(path) else spark.read
    if recursive or recursive is None and is_nested(spark, path):
        reader = reader.option("recursiveFileLookup", True)
    try:
        return reader.parquet(path)
    except Exception as error:
        if "TIMESTAMP(NANOS" not in str(error):
            raise
    old = spark.conf.get("spark.sql.legacy.parquet.nanosAsLong", "false")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        frame = reader.parquet(path)
    finally:
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", old)
    kinds = dict(frame.dtypes)
    if kinds.get("event_time") == "bigint":
        micros = F.timestamp_micros(F.floor(F.col("event_time") / 1000))
        frame = frame.withColumn("event_time", F.to_utc_timestamp(micros, "UTC").cast("timestamp_ntz"))
    return frame


def normalize(frame: DataFrame) -> DataFrame:
    """Cast to the 13-column contract; missing columns are reported together."""
    missing = [c for c in COLUMNS if c not in frame.columns]
    if missing:
        raise ValueError(f"transaction columns missing: {', '.join(missing)}")
    return frame.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA])


def read_transactions(spark: SparkSession, path: str, recursive: bool | None = None) -> DataFrame:
    return normalize(read_parquet(spark, path, recursive))


def duplicate_ids(tx: DataFrame) -> DataFrame:
    """txn_id values that occur more than once, with their counts."""
    return tx.groupBy("txn_id").agg(F.count("*").alias("copies")).filter("copies > 1")


def quality_report(tx: DataFrame) -> DataFrame:
    """One row: rows, NULL counts, and rows whose date is not the date of their time."""
    return tx.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in COLUMNS],
        F.count_if(F.col("event_date") != F.col("event_time").cast("date")).alias("date_mismatch"),
    )
