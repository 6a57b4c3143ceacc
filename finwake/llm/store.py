"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is named (as in tests) a temporary one is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="finwake-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/finwake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def with_rows(df: DataFrame, key: str, row: str, name: str) -> DataFrame:
    """``df`` with a column ``row`` that is different in every row, in the order of ``key`` (nulls last).

    Keys that are all different and not null serve as they are. Otherwise the rows are sorted,
    numbered and written, so that they keep their numbers.
    """
    odd = df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(key).unionByName(df.select(key).filter(F.col(key).isNull()))
    if odd.isEmpty():
        return df.withColumn(row, F.col(key))
    # the random number deals the rows of one key over many tasks
    ordered = df.orderBy(F.col(key).asc_nulls_last(), F.rand(7))
    return materialise(ordered.withColumn(row, F.monotonically_increasing_id()), name)


def text_bytes(df: DataFrame, text: str) -> int:
    """The bytes of all texts, and 64 for each row."""
    return int(df.agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + 64)).first()[0] or 0)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that do not clash with ``taken`` (case is ignored, as Spark does)."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def runs_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of the rows with one value of ``column``, from batches sorted by it; one is in memory at a time."""
    held, current = [], None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if a == b:
                continue
            if held and keys[a] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def salts(hashes: DataFrame, column: str, salt: str) -> DataFrame:
    """All columns plus ``salt``: 0, 1, 2, ... for the rows of a partition with equal ``column``."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            out = []
            for h in batch.column(batch.schema.get_field_index(column)).to_pylist():
                out.append(n := seen.get(h, 0))
                seen[h] = n + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, salt])

    return hashes.mapInArrow(number, T.StructType([*hashes.schema, T.StructField(salt, T.LongType())]))
