"""Ordered export: Arrow files of exactly so many rows, in the order of a key, written by the tasks.

Rows are range-partitioned and sorted by the key and written once with their place in the
partition; the partitions' counts give every row its place in the whole. A batch is the rows of
one range of places; a task holds one batch, or as many small ones as make ``TASK_ROWS`` rows. It
writes each under a temporary name and renames it, so a task that runs twice leaves one file. No row
passes the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finwake.operators.history import TASK_ROWS, tasks_for
from finwake.sources.shared import written

BATCH_ROWS = 1_000_000
NAME = "batch-{:08d}.arrow"
IN_PARTITION = (1 << 33) - 1  # bits of monotonically_increasing_id that count within a partition


def numbered(frame: DataFrame, key: str = "txn_id") -> DataFrame:
    """``frame`` with ``_row``, its place (from 0) in the order of ``key``; nulls first, equal keys in any order."""
    frame = written(frame, "unordered")  # counted and sampled from files
    dealt = frame.repartitionByRange(tasks_for(frame.count()), F.asc_nulls_first(key)).sortWithinPartitions(F.asc_nulls_first(key))
    dealt = dealt.withColumn("_place", F.monotonically_increasing_id())
    dealt = written(dealt.withColumns({"_part": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND(F.lit(IN_PARTITION))}), "ordered")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("n"))  # one row a partition
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_part").withColumn("_row", F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def _open(dest: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(dest) if "://" in dest or dest.startswith("file:") else (fs.LocalFileSystem(), dest)


def write_batches(frame: DataFrame, dest: str, key: str = "txn_id", rows: int = BATCH_ROWS) -> DataFrame:
    """Write all batches; returns (batch, rows, first, last) of each, as the tasks report them.

    ``dest`` is a folder that all executors reach: a path or a URI of a file system that Arrow opens.
    """
    columns = frame.columns
    placed = numbered(frame, key).withColumn("batch", F.floor(F.col("_row") / rows))
    kind = frame.schema[key].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _open(dest)
        files.create_dir(folder, recursive=True)
        sink = writer = now = None
        count, first, last = 0, None, None

        def close() -> pa.RecordBatch:
            writer.close(), sink.close()
            files.move(f"{folder}/.{token}", f"{folder}/{NAME.format(now)}")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([count], pa.int64()), pa.array([first], key_type), pa.array([last], key_type)], ["batch", "rows", "first", "last"])

        for chunk in batches:
            numbers = chunk.column(chunk.schema.get_field_index("batch")).to_numpy()
            body = chunk.select(columns)
            keys, key_type = body.column(columns.index(key)), body.schema.field(key).type
            at = 0
            while at < len(numbers):
                end = at + int((numbers[at:] == numbers[at]).argmin() or len(numbers) - at)
                if writer is None or numbers[at] != now:
                    if writer is not None:
                        yield close()
                    now, count, first = int(numbers[at]), 0, keys[at].as_py()
                    token = uuid.uuid4().hex
                    sink = files.open_output_stream(f"{folder}/.{token}")
                    writer = pa.ipc.new_file(sink, body.schema)
                writer.write_batch(body.slice(at, end - at))
                count, last = count + end - at, keys[end - 1].as_py()
                at = end
        if writer is not None:
            yield close()

    each = max(1, TASK_ROWS // rows)  # batches of a task
    tasks = (placed.agg(F.max("batch")).first()[0] or 0) // each + 1
    dealt = placed.repartitionById(tasks, F.floor(F.col("batch") / each).cast("int")).sortWithinPartitions("batch", "_row")
    done = dealt.select(*columns, "batch").mapInArrow(write, f"batch bigint, rows bigint, first {kind}, last {kind}")
    return written(done, "batches").orderBy("batch")


def read_batches(dest: str) -> Iterator[pa.Table]:
    """The batches in order, one in memory at a time."""
    files, folder = _open(dest)
    names = sorted(f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("batch-"))
    for name in names:
        with files.open_input_file(name) as source:
            yield pa.ipc.open_file(source).read_all()
