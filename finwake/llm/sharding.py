"""Sharding by a two-pass external shuffle.

Pass one scatters every record into one of many buckets by a seeded hash of its key, its
text and a salt: the number of the record among equal ones of its input partition, with
that partition's number. So equal records are scattered like all others. The number of
buckets follows the counted bytes; a bucket holds about ``bucket_bytes`` of text. Pass two
takes one bucket at a time into memory, puts it in a canonical order, runs Fisher-Yates on
it with a generator seeded by (seed, bucket) and writes it. Buckets in order form one
random permutation of all records; shards are equal consecutive cuts of it (law ``rows``:
counts differ by one at most). Recomputed tasks give the same order, whatever order rows
arrive in: salts and the canonical order depend on what a partition holds only.

Edge cases: a null text counts as empty (size 1); equal records are separate records,
their mutual order is immaterial; an empty table gives an empty result; other columns
are kept, a clash with an added name is an error named up front. One very long text
makes its bucket larger by its own size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finwake.llm.store import materialise, runs_of, salts, text_bytes

ADDED = ["shard", "slot", "position"]
TASKS = 20_000  # more buckets than this share tasks, consecutive ones together; still one in memory at a time
COARSE = 1024  # buckets whose sizes are added up first


def bucket_count(bytes_in: int, bucket_bytes: int) -> int:
    return max(1, math.ceil(bytes_in / bucket_bytes))


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of range(n): for i from n-1 down, swap i with a draw from 0..i."""
    rng = np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, bucket]))
    draws = rng.integers(0, np.arange(n, 0, -1)) if n else np.zeros(0, np.int64)
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), draws.tolist()):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _permuted(batches: Iterator[pa.RecordBatch], bucket: str, rank: str, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by bucket and canonical key; one bucket is in memory at a time."""
    for table in runs_of(batches, bucket):
        table = table.combine_chunks()
        order = fisher_yates(table.num_rows, seed, table.column(bucket)[0].as_py())
        at = table.schema.get_field_index(rank)
        table = table.take(pa.array(order)).set_column(at, table.schema.field(at), pa.array(np.arange(len(order)), pa.int64()))
        yield from table.to_batches(max_chunksize=2048)


def shuffle_into_shards(
    records: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = 42, bucket_bytes: int = 24 << 20
) -> DataFrame:
    """All columns of ``records`` plus shard, slot (gapless from 0 in its shard) and position.

    ``bucket_bytes`` bounds the text that pass two holds at once.
    """
    clash = {c.lower() for c in records.columns} & {a.lower() for a in [*ADDED, "_bucket", "_rank", "_hash"]}
    if clash:
        raise ValueError(f"columns clash with the result: {sorted(clash)}")
    buckets = bucket_count(text_bytes(records, text), bucket_bytes)
    hashed = records.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(key), F.col(text)))
    spread = F.pmod(F.xxhash64("_hash", F.spark_partition_id(), "_rank"), F.lit(buckets)).cast("int")
    scattered = salts(hashed, "_hash", "_rank").withColumn("_bucket", spread).drop("_hash")
    tasks = min(buckets, TASKS)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in scattered.schema])
    shuffled = (
        scattered.repartitionById(tasks, F.expr(f"cast(cast(_bucket as bigint) * {tasks}L div {buckets}L as int)"))
        .sortWithinPartitions("_bucket", F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first())
        .mapInArrow(lambda batches: _permuted(batches, "_bucket", "_rank", seed), schema)
    )
    placed = materialise(shuffled, "shuffled")  # pass two writes each bucket; sizes are counted from what was written
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_coarse", F.expr(f"_bucket div {COARSE}"))
    before = lambda order: Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # sums over groups of buckets first: one row a thousand buckets meets in one place
    groups = counts.groupBy("_coarse").agg(F.sum("_n").alias("_m"))
    groups = groups.select("_coarse", F.coalesce(F.sum("_m").over(before("_coarse")), F.lit(0)).alias("_base"), F.sum("_m").over(Window.partitionBy()).alias("_all"))
    inner = Window.partitionBy("_coarse").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(groups, "_coarse")
    offsets = offsets.select("_bucket", (F.col("_base") + F.col("_in")).alias("_at"), "_all")
    # one row per bucket, far below the rows themselves
    out = placed.join(F.broadcast(offsets), "_bucket") if buckets <= 100_000 else placed.join(offsets, "_bucket")
    position = F.col("_at") + F.col("_rank")
    # integer arithmetic: shard s starts at ceil(s * all / n)
    lo = F.expr(f"(_at + _rank) * {n_shards}L div _all")
    start = F.expr(f"(((_at + _rank) * {n_shards}L div _all) * _all + {n_shards - 1}L) div {n_shards}L")
    return out.select(*records.columns, lo.cast("int").alias("shard"), (position - start).alias("slot"), position.alias("position"))


def digest(records: DataFrame, n_shards: int = 8) -> DataFrame:
    """The contract rows of query op2: sizes, checksums and places of all records."""
    placed = shuffle_into_shards(records.select("doc_id", "text"), n_shards)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return placed.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).cast("bigint").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
