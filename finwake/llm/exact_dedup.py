"""Exact duplicates by counting quotient filters.

1. Each partition builds a counting quotient filter of its texts' 64-bit fingerprints:
   the high bits (quotient) name a slot, the low bits (remainder) are kept sorted in
   the slot's run, each with a count. A filter is held as its sorted runs.
2. Filters merge losslessly: their slots are dealt by quotient range and the runs of a
   range are merged by sorted remainders, adding counts; nothing is rounded or dropped.
3. Texts whose fingerprint has a count above one are compared byte by byte: they are
   grouped by the whole normalised text. All others are alone and need no comparison.

The row that stays is the one with most code points in its original text, then the
smallest id, then (of rows alike in both) the first one written. Groups are reduced before
any shuffle (partial aggregation), so a group with a third of all rows sends one row per task.

Edge cases: null text counts as empty, as does a text of white space only; null ids sort
first; repeated rows and ids form one group of which exactly one row is kept; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finwake.llm.store import materialise

RANGE_ROWS = 1 << 20  # about so many fingerprints meet in a merge task
MAX_BROADCAST_ROWS = 20_000  # proven by a count before any broadcast


def normalised(text: Column) -> Column:
    """The text without white space (0x20, 0x09-0x0D); null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def build_filter(fingerprints: np.ndarray, bits: int) -> list[tuple[int, bytes, bytes]]:
    """(quotient, sorted distinct remainders, their counts) of one partition."""
    values, counts = np.unique(fingerprints, return_counts=True)
    quotients = (values >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(quotients)) + 1
    starts = np.concatenate([[0], cuts]) if len(values) else []
    ends = np.concatenate([cuts, [len(values)]]) if len(values) else []
    mask = np.uint64((1 << (64 - bits)) - 1)
    return [
        (int(quotients[a]), (values[a:b] & mask).tobytes(), counts[a:b].astype(np.uint32).tobytes())
        for a, b in zip(starts, ends)
    ]


def merge_runs(runs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct remainders of all runs with summed counts."""
    remainders = np.concatenate([np.frombuffer(r, np.uint64) for r, _ in runs])
    counts = np.concatenate([np.frombuffer(c, np.uint32) for _, c in runs]).astype(np.int64)
    order = np.argsort(remainders, kind="stable")
    remainders, counts = remainders[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], remainders[1:] != remainders[:-1]]))
    return remainders[first], np.add.reduceat(counts, first)


def partition_filters(fingerprints: DataFrame, column: str, bits: int) -> DataFrame:
    """One row per partition and quotient: quotient, remainders, counts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for b in batches]
        runs = build_filter(np.concatenate(seen) if seen else np.zeros(0, np.uint64), bits)
        if runs:
            q, r, c = zip(*runs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(r, pa.binary()), pa.array(c, pa.binary())], ["quotient", "remainders", "counts"]
            )

    return fingerprints.select(column).mapInArrow(build, "quotient bigint, remainders binary, counts binary")


def repeated_fingerprints(fingerprints: DataFrame, column: str, bits: int) -> DataFrame:
    """Fingerprints that occur more than once, with their counts: (fingerprint, copies)."""

    def merge(table: pa.Table) -> pa.Table:
        quotient = np.uint64(table.column("quotient")[0].as_py())
        runs = list(zip(table.column("remainders").to_pylist(), table.column("counts").to_pylist()))
        remainders, counts = merge_runs(runs)
        many = counts > 1
        values = (quotient << np.uint64(64 - bits)) | remainders[many]
        return pa.table({"fingerprint": pa.array(values.view(np.int64)), "copies": pa.array(counts[many], pa.int64())})

    filters = partition_filters(fingerprints, column, bits)
    return filters.groupBy("quotient").applyInArrow(merge, "fingerprint bigint, copies bigint")


def quotient_bits(rows: int) -> int:
    """High bits that deal runs to merge tasks: as many quotients as ranges of ``RANGE_ROWS`` rows, 256 at least."""
    return max(8, math.ceil(math.log2(max(1, rows) / RANGE_ROWS)))


def exact_groups(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256, fingerprint_copies (1: never compared)."""
    body = normalised(F.col(text))
    facts = documents.select(
        F.col(key).alias("_id"),
        F.xxhash64(body).alias("_fp"),
        F.sha2(body, 256).alias("_sha"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("_len"),
        F.monotonically_increasing_id().alias("_row"),  # written, so it stays what it is
    )
    facts = materialise(facts, "exact-facts")
    repeated = materialise(repeated_fingerprints(facts, "_fp", quotient_bits(facts.count())), "exact-repeated")
    small = repeated.count() <= MAX_BROADCAST_ROWS
    marks = (F.broadcast(repeated) if small else repeated).withColumnRenamed("fingerprint", "_fp")
    # byte verification: only texts with a repeated fingerprint, grouped by their bytes
    suspects = documents.select(F.xxhash64(body).alias("_fp"), body.alias("_body"))
    suspects = suspects.join(marks.select("_fp"), "_fp", "left_semi")
    groups = suspects.groupBy("_fp", F.sha2("_body", 256).alias("_sha"), "_body").agg(F.count("*").alias("group_size"))
    best = F.min(F.struct((-F.col("_len")).alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    stays = facts.join(marks, "_fp").groupBy("_fp", "_sha").agg(best.alias("best"), F.first("copies").alias("copies"))
    groups = groups.drop("_body").join(stays, ["_fp", "_sha"])
    out = facts.join(F.broadcast(groups) if small else groups, ["_fp", "_sha"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("_id").alias(key),
        F.when(alone, F.col("_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("_row") == F.col("best.row"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("fingerprint_copies"),
    )


ORACLE_SQL = r"""WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body, length(coalesce(text, '')) AS len FROM documents),
g AS (
  SELECT doc_id, sha256(body) AS text_sha256, count(*) OVER (PARTITION BY body) AS group_size,
    row_number() OVER (PARTITION BY body ORDER BY len DESC, doc_id) = 1 AS kept,
    first_value(doc_id) OVER (PARTITION BY body ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS fingerprint_copies FROM n)
SELECT doc_id, keep_id, group_size, kept, text_sha256, fingerprint_copies FROM g"""
