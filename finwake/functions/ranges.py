"""Ranges of equal size along an order, from the keys themselves, so that no task has to hold a whole group.

A sample that depends on the keys only (one in ``stride`` by hash) is ranked within its
group, and every ``EVERY``-th sampled key becomes a cut. Cuts are exact keys, ties included: a
key is a pair of a score (descending) and a tie-breaker (ascending).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVERY = 16  # sampled keys in a range
RANGE_ROWS = 200_000


def cut_points(keys: DataFrame, by: list[str], score: str, tie: str, rows: int = RANGE_ROWS) -> DataFrame:
    """(*by, cuts): the sorted cut keys of each group; groups of about ``rows`` keys or fewer may have none."""
    sample = keys.filter(F.pmod(F.xxhash64(*by, score, tie), F.lit(max(1, rows // EVERY))) == 0)
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    nth = sample.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") % EVERY == 0)
    cut = F.struct("_nth", F.col(score).alias("score"), F.col(tie).alias("tie"))
    return nth.groupBy(*by).agg(F.array_sort(F.collect_list(cut)).alias("cuts"))


def range_of(cuts: str, score: str, tie: str) -> Column:
    """How many cuts stand before or at the row's key; found in two steps of the square root of their number."""
    step = F.greatest(F.ceil(F.sqrt(F.size(cuts))).cast("int"), F.lit(1))
    passed = lambda c: (c["score"] > F.col(score)) | ((c["score"] == F.col(score)) & (c["tie"] <= F.col(tie)))
    blocks = F.size(F.filter(F.filter(F.col(cuts), lambda c, i: (i + 1) % step == 0), passed))
    within = F.size(F.filter(F.slice(cuts, blocks * step + 1, step), passed))
    return F.when(F.col(cuts).isNull(), 0).otherwise(blocks * step + within)


def with_ranges(keys: DataFrame, by: list[str], score: str, tie: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``keys`` with ``_range``: 0, 1, ... along the order of each group."""
    cuts = cut_points(keys, by, score, tie, rows)
    if by:
        placed = keys.join(cuts, by, "left")
    else:
        placed = keys.crossJoin(cuts)  # one row
    return placed.withColumn("_range", range_of("cuts", score, tie)).drop("cuts")


def sums_before(sums: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(*by, _range, <value>0): the sums of all earlier ranges of the group; one row a range."""
    above = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "_range", *[F.coalesce(F.sum(v).over(above), F.lit(0)).alias(f"{v}0") for v in values])
