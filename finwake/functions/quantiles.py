"""Exact quantiles of any number of rows, by narrowing a histogram around the wanted order statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024
FEW = 10_000  # values that are few enough to look at one by one


def _order_statistics(values: DataFrame, low: float, high: float, wanted: list[int]) -> list[float]:
    """The values at the places ``wanted`` (from 0, ascending) of the rows between ``low`` and ``high``."""
    v = F.col("v")
    while low < high:
        # halves, so that the widest range does not overflow
        share = (v / 2 - low / 2) / F.lit(high / 2 - low / 2)
        inside = values.filter(v.between(low, high)).select("v", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"))
        bins = inside.groupBy("bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin").collect()
        before, hit = 0, []
        for b in bins:
            here = [k for k in wanted if before <= k < before + b.n]
            if here:
                hit.append((b, before, here))
            before += b.n
        if len(hit) > 1:  # neighbours on both sides of a bin's edge: the last of one and the first of the other
            return [b.high if k == start + b.n - 1 else b.low for b, start, here in hit for k in here]
        b, start, here = hit[0]
        low, high, wanted = b.low, b.high, [k - start for k in here]
        if b.n <= FEW and low < high:
            few = sorted(r.v for r in values.filter(v.between(low, high)).collect())
            return [few[k] for k in wanted]
    return [low] * len(wanted)


def exact_quantile(frame: DataFrame, column: str, q: float) -> float | None:
    """The continuous ``q``-quantile (linear between neighbours) of the values that are neither null nor NaN; None without any.

    Each turn is one aggregate of at most ``BINS`` rows a task and shrinks the range by about as much,
    so no task or driver ever holds more than ``FEW`` values.
    """
    values = frame.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    ends = values.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not ends.n:
        return None
    place = q * (ends.n - 1)
    lower, upper = math.floor(place), math.ceil(place)
    found = _order_statistics(values, ends.low, ends.high, sorted({lower, upper}))
    return found[0] + (found[-1] - found[0]) * (place - lower)
