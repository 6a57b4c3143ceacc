"""Column expressions of the stateless transaction features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_amount(col: Column) -> Column:
    """ln(1 + x); NULL when x <= -1."""
    return F.log(F.lit(1.0) + col)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, NULL for a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def roundness(amount: Column) -> Column:
    """3 for whole thousands, 2 for hundreds, 1 for whole units, else 0 (NULL: 0)."""
    out = F
    for digits, level in ((-3, 3), (-2, 2), (0, 1)):
        out = out.when(amount == F.round(amount, digits), level)
    return out.otherwise(0)


def differs(a: Column, b: Column) -> Column:
    return (a != b).cast("tinyint")


def weekday(ts: Column) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(ts) - 1


def category_code(col: Column) -> Column:
    """Stable code 0..999 from the first 32 bits of md5; NULL maps to md5('')."""
    digest = F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return (F.conv(digest, 16, 10).cast("bigint") % 1000).cast("bigint")


def seconds_between(later: str, earlier: str) -> Column:
    """Elapsed seconds with microsecond precision, as double."""
    return F.expr(f"timestampdiff(MICROSECOND, {earlier}, {later}) / 1e6D")
