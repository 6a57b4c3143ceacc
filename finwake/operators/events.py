"""Two account perspectives of each transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_COLUMNS = ["txn_id", "side", "account_id", "counterparty", "event_time", "amount_paid", "is_out"]


def two_sided(tx: DataFrame, *carry: str) -> DataFrame:
    """Sender and receiver rows from one scan; ``carry`` columns ride along."""
    side = lambda s, account, other, out: F.struct(
        F.lit(s).alias("side"),
        F.col(account).alias("account_id"),
        F.col(other).alias("counterparty"),
        F.lit(out).alias("is_out"),
    )
    both = F.array(side("s", "sender_id", "receiver_id", 1), side("r", "receiver_id", "sender_id", 0))
    return tx.select("txn_id", "event_time", "amount_paid", *carry, F.inline(both)).select(*EVENT_COLUMNS, *carry)


def two_sided_union(tx: DataFrame) -> DataFrame:
    """The same rows as a UNION ALL of two projections (two scans)."""
    one = lambda s, account, other, out: tx.select(
        "txn_id",
        F.lit(s).alias("side"),
        F.col(account).alias("account_id"),
        F.col(other).alias("counterparty"),
        "event_time",
        "amount_paid",
        F.lit(out).alias("is_out"),
    )
    return one("s", "sender_id", "receiver_id", 1).unionByName(one("r", "receiver_id", "sender_id", 0))
