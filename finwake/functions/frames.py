"""Trailing time-range frames that end one minute before the current row.

Spark needs both bounds of an interval frame in one interval type, so every
bound is a full DAY TO SECOND literal.
"""

from __future__ import annotations

GAP = "INTERVAL '0 00:01:00' DAY TO SECOND PRECEDING"
DAYS = {"1d": 1, "7d": 7, "30d": 30}


def days_literal(days: int) -> str:
    return f"INTERVAL '{days} 00:00:00' DAY TO SECOND"


def trailing(days: int, keys: str = "account_id", order: str = "event_time") -> str:
    """OVER clause of the inclusive frame [t - days, t - 1 minute]."""
    return f"(PARTITION BY {keys} ORDER BY {order} RANGE BETWEEN {days_literal(days)} PRECEDING AND {GAP})"


def before(keys: str = "account_id", order: str = "event_time") -> str:
    """OVER clause of everything up to and including t - 1 minute."""
    return f"(PARTITION BY {keys} ORDER BY {order} RANGE BETWEEN UNBOUNDED PRECEDING AND {GAP})"


def expired(days: int, keys: str = "account_id", order: str = "event_time") -> str:
    """OVER clause of everything strictly older than t - days (microsecond clock)."""
    bound = f"INTERVAL '{days} 00:00:00.000001' DAY TO SECOND PRECEDING"
    return f"(PARTITION BY {keys} ORDER BY {order} RANGE BETWEEN UNBOUNDED PRECEDING AND {bound})"
