"""Account-day alerts and review-budget metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finwake.functions.ranges import RANGE_ROWS, sums_before, with_ranges

BUDGETS = (50, 100, 500)


def account_days(scored: DataFrame) -> DataFrame:
    """One row per (day, account): the best score and label of its transfers.

    ``scored`` needs event_date, sender_id, receiver_id, is_laundering, score.
    NaN scores count as missing; rows without a day or account are left out.
    """
    both = scored.select(
        F.col("event_date").alias("day"),
        F.explode(F.array("sender_id", "receiver_id")).alias("account"),
        F.nanvl(F.col("score").cast("double"), F.lit(None).cast("double")).alias("score"),
        F.col("is_laundering").alias("label"),
    ).filter("day is not null and account is not null")
    return both.groupBy("day", "account").agg(F.max("score").alias("score"), F.max("label").alias("label"))


def daily_rank(days: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """Rank accounts within the day by score, ties by account; no rank without a score.

    A day is cut into ranges of about ``rows`` accounts along that order. Ranks are the accounts
    of the ranges before, plus the place within the range, so no task holds a day, nor a
    score that many accounts share. Rows without a score take no part.
    """
    scored = with_ranges(days.filter("score is not null"), ["day"], "score", "account", rows)
    before = sums_before(scored.groupBy("day", "_range").agg(F.count("*").alias("n")), ["day"], ["n"])
    w = Window.partitionBy("day", "_range").orderBy(F.desc("score"), F.asc("account"))
    ranked = scored.withColumn("_place", F.row_number().over(w)).join(before, ["day", "_range"])
    ranked = ranked.select(*days.columns, (F.col("n0") + F.col("_place")).cast("int").alias("rank"))
    return ranked.unionByName(days.filter("score is null").withColumn("rank", F.lit(None).cast("int")))


def alerts(scored: DataFrame, budget: int) -> DataFrame:
    """The accounts within one daily budget (planned as a per-day top-k)."""
    w = Window.partitionBy("day").orderBy(F.desc_nulls_last("score"), F.asc("account"))
    ranked = account_days(scored).withColumn("rank", F.row_number().over(w))
    return ranked.filter((F.col("rank") <= budget) & F.col("score").isNotNull())


def budget_metrics(scored: DataFrame, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """One row: account_days, positive_account_days, precision@k and recall@k.

    Ranks beyond the largest budget are never needed, so the per-day ranking is a
    top-k; totals come from the unranked account-days in the same pass over them.
    """
    days = account_days(scored)
    totals = days.agg(
        F.count("*").alias("account_days"), F.coalesce(F.sum("label"), F.lit(0)).cast("bigint").alias("positive_account_days")
    )
    w = Window.partitionBy("day").orderBy(F.desc_nulls_last("score"), F.asc("account"))
    top = days.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(budgets))
    top = top.filter(F.col("score").isNotNull())
    sums = []
    for k in budgets:
        within = F.col("rank") <= k
        sums += [F.count_if(within).alias(f"n{k}"), F.sum(F.when(within, F.col("label"))).alias(f"tp{k}")]
    row = totals.crossJoin(top.agg(*sums))  # one row by one row
    out = ["account_days", "positive_account_days"]
    for k in budgets:
        tp = F.coalesce(F.col(f"tp{k}"), F.lit(0)).cast("double")
        out.append((tp / F.nullif(F.col(f"n{k}"), F.lit(0))).alias(f"precision@{k}"))
        out.append((tp / F.nullif(F.col("positive_account_days"), F.lit(0))).alias(f"recall@{k}"))
    return row.select(*out)
