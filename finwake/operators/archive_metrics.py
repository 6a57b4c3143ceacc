"""Budget-level metrics computed from per-day counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finwake.functions.ranges import RANGE_ROWS, sums_before, with_ranges


def day_counts(days: DataFrame) -> DataFrame:
    """n_d accounts and n_positive positive accounts of each day."""
    return days.groupBy("day").agg(F.count("*").alias("n_d"), F.sum("label").cast("bigint").alias("n_positive"))


def _per_budget(counts: DataFrame, budgets) -> DataFrame:
    ks = F.array(*[F.lit(int(k)) for k in budgets])
    return counts.select("*", F.explode(ks).alias("budget"))


def recall_ceiling(counts: DataFrame, budgets=(50, 100, 500)) -> DataFrame:
    """Best reachable recall per budget, and how its numerator splits."""
    caught = F.least("budget", "n_positive")
    c = _per_budget(counts, budgets).groupBy("budget")
    total = F.sum("n_positive")
    return c.agg(
        F.sum(caught).cast("bigint").alias("ceiling_count"),
        F.coalesce(F.sum(F.when(F.col("n_positive") > F.col("budget"), caught)), F.lit(0))
        .cast("bigint")
        .alias("budget_limited"),
        F.coalesce(F.sum(F.when(F.col("n_positive") <= F.col("budget"), caught)), F.lit(0))
        .cast("bigint")
        .alias("positive_limited"),
        (F.sum(caught).cast("double") / F.nullif(total, F.lit(0))).alias("recall_ceiling"),
    )


def alert_slots(counts: DataFrame, budgets=(50, 100, 500)) -> DataFrame:
    return _per_budget(counts, budgets).groupBy("budget").agg(F.sum(F.least("budget", "n_d")).cast("bigint").alias("slots"))


def nonbinding_days(counts: DataFrame, budgets=(50, 100, 500)) -> DataFrame:
    """Days on which the whole population fits in the budget."""
    return _per_budget(counts, budgets).groupBy("budget").agg(F.count_if(F.col("n_d") <= F.col("budget")).alias("days"))


def random_null_precision(counts: DataFrame, budgets=(50, 100, 500)) -> DataFrame:
    """Expected precision of a random ranking under each budget (6 decimals)."""
    slots = F.least("budget", "n_d")
    expected = F.sum(slots * F.col("n_positive") / F.nullif(F.col("n_d"), F.lit(0)))
    return _per_budget(counts, budgets).groupBy("budget").agg(F.round(expected / F.sum(slots), 6).alias("precision"))


def volume_profile(tx: DataFrame) -> DataFrame:
    """Transfers, positives and prevalence (6 decimals) per date."""
    return tx.groupBy(F.col("event_date").alias("day")).agg(
        F.count("*").alias("transactions"),
        F.sum("is_laundering").cast("bigint").alias("laundering"),
        F.round(F.sum("is_laundering").cast("double") / F.count("*"), 6).alias("prevalence"),
    )


def first_thin_day(tx: DataFrame, share: float = 0.01) -> DataFrame:
    """First day with fewer than ``share`` of the median day's transfers."""
    daily = tx.groupBy(F.col("event_date").alias("day")).agg(F.count("*").alias("n"))
    median = daily.agg(F.percentile("n", F.lit(0.5)).alias("median_n"))
    return daily.crossJoin(F.broadcast(median)).agg(  # one-row scalar
        F.max("median_n").alias("median_n"), F.min(F.when(F.col("n") < share * F.col("median_n"), F.col("day"))).alias("day")
    )


def segment_metrics(ranked: DataFrame, boundary: str, budgets=(50, 100, 500)) -> DataFrame:
    """Precision and recall per budget before and from a boundary day, by one pass of conditional sums."""
    part = F.when(F.col("day") < F.lit(boundary).cast("date"), "head").otherwise("tail").alias("segment")
    sums = [F.sum("label").alias("all")]
    for k in budgets:
        within = F.col("rank") <= int(k)
        sums += [F.count_if(within).alias(f"n_{k}"), F.coalesce(F.sum(F.when(within, F.col("label"))), F.lit(0)).alias(f"hit_{k}")]
    totals = ranked.groupBy(part).agg(*sums)
    rows = F.array(*[F.struct(F.lit(int(k)).alias("budget"), F.col(f"n_{k}").alias("n"), F.col(f"hit_{k}").alias("hit")) for k in budgets])
    each = totals.select("segment", "all", F.inline(rows))
    share = lambda whole: F.col("hit").cast("double") / F.nullif(F.col(whole), F.lit(0))
    return each.select("segment", "budget", share("n").alias("precision"), share("all").alias("recall"))


def _score_groups(scored: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """Positives and negatives per distinct score, with running counts from the top.

    Only distinct scores reach the running window, which runs in two levels: scores are cut into
    ranges of about ``rows``, as many as that takes, and each range is summed; a range's
    counts start from the sums of the ranges before it.
    """
    y = F.col("is_laundering").cast("bigint")
    g = scored.filter("score is not null and not isnan(score)").groupBy("score")
    g = g.agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")).withColumn("_tie", F.lit(0))
    g = with_ranges(g, [], "score", "_tie", rows).drop("_tie")
    before = sums_before(g.groupBy("_range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), [], ["pos", "neg"])
    w = Window.partitionBy("_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    g = g.join(before, "_range")
    return g.withColumns({"tp": F.col("pos0") + F.sum("pos").over(w), "fp": F.col("neg0") + F.sum("neg").over(w)})


def ranking_quality(scored: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """ROC AUC (ties count half) and step-wise average precision, 9 decimals."""
    g = _score_groups(scored, rows)
    total_p, total_n = F.nullif(F.sum("pos"), F.lit(0)), F.nullif(F.sum("neg"), F.lit(0))
    wins = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")))
    precision = F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))
    return g.agg(
        F.round(wins.cast("double") / 2 / total_p / total_n, 9).alias("roc_auc"),
        F.round(F.sum(precision * F.col("pos")) / total_p, 9).alias("average_precision"),
    )
