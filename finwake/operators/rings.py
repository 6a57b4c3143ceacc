"""Splitting by time so that no ring of accounts stands on both sides, and how labels and rings agree.

``rings`` names the transfers of rings: (txn_id, ring_id), a transfer in any number of rings. Rings that
share an account, directly or through others, are one group. A group with a transfer before the cut
belongs to the past; the later transfers of such groups are dropped from the test part, so that
no account of a test ring was in a ring before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finwake.operators.model import parts
from finwake.sources.shared import written


def groups_of(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of (a, b).

    Every node takes the smallest root among its neighbours and then its root's root, so
    distances halve; each turn is two groupings and a join, written before the next. The turns end
    when none changes a root.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ring-edges")
    roots = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "ring-roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("least"))
        lower = roots.join(near, F.col("node") == F.col("a"))
        # a root follows the smallest root that any of its members met
        hook = lower.groupBy("root").agg(F.min("least").alias("to"))
        hook = hook.select(F.col("root").alias("from"), F.least("to", "root").alias("to"))
        jump = hook.select(F.col("from").alias("to"), F.col("to").alias("onward"))
        onward = hook.join(jump, "to", "left").select(F.col("from").alias("root"), F.coalesce("onward", "to").alias("next"))
        new = written(roots.join(onward, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "ring-roots")
        if new.filter("moved").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")


def ring_groups(tx: DataFrame, rings: DataFrame) -> DataFrame:
    """(ring_id, group, starts): the group of each ring and the time of the group's first transfer."""
    inside = tx.select("txn_id", "event_time", "sender_id", "receiver_id").join(rings.select("txn_id", "ring_id").distinct(), "txn_id")
    ring = F.concat(F.lit("r"), F.col("ring_id").cast("string"))
    account = F.explode(F.array("sender_id", "receiver_id"))
    edges = inside.select(ring.alias("a"), account.alias("account")).filter("account is not null").select("a", F.concat(F.lit("="), "account").alias("b"))
    roots = groups_of(edges)
    named = inside.select("ring_id", ring.alias("node"), "event_time").groupBy("ring_id", "node").agg(F.min("event_time").alias("first"))
    named = named.join(roots, "node", "left").select("ring_id", F.coalesce("root", "node").alias("group"), "first")
    starts = named.groupBy("group").agg(F.min("first").alias("starts"))
    return named.join(starts, "group").select("ring_id", "group", "starts")


def ring_split(tx: DataFrame, rings: DataFrame, cut: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, report): the parts of ``tx``, and one row of ring counts of the test part."""
    groups = written(ring_groups(tx, rings), "ring-groups")
    moment = F.lit(cut).cast("timestamp_ntz")
    early, late = parts(cut)
    member = rings.select("txn_id", "ring_id").distinct().join(groups, "ring_id")
    old = member.filter(F.col("starts") < moment).select("txn_id").distinct()
    train, test = tx.filter(early), tx.filter(late).join(old, "txn_id", "left_anti").select(*tx.columns)
    seen = tx.filter(late).select("txn_id").join(member, "txn_id").select("ring_id", "starts").distinct()
    report = seen.agg(
        F.count("*").alias("test_rings_before_drop"),
        F.count_if(F.col("starts") < moment).alias("dropped_rings"),
        F.count_if(F.col("starts") >= moment).alias("test_rings_kept"),
    )
    share = 100 * F.col("dropped_rings") / F.nullif(F.col("test_rings_before_drop"), F.lit(0))
    return train, test, report.withColumn("dropped_pct", F.round(share, 2))


def reconcile(tx: DataFrame, rings: DataFrame) -> DataFrame:
    """One row: labelled transfers, ring transfers, both, either alone, and the share of labelled ones in a ring."""
    ring = rings.select("txn_id", F.lit(True).alias("_ring")).distinct()
    both = tx.select("txn_id", (F.coalesce("is_laundering", F.lit(0)) == 1).alias("labelled")).join(ring, "txn_id", "left")
    inside = F.col("_ring").isNotNull()
    out = both.agg(
        F.count_if(F.col("labelled")).alias("labelled"),
        F.count_if(inside).alias("in_rings"),
        F.count_if(F.col("labelled") & inside).alias("labelled_in_rings"),
        F.count_if(F.col("labelled") & ~inside).alias("labelled_only"),
        F.count_if(~F.col("labelled") & inside).alias("rings_only"),
    )
    share = 100 * F.col("labelled_in_rings") / F.nullif(F.col("labelled"), F.lit(0))
    return out.withColumn("covered_pct", F.round(share, 2))
