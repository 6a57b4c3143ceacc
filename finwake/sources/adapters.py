"""Views of general test tables as transfer relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finwake.operators.history import tasks_for
from finwake.sources.transactions import normalize

FEW = 500_000  # rows of two numbers that may be broadcast


def from_events(events: DataFrame) -> DataFrame:
    """Event stream rows as transfers: user -> user + id % 11, minute-granular."""
    e = events.select("event_id", "ts", "user_id", "event_type", "value")
    e = e.withColumn("peer", F.col("user_id") + F.col("event_id") % 11)
    name = lambda c: F.concat(F.lit("A"), F.lpad(F.col(c).cast("string"), 4, "0"))
    bank = lambda c, other: F.when(F.col(c) % 10 == 0, "010").otherwise(other)
    euro = lambda n: F.when(F.col("event_id") % n == 3, "EUR").otherwise("USD")
    out = e.select(
        (F.col("event_id") + 1).alias("txn_id"),
        F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz").alias("event_time"),
        F.col("ts").cast("date").alias("event_date"),
        name("user_id").alias("sender_id"),
        name("peer").alias("receiver_id"),
        bank("user_id", "011").alias("sender_bank"),
        bank("peer", "012").alias("receiver_bank"),
        F.when(F.col("event_id") % 10 == 0, F.round("value", 0) * 100).otherwise(F.col("value")).alias("amount_paid"),
        F.when(F.col("event_id") % 5 == 0, F.col("value") * 0.92).otherwise(F.col("value")).alias("amount_received"),
        euro(10).alias("payment_currency"),
        euro(7).alias("receiving_currency"),
        F.upper("event_type").alias("payment_format"),
        ((F.col("value") > 110) & (F.col("event_id") % 11 != 0)).cast("tinyint").alias("is_laundering"),
    )
    return normalize(out)


def from_lineitem(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Order lines as day-granular, tie-heavy transfers customer -> supplier.

    The partitions of the joins follow the rows of the larger side.
    """
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    digest = F.xxhash64(*key)
    customer, supplier = customer.select("c_custkey", "c_nationkey"), supplier.select("s_suppkey", "s_nationkey")

    def meet(left: DataFrame, right: DataFrame, a: str, b: str, rows: int) -> DataFrame:
        n = tasks_for(rows)
        return left.repartition(n, a).join(right.repartition(n, b), F.col(a) == F.col(b))

    lines, suppliers = lineitem.count(), supplier.count()
    placed = meet(orders.select("o_orderkey", "o_custkey", "o_orderpriority"), customer, "o_custkey", "c_custkey", max(orders.count(), customer.count()))
    j = meet(lineitem, placed, "l_orderkey", "o_orderkey", lines)
    if suppliers <= FEW:
        j = j.join(F.broadcast(supplier), F.col("l_suppkey") == F.col("s_suppkey"))
    else:
        j = meet(j, supplier, "l_suppkey", "s_suppkey", max(lines, suppliers))
    euro = lambda c: F.when(F.col(c) % 2 == 1, "EUR").otherwise("USD")
    return normalize(
        j.select(
            digest.alias("txn_id"),
            F.col("l_shipdate").cast("timestamp_ntz").alias("event_time"),
            F.col("l_shipdate").cast("date").alias("event_date"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("sender_id"),
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("receiver_id"),
            F.col("c_nationkey").cast("string").alias("sender_bank"),
            F.col("s_nationkey").cast("string").alias("receiver_bank"),
            F.col("l_extendedprice").alias("amount_paid"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount_received"),
            euro("c_nationkey").alias("payment_currency"),
            euro("s_nationkey").alias("receiving_currency"),
            F.col("o_orderpriority").alias("payment_format"),
            ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)).cast("tinyint").alias("is_laundering"),
        )
    )


def load_events_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def load_lineitem_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer", "supplier"))
    return from_lineitem(*tables)
