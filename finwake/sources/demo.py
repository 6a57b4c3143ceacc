"""Deterministic synthetic transfers with the shape of the public demo data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finwake.functions.quantiles import exact_quantile
from finwake.sources.transactions import normalize

# Fixed values of the demo distribution.
ACCOUNTS = 400
DAYS = 45
START = "2024-01-01 00:00:00"
MU, SIGMA = 6.5, 1.2
TAIL = 0.96


def uniform(key: str, seed: int, salt: str) -> Column:
    """A double in [0, 1) that depends on the row key, seed and salt only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed), F.lit(salt)), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


GAP_UNIT = float(1 << 20)
BLOCK = 100_000


def sorted_uniforms(spark: SparkSession, rows: int, draw: Column, block: int = BLOCK) -> DataFrame:
    """(id, share): ``rows`` uniform numbers in [0, 1), ascending with the id; ``draw`` is a uniform column of the id."""
    gaps = spark.range(rows + 1).select("id", F.floor(F.col("id") / block).alias("_block"), F.round(-F.log(F.lit(1.0) - draw) * GAP_UNIT).cast("bigint").alias("gap"))
    sums = gaps.groupBy("_block").agg(F.sum("gap").alias("n"))
    above = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = sums.select("_block", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("all"))
    within = Window.partitionBy("_block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    placed = gaps.withColumn("run", F.sum("gap").over(within)).join(starts, "_block").filter(F.col("id") < rows)
    return placed.select("id", ((F.col("start") + F.col("run")) / F.col("all")).alias("share"))


def make_transactions(spark: SparkSession, rows: int = 12_000, seed: int = 7) -> DataFrame:
    """``rows`` transfers over 45 days among 400 accounts; no value depends on partitioning.

    Times are sorted uniform minutes, made without a sort: sums of exponential gaps, divided by
    the sum of all, are distributed as sorted uniforms. Gaps are whole numbers, so sums do not
    depend on their order; they run within blocks of ids, on top of the sums of earlier blocks.
    """
    u = lambda salt: uniform("id", seed, salt)
    account = lambda salt: F.format_string("A%04d", F.floor(u(salt) * ACCOUNTS).cast("int"))
    normal = F.sqrt(-2.0 * F.log(F.lit(1.0) - u("r"))) * F.cos(2.0 * F.pi() * u("phi"))
    minute = F.least(F.floor(F.col("share") * DAYS * 1440), F.lit(DAYS * 1440 - 1)).cast("int")
    base = sorted_uniforms(spark, rows, u("minute")).select(
        "id",
        account("sender").alias("sender_id"),
        account("receiver").alias("receiver_id"),
        F.round(F.exp(F.lit(MU) + F.lit(SIGMA) * normal), 2).alias("amount_paid"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute)).alias("event_time"),
        F.when(u("fx") < 0.8, 1.0).when(u("fx") < 0.9, 0.92).otherwise(1.08).alias("fx"),
        F.when(u("pay") < 0.9, "USD").otherwise("EUR").alias("payment_currency"),
        F.when(u("recv") < 0.9, "USD").otherwise("EUR").alias("receiving_currency"),
        F.element_at(F.array(F.lit("ACH"), F.lit("WIRE"), F.lit("CARD")), F.floor(u("fmt") * 3).cast("int") + 1).alias(
            "payment_format"
        ),
    )
    cut = exact_quantile(base, "amount_paid", TAIL)
    bank = lambda c, other: F.when(F.col(c).endswith("0"), "010").otherwise(other)
    return normalize(
        base.select(
            (F.col("id") + 1).alias("txn_id"),
            "event_time",
            F.col("event_time").cast("date").alias("event_date"),
            "sender_id",
            "receiver_id",
            bank("sender_id", "011").alias("sender_bank"),
            bank("receiver_id", "012").alias("receiver_bank"),
            "amount_paid",
            (F.col("amount_paid") * F.col("fx")).alias("amount_received"),
            "payment_currency",
            "receiving_currency",
            "payment_format",
            ((F.col("amount_paid") > F.lit(cut)) & (F.col("sender_id") != F.col("receiver_id")))
            .cast("tinyint")
            .alias("is_laundering"),
        )
    )


def make_demo(spark: SparkSession, path: str, rows: int = 12_000, seed: int = 7) -> str:
    make_transactions(spark, rows, seed).coalesce(1).write.mode("overwrite").parquet(path)
    return path
