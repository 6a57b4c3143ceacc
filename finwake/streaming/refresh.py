"""Micro-batch upkeep of the feature table from a stream of transfers.

Analytic range frames are not available on streaming frames, so each micro-batch appends
its transfers to a store, one folder a day of event_time, and computes again what it can change:

- the transfers from its earliest day on that have an account of the batch on either side;
- their histories, from the transfers of their accounts since 31 days before that day;
- what a pair did earlier, as one time a pair, from kept state.

All other rows of the dates that are rewritten come from the feature table itself.

The kept state is a table of pairs with their last meeting before a cut, one folder a cut. A batch
takes the latest cut that is not after its own 31 days, adds the days of the store between the two,
and writes the sum as a new cut once these are ``STEP`` days or more. So no batch reads the store
before that cut, however old the store is. A cut holds as long as nothing earlier than it arrives:
a late transfer drops the cuts after it, before it is stored, and the next ones start from an earlier
cut. The last ``KEPT`` cuts stay; a transfer later than all of them costs one reading of what is older.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from finwake.functions.scalars import seconds_between
from finwake.operators.features import FEATURES, PASSTHROUGH, feature_table_onepass
from finwake.sources.sinks import read_features, write_features
from finwake.sources.transactions import COLUMNS, SCHEMA, normalize

REACH = 31  # days: the longest frame, and one for times of day
STEP = 31  # days between two cuts of the kept pairs
KEPT = 4  # cuts
RECENCY = [f"{side}_secs_since_prev_cp" for side in "sr"]
_PAIR = {"_low": F.least, "_high": F.greatest}


def _key(account: str) -> F.Column:
    """Never null and different for different accounts: missing accounts have a history too, as one account."""
    return F.coalesce(F.concat(F.lit("="), F.col(account)), F.lit(""))


def _accounts(tx: DataFrame) -> DataFrame:
    return tx.select(F.explode(F.array(_key("sender_id"), _key("receiver_id"))).alias("account")).distinct()


def _touching(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transfers with one of ``accounts`` on either side, once each."""
    for side in ("sender", "receiver"):
        hit = accounts.select(F.col("account").alias("_key"), F.lit(True).alias(f"_{side}"))
        tx = tx.withColumn("_key", _key(f"{side}_id")).join(hit, "_key", "left").drop("_key")
    return tx.filter("_sender or _receiver").select(*COLUMNS)


def _with_pair(df: DataFrame) -> DataFrame:
    return df.withColumns({name: pick(_key("sender_id"), _key("receiver_id")) for name, pick in _PAIR.items()})


def _last_meetings(tx: DataFrame) -> DataFrame:
    return _with_pair(tx.filter("event_time is not null")).groupBy(*_PAIR).agg(F.max("event_time").alias("_last"))


class PairState:
    """Last meetings of pairs before some cuts, below ``path``; only finished folders count."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, cut: dt.date | None = None):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path if cut is None else f"{self.path}/{cut}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def cuts(self) -> list[dt.date]:
        files, where = self._folder()
        found = [f.getPath() for f in files.listStatus(where)] if files.exists(where) else []
        done = [f.getName() for f in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
        return sorted(map(dt.date.fromisoformat, done))

    def _drop(self, cut: dt.date) -> None:
        files, where = self._folder(cut)
        files.delete(where, True)

    def forget(self, earliest: dt.date) -> None:
        """Drop the cuts that a transfer of day ``earliest`` would have been part of."""
        for cut in self.cuts():
            if cut > earliest:
                self._drop(cut)

    def before(self, day: dt.date, stored: DataFrame) -> DataFrame:
        """Pairs with their last meeting before ``day``; ``stored`` has a column ``day`` to prune by."""
        start = max((c for c in self.cuts() if c <= day), default=None)
        if start == day:
            return self._read(day)
        added = stored.filter(F.col("event_time") < F.lit(day).cast("timestamp_ntz")).filter(F.col("day").isNull() | (F.col("day") < F.lit(day)))
        if start is not None:
            added = added.filter(F.col("event_time") >= F.lit(start).cast("timestamp_ntz"))
            added = added.filter(F.col("day").isNull() | (F.col("day") >= F.lit(start)))
        found = _last_meetings(added)
        if start is not None:
            found = found.unionByName(self._read(start)).groupBy(*_PAIR).agg(F.max("_last").alias("_last"))
            if (day - start).days < STEP:
                return found
        found.write.mode("overwrite").parquet(f"{self.path}/{day}")
        for cut in self.cuts()[:-KEPT]:
            self._drop(cut)
        return self._read(day)

    def _read(self, cut: dt.date) -> DataFrame:
        return self.spark.read.schema("_low string, _high string, _last timestamp_ntz").parquet(f"{self.path}/{cut}")


def _earlier_pairs(rows: DataFrame, last: DataFrame) -> DataFrame:
    """``rows`` with the recency of pairs that met before only; both sides of a transfer have the same."""
    wanted = _with_pair(rows.filter(f"{RECENCY[0]} is null").select("sender_id", "receiver_id")).select(*_PAIR).distinct()
    out = _with_pair(rows).join(last.join(wanted, [*_PAIR], "left_semi"), [*_PAIR], "left")
    since = seconds_between("event_time", "_last")
    return out.withColumns({c: F.coalesce(c, since) for c in RECENCY}).select(*PASSTHROUGH, *FEATURES)


def refresh_batch(batch: DataFrame, store: str, dest: str, pairs: str | None = None) -> None:
    """Append new transfers to ``store``; bring the feature dates from the earliest new one on up to date.

    Delivered twice, a transfer counts once: rows of one txn_id must be equal. Rows without a
    date are stored but have no place in the feature table; a batch without any date is refused.
    The kept pairs lie in ``pairs``, beside the store unless given; without them they are made again.
    """
    spark = batch.sparkSession
    if batch.isEmpty():
        return
    fresh = normalize(batch)
    time_day = F.col("event_time").cast("date")
    known = fresh.agg(F.min("event_date").alias("dated"), F.min(F.least("event_date", time_day)).alias("first"), F.min(time_day).alias("earliest")).first()
    if known.dated is None:
        raise ValueError("no transfer of the batch has an event_date")
    first = F.lit(known.first)
    update = not _is_empty(spark, dest)
    state = PairState(spark, pairs or store.rstrip("/") + "_pairs")
    if known.earliest is not None:
        state.forget(known.earliest)  # before the store has them, so that no cut lacks a stored transfer
    fresh.withColumn("day", time_day).write.mode("append").partitionBy("day").parquet(store)

    stored = spark.read.schema(StructType(SCHEMA.fields + [StructField("day", DateType())])).parquet(store)
    begin = known.first - dt.timedelta(days=REACH)
    recent = stored.filter(F.col("event_time").isNull() | (F.col("event_time") >= F.lit(begin).cast("timestamp_ntz")))
    recent = recent.filter(F.col("day").isNull() | (F.col("day") >= F.lit(begin))).select(*COLUMNS)
    changed = _touching(recent.filter(F.col("event_date") >= first), _accounts(fresh))
    context = _touching(recent, _accounts(changed)).dropDuplicates(["txn_id"])
    ids = changed.select("txn_id").distinct()
    rows = feature_table_onepass(context, linear=True, sliced=True).filter(F.col("event_date") >= first)
    rows = _earlier_pairs(rows.join(ids, "txn_id", "left_semi"), state.before(begin, stored))
    if update:
        others = read_features(spark, dest).filter(F.col("event_date") >= first)
        rows = rows.unionByName(others.join(ids, "txn_id", "left_anti"))
    write_features(rows, dest, mode="dynamic")


def _is_empty(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return not files.exists(where) or len(files.listStatus(where)) == 0


def start(spark: SparkSession, source: str, store: str, dest: str, checkpoint: str, once: bool = False):
    """Follow a folder of transfer files; ``once`` drains what is there and stops."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda df, _: refresh_batch(df, store, dest))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
