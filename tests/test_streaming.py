"""Upkeep by batches against one computation over everything."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from finwake.operators.features import feature_table_onepass
from finwake.sources.transactions import SCHEMA
from finwake.streaming.refresh import PairState, refresh_batch, start


def transfers(n=240, days=120, seed=3):
    """Few accounts over many days, so that pairs meet again long after; self transfers and null sides among them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(days * 1440))
        a, b = rng.choice("ABCDEFGHIJ"), rng.choice("ABCDEFGHIJ")
        a = None if rng.random() < 0.03 else a
        rows.append((i, t, t.date(), a, b, "x", rng.choice("xy"), round(rng.random() * 900, 2), 5.0, "EUR", "EUR", "wire", 0))
    return rows


def table(df):
    return sorted(str(r) for r in df.collect())


def check(spark, batches, tmp_path):
    store, dest = str(tmp_path / "store"), str(tmp_path / "features")
    for b in batches:
        refresh_batch(spark.createDataFrame(b, SCHEMA), store, dest)
    everything = spark.createDataFrame([r for b in batches for r in b], SCHEMA).dropDuplicates(["txn_id"])
    want = feature_table_onepass(everything).filter("event_date is not null")
    assert table(spark.read.parquet(dest).select(*want.columns)) == table(want)


def test_batches_in_order(spark, tmp_path):
    rows = sorted(transfers(), key=lambda r: r[1])
    check(spark, [rows[:150], rows[150:220], rows[220:]], tmp_path)


def test_late_and_repeated_batches(spark, tmp_path):
    rows = transfers()
    check(spark, [rows[:120], rows[120:], rows[100:130]], tmp_path)


def test_pairs_that_met_long_ago(spark, tmp_path):
    row = lambda i, day, a, b: (i, dt.datetime(2024, 1, 1) + dt.timedelta(days=day), dt.date(2024, 1, 1) + dt.timedelta(days=day), a, b, "x", "x", 1.0, 1.0, "EUR", "EUR", "wire", 0)
    check(spark, [[row(1, 0, "A", "B"), row(2, 5, "C", "D")], [row(3, 90, "B", "A"), row(4, 91, "C", "A")], [row(5, 200, "D", "C")]], tmp_path)


def test_accounts_that_are_not_in_the_batch_keep_their_rows(spark, tmp_path):
    rows = sorted(transfers(120, 20), key=lambda r: r[1])
    far = [(1000 + r[0], *r[1:3], f"{r[3]}2", f"{r[4]}2", *r[5:]) for r in rows]
    check(spark, [rows[:100] + far, rows[100:]], tmp_path)


def test_rows_without_date_or_time(spark, tmp_path):
    rows = transfers(40, 10)
    odd = [(500, rows[0][1], None, *rows[0][3:]), (501, None, rows[5][2], *rows[5][3:])]
    check(spark, [rows[:20], rows[20:] + odd], tmp_path)
    with pytest.raises(ValueError, match="event_date"):
        refresh_batch(spark.createDataFrame(odd[:1], SCHEMA), str(tmp_path / "s"), str(tmp_path / "d"))


def test_stream_of_files(spark, tmp_path):
    rows = sorted(transfers(80, 40), key=lambda r: r[1])
    for k, part in enumerate((rows[:50], rows[50:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    start(spark, str(tmp_path / "in" / "*"), str(tmp_path / "store"), str(tmp_path / "features"), str(tmp_path / "marks"), once=True).awaitTermination(120)
    want = feature_table_onepass(spark.createDataFrame(rows, SCHEMA))
    got = spark.read.parquet(str(tmp_path / "features"))
    assert got.count() == 80 and table(got.select(*want.columns).withColumn("event_date", F.col("event_date"))) == table(want)


def test_older_days_of_the_store_are_not_read(spark, tmp_path):
    """Days before the kept cut are taken away; later batches still find every pair's last meeting."""
    rows = sorted(transfers(200, 260, seed=8), key=lambda r: r[1])
    cuts = [0, 80, 140, 200]
    store, dest = tmp_path / "store", str(tmp_path / "features")
    taken = 0
    for a, b in zip(cuts, cuts[1:]):
        refresh_batch(spark.createDataFrame(rows[a:b], SCHEMA), str(store), dest)
        kept = PairState(spark, f"{store}_pairs").cuts()[-1]
        for folder in store.glob("day=*"):
            if folder.name < f"day={kept}":
                shutil.rmtree(folder)
                taken += 1
    assert taken > 20
    want = feature_table_onepass(spark.createDataFrame(rows, SCHEMA))
    assert table(spark.read.parquet(dest).select(*want.columns)) == table(want)


def test_late_transfers_drop_later_cuts(spark, tmp_path):
    """In-order batches make cuts; one very late transfer changes what a pair did before them."""
    rows = sorted(transfers(260, 300, seed=5), key=lambda r: r[1])
    late = rows[20:24] + rows[100:103]
    rest = [r for r in rows if r not in late]
    check(spark, [rest[:200], rest[200:230], late, rest[230:]], tmp_path)
    cuts = PairState(spark, str(tmp_path / "store_pairs")).cuts()
    assert 1 <= len(cuts) <= 5


def test_unfinished_or_missing_state_is_made_again(spark, tmp_path):
    rows = sorted(transfers(160, 200, seed=6), key=lambda r: r[1])
    store, dest = str(tmp_path / "store"), str(tmp_path / "features")
    refresh_batch(spark.createDataFrame(rows[:80], SCHEMA), store, dest)
    refresh_batch(spark.createDataFrame(rows[80:120], SCHEMA), store, dest)
    for mark in (tmp_path / "store_pairs").glob("*/_SUCCESS"):
        mark.unlink()
    refresh_batch(spark.createDataFrame(rows[120:], SCHEMA), store, dest)
    want = feature_table_onepass(spark.createDataFrame(rows, SCHEMA))
    assert table(spark.read.parquet(dest).select(*want.columns)) == table(want)
