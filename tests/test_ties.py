"""Histories by account and time: against the SQL on odd order lines, and against the history of each event."""

import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F
from test_features import tx_frame

from finwake.operators import history as H
from finwake.operators.events import two_sided
from finwake.operators.history import history
from finwake.plans import catalog

SHARED = ["n_1d", "n_7d", "n_30d", "max_amt_30d", "mean_amt_7d", "secs_since_prev"]


def odd_tables(folder):
    """sf0.001 with missing and negative prices, times within days, early dates, and keys that dangle, repeat, are missing or take a third."""
    con = duckdb.connect()
    changed = {
        "lineitem": """select * replace (
            case when l_linenumber = 1 then null when l_partkey % 10 = 0 then -l_extendedprice else l_extendedprice end as l_extendedprice,
            case when l_partkey % 50 = 1 then null when l_partkey % 7 = 2 then l_shipdate + to_seconds(CAST(30 * (l_partkey % 5) AS BIGINT))
              when l_partkey % 11 = 3 then l_shipdate - interval 60 year else l_shipdate end as l_shipdate,
            case when l_partkey % 90 = 4 then null when l_partkey % 90 = 5 then -1 else l_orderkey end as l_orderkey,
            case when l_partkey % 80 = 6 then null when l_partkey % 3 = 0 then 7 else l_suppkey end as l_suppkey) from {}""",
        "orders": "select * replace (case when o_orderkey % 3 = 0 then 3 else o_custkey end as o_custkey) from {0} union all select * from {0} where o_orderkey % 40 = 0",
        "customer": "select * from {0} where c_custkey % 50 <> 1 union all select * from {0} where c_custkey % 40 = 0",
        "supplier": "select * from {0} where s_suppkey % 9 <> 1 union all select * from {0} where s_suppkey % 9 = 2",
    }
    for t, select in changed.items():
        con.execute(f"create table {t} as " + select.format(f"'/root/testdata/sf0.001/{t}.parquet'"))
        con.execute(f"copy {t} to '{folder}/{t}.parquet' (format parquet)")
    return con


def test_odd_order_lines_against_sql(spark, tmp_path):
    con = odd_tables(tmp_path)
    want = con.execute(catalog.oracle_sql()["ties_daily"]).fetchall()
    got = catalog.queries()["ties_daily"](spark, str(tmp_path)).select(*[d[0] for d in con.description]).collect()
    assert len(got) > 1000 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_order_lines_travel_once_by_account(spark, monkeypatch):
    monkeypatch.setattr(H, "TASK_ROWS", 500)
    ties = catalog.queries()["ties_daily"](spark, "/root/testdata/sf0.001")
    plan = ties._jdf.queryExecution().executedPlan().toString().splitlines()
    assert len([x for x in plan if "Exchange hashpartitioning(account_id" in x]) == 1 and not any("txn_id" in x for x in plan)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert ties.rdd.getNumPartitions() == -(-2 * lines // 500)


def test_events_of_one_time_share_their_history(spark, monkeypatch):
    r = random.Random(7)
    rows, t = [], datetime(2020, 1, 1)
    for i in range(600):
        t += timedelta(seconds=r.choice([0, 0, 20, 60, 3600, 86_400, 7 * 86_400, 30 * 86_400 if r.random() < 0.1 else 60]))
        rows.append((i, t.isoformat(" "), r.choice("ABC"), r.choice("ABC"), round(1000 * r.random() - 50, 2)))
    events = two_sided(tx_frame(spark, rows))
    last = [F.max(c).alias(c) for c in SHARED]
    want = history(events).groupBy("account_id", "event_time").agg(F.count("*").alias("rows"), *last)
    for slices in (1, 2, 8):
        monkeypatch.setattr(H, "BLOCK_SLICES", slices)
        got = H.history_by_time(events, 1200)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
