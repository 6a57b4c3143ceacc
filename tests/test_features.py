"""Golden micro-fixtures and invariants of the feature table."""

import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from finwake.operators.events import two_sided, two_sided_union
from finwake.operators.features import FEATURES, TX_FEATURES, feature_table, feature_table_onepass, stateless
from finwake.operators.history import BASE, history, history_sliced
from finwake.plans.pipeline import build_features, register_views, run
from finwake.sources.adapters import from_events
from finwake.sources.demo import make_demo, make_transactions
from finwake.sources.transactions import SCHEMA, normalize

ROWS = [
    (1, "2024-01-01 00:00:00", "A", "B", 1000.0),
    (2, "2024-01-01 00:00:30", "A", "B", 250.0),
    (3, "2024-01-01 00:01:00", "B", "A", 99.5),
    (4, "2024-01-01 00:01:00", "A", "A", 1.0),
    (5, "2024-01-02 00:01:00", "A", "C", 5000.0),
    (6, "2024-01-08 00:01:00", "C", "B", 0.0),
    (7, "2024-02-15 12:00:00", "A", "B", 700.0),
]
EXPECTED = {
    (1, "s"): (0, 0, 0, None, None, None, 0, None, None),
    (2, "r"): (0, 0, 0, None, None, None, 0, None, None),
    (3, "s"): (1, 1, 1, 1000, 0, 1000, 0, 60, 60),
    (3, "r"): (1, 1, 1, 1000, 0, 1000, 1, 60, 60),
    (4, "s"): (1, 1, 1, 1000, 0, 1000, 1, 60, None),
    (4, "r"): (1, 1, 1, 1000, 0, 1000, 1, 60, None),
    (5, "s"): (3, 5, 5, 270.3, 376.056326, 1000, 3, 86400, None),
    (5, "r"): (0, 0, 0, None, None, None, 0, None, None),
    (6, "s"): (0, 1, 1, 5000, 0, 5000, 0, 518400, None),
    (6, "r"): (0, 1, 3, 99.5, 0, 1000, 1, 604800, None),
    (7, "s"): (0, 0, 0, None, None, None, 0, None, 3931140),
    (7, "r"): (0, 0, 0, None, None, None, 0, None, 3931140),
}


def tx_frame(spark, rows=ROWS):
    data = []
    for i, t, s, r, a in rows:
        when = datetime.fromisoformat(t)
        data.append((i, when, when.date(), s, r, "010", "011", a, 5.0, "USD", "USD", "ACH", 0))
    return normalize(spark.createDataFrame(data, SCHEMA))


@pytest.mark.parametrize("how", [{}, {"exact": False}, {"linear": True}])
def test_history_golden(spark, how):
    rows = history(two_sided(tx_frame(spark)), **how).collect()
    got = {(r.txn_id, r.side): tuple(r[c] for c in BASE) for r in rows}
    for key, want in EXPECTED.items():
        assert got[key] == tuple(w if w is None else pytest.approx(w, abs=1e-6) for w in want), key


def test_slices_change_nothing(spark):
    tx = tx_frame(spark, [*ROWS, (8, "2024-06-01 00:00:00", "A", "B", 5.0), (9, "2024-06-01 00:00:30", "B", "A", 6.0)])
    tx = tx.unionByName(tx.filter("txn_id = 3").withColumns({"txn_id": F.lit(10).cast("bigint"), "event_time": F.lit(None).cast("timestamp_ntz")}))
    events = two_sided(tx)
    for linear in (False, True):
        assert sorted(history_sliced(events, linear=linear).collect(), key=str) == sorted(history(events).collect(), key=str)


def test_inline_equals_union(spark):
    tx = tx_frame(spark)
    assert sorted(two_sided(tx).collect()) == sorted(two_sided_union(tx).collect())


def test_feature_names():
    assert len(FEATURES) == 32 == len(set(FEATURES)) and FEATURES[:12] == TX_FEATURES


def test_assemblies_agree_and_order_is_irrelevant(spark):
    tx = tx_frame(spark)
    a = sorted(feature_table(tx).collect())
    assert a == sorted(feature_table_onepass(tx).collect())
    assert a == sorted(feature_table_onepass(tx.orderBy(F.desc("txn_id"))).collect())


def test_duplicate_ids_fan_out(spark):
    tx = tx_frame(spark, [ROWS[0], ROWS[0]])
    assert feature_table(tx).count() == 8


def test_future_rows_change_nothing(spark):
    early = {r.txn_id: r for r in feature_table_onepass(tx_frame(spark, ROWS[:5])).collect()}
    for r in feature_table_onepass(tx_frame(spark)).filter("txn_id <= 5").collect():
        assert r == early[r.txn_id]


def test_null_time_and_empty(spark):
    tx = tx_frame(spark)
    assert feature_table_onepass(tx.filter("false")).count() == 0
    holes = tx.withColumn("event_time", F.when(F.col("txn_id") > 5, F.col("event_time")))
    assert feature_table(holes).count() == feature_table_onepass(holes).count() == 7


@pytest.mark.parametrize(
    "amount, level", [(5000.0, 3), (700.0, 2), (42.0, 1), (42.5, 0), (50.0, 1), (0.0, 3), (None, 0)]
)
def test_roundness(spark, amount, level):
    row = stateless(tx_frame(spark, [(1, "2024-01-06 10:00:00", "A", "B", amount)])).first()
    assert row.amount_roundness == level and row.dayofweek == 6 and row.is_weekend == 1
    if amount == 0:
        assert row.fx_ratio is None and row.log_amount_paid == 0
    if amount is None:
        assert row.fx_ratio is None and row.log_amount_paid is None


def test_null_flags(spark):
    tx = tx_frame(spark).withColumn("payment_currency", F.lit(None).cast("string"))
    row = stateless(tx).first()
    assert row.currency_mismatch is None and 0 <= row.payment_currency_code < 1000


def test_brute_force_counts(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e = two_sided(from_events(events))
    got = history(e)
    b = e.select(F.col("account_id").alias("acc"), F.col("event_time").alias("t"), F.col("amount_paid").alias("amt"))
    gap = F.col("event_time") - F.col("t")
    pair = e.join(
        b,
        (F.col("acc") == F.col("account_id"))
        & (gap >= F.expr("INTERVAL '0 00:01:00' DAY TO SECOND"))
        & (gap <= F.expr("INTERVAL '7 00:00:00' DAY TO SECOND")),
        "left",
    )
    brute = pair.groupBy("txn_id", "side").agg(F.count("t").alias("n"), F.avg("amt").alias("m"))
    bad = got.join(brute, ["txn_id", "side"]).filter(
        "n_7d <> n or abs(coalesce(mean_amt_7d, -1) - coalesce(m, -1)) > 1e-6"
    )
    assert bad.count() == 0


def test_demo_generator_is_deterministic(spark):
    a, b = make_transactions(spark, 500), make_transactions(spark, 500).repartition(7)
    assert sorted(a.collect()) == sorted(b.collect())
    row = a.agg(F.countDistinct("txn_id"), F.min("event_date"), F.max("event_date"), F.sum("is_laundering")).first()
    assert row[0] == 500 and row[1] == date(2024, 1, 1) and row[2] <= date(2024, 2, 14) and 5 <= row[3] <= 20


def test_first_demo_row_has_no_history(spark, tmp_path):
    src = make_demo(spark, str(tmp_path / "tx.parquet"), 1000)
    dest = build_features(spark, src, str(tmp_path / "features"))
    views = register_views(spark, src)
    assert spark.table(views[-1]).count() == spark.sql(f"select count(distinct txn_id) n from {views[1]}").first().n == 1000
    row = spark.read.parquet(dest).orderBy("txn_id").first()
    assert (row.s_n_1d, row.r_n_1d) == (0, 0)


def test_run_end_to_end(spark, tmp_path):
    src = make_demo(spark, str(tmp_path / "tx.parquet"), 1500)
    metrics = run(spark, src, "2024-02-01", str(tmp_path / "run"), trees=3, depth=3)
    saved = json.loads((tmp_path / "run" / "metrics.json").read_text())
    assert metrics == saved and metrics["features"] == 32
    assert "precision@50" in metrics and "recall@50" in metrics
    assert os.path.isdir(tmp_path / "run" / "model")


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="sender_id"):
        normalize(spark.range(1).withColumnRenamed("id", "txn_id"))


def test_sliced_onepass_equals_the_direct_one(spark):
    from finwake.operators.features import feature_table_onepass
    from finwake.sources.demo import make_transactions

    tx = make_transactions(spark, 2000).cache()
    direct, sliced = (sorted(map(str, feature_table_onepass(tx, **how).collect())) for how in ({}, {"linear": True, "sliced": True}))
    assert direct == sliced


def test_slices_carry_the_recency_of_missing_accounts(spark):
    import datetime as dt

    from finwake.operators.features import feature_table_onepass
    from finwake.sources.transactions import SCHEMA

    rows = []
    for i, (day, a, b) in enumerate([(0, None, "A"), (100, "A", None), (150, None, None), (290, None, None), (300, "A", "A"), (400, "A", "A")]):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
        rows.append((i, t, t.date(), a, b, "x", "x", 1.0, 1.0, "EUR", "EUR", "wire", 0))
    tx = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(str, feature_table_onepass(tx).collect()))
    assert want == sorted(map(str, feature_table_onepass(tx, linear=True, sliced=True).collect()))


def test_command_line_reads_nested_folders(spark, tmp_path):
    import json

    from finwake.plans import cli
    from finwake.plans.pipeline import register_views
    from finwake.sources.demo import make_demo

    make_demo(spark, str(tmp_path / "in/a/b/part.parquet"), 1500)
    out = tmp_path / "out"
    metrics = cli.main(["run", "--input", str(tmp_path / "in"), "--recursive", "--cut", "2024-02-01", "--output", str(out), "--trees", "2"])
    assert metrics["train_rows"] + metrics["test_rows"] == 1500
    assert json.loads((out / "metrics.json").read_text())["features"] == 32
    names = register_views(spark, str(tmp_path / "in"), "t_", str(out / "features"), recursive=True)
    assert names[-1] == "t_features" and spark.table("t_features").count() == 1500


def test_stream_and_dynamic_overwrite(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from finwake.operators.features import feature_table_onepass
    from finwake.sources.demo import make_transactions
    from finwake.streaming.refresh import refresh_batch

    tx = make_transactions(spark, 1200).cache()
    early = F.col("event_date") < "2024-01-20"
    store, dest = str(tmp_path / "store"), str(tmp_path / "features")
    refresh_batch(tx.filter(early), store, dest)
    kept = spark.read.parquet(dest).filter("event_date = '2024-01-05'").count()
    refresh_batch(tx.filter(~early), store, dest)
    got = spark.read.parquet(dest)
    want = feature_table_onepass(tx)
    assert kept == got.filter("event_date = '2024-01-05'").count() > 0
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError, match="event_date"):
        refresh_batch(tx.withColumn("event_date", F.lit(None).cast("date")), store, dest)


@pytest.mark.parametrize("build", [history, feature_table, feature_table_onepass])
def test_default_frames_never_slide(spark, build):
    """F6, F7, F9 to F16: cost and memory follow the rows; the results are those of the direct frames."""
    tx = from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    given = two_sided(tx) if build is history else tx
    got, direct = build(given), build(given, linear=False)
    frames = got._jdf.queryExecution().executedPlan().toString().split("specifiedwindowframe")[1:]
    assert frames and all("unboundedpreceding" in x[:60] for x in frames)
    assert sorted(map(str, got.collect())) == sorted(map(str, direct.collect()))


def test_partitions_follow_the_rows(spark, monkeypatch):
    from finwake.operators import history as H

    events = two_sided(from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")))
    monkeypatch.setattr(H, "TASK_ROWS", 100)
    assert history(events).rdd.getNumPartitions() >= 40


def test_transfers_of_a_wide_shuffle_are_dealt_before_they_become_events(spark, monkeypatch):
    from finwake.operators import history as H

    tx = from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).coalesce(1)
    want, rows = sorted(map(str, feature_table_onepass(tx).collect())), tx.count()
    assert H.in_small_parts(tx).rdd.getNumPartitions() == 1
    monkeypatch.setattr(H, "UNBUFFERED", 3)
    monkeypatch.setattr(H, "TASK_ROWS", rows // 2)
    parts = H.in_small_parts(tx).rdd.glom().map(len).collect()
    assert len(parts) == 8 and max(parts) < rows // 4
    assert sorted(map(str, feature_table_onepass(tx).collect())) == want
