"""Ranks, quantiles, ordered export, block maxima, ring-aware split: against plain Python."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_features import tx_frame

from finwake.functions.quantiles import exact_quantile
from finwake.operators import alerts as A
from finwake.operators import archive_metrics as M
from finwake.operators import history as H
from finwake.operators.events import two_sided
from finwake.operators.features import feature_table
from finwake.operators.history import BASE, history, history_sliced
from finwake.operators.rings import groups_of, reconcile, ring_split
from finwake.plans.pipeline import features_frame, run
from finwake.sources import adapters, batches
from finwake.sources.batches import numbered, read_batches, write_batches
from finwake.sources.demo import make_demo, make_transactions, sorted_uniforms, uniform
from finwake.sources.transactions import is_nested, read_transactions

D = [date(2024, 1, 1), date(2024, 1, 2)]


@pytest.mark.parametrize("rows", [16, 64, 200_000])
def test_ranks_in_ranges(spark, rows):
    r = random.Random(1)
    # one score is held by a third of a day's accounts; some have none
    days = [(D[i % 2], f"a{i:05d}", r.choice([0.5, 0.5, r.random(), r.random(), r.random(), None]), i % 2) for i in range(1500)]
    r.shuffle(days)
    got = {(x.day, x.account): x["rank"] for x in A.daily_rank(spark.createDataFrame(days, "day date, account string, score double, label int"), rows).collect()}
    want = {}
    for d in D:
        mine = sorted((x for x in days if x[0] == d and x[2] is not None), key=lambda x: (-x[2], x[1]))
        want |= {(d, x[1]): k + 1 for k, x in enumerate(mine)} | {(d, x[1]): None for x in days if x[0] == d and x[2] is None}
    assert got == want


def test_no_task_ranks_a_day(spark):
    days = spark.range(3000).select(F.lit(D[0]).alias("day"), F.col("id").cast("string").alias("account"), (F.col("id") % 7 / 7).alias("score"), F.lit(0).alias("label"))
    from finwake.functions.ranges import with_ranges

    sizes = [x["count"] for x in with_ranges(days, ["day"], "score", "account", 160).groupBy("_range").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 1000 and sum(sizes) == 3000


def test_ranking_quality_does_not_depend_on_ranges(spark):
    r = random.Random(2)
    rows = [(D[0], "a", "b", r.choice([r.random(), 0.25]), int(r.random() < 0.3)) for _ in range(800)]
    df = spark.createDataFrame(rows, "event_date date, sender_id string, receiver_id string, score double, is_laundering tinyint")
    one, many = M.ranking_quality(df).first(), M.ranking_quality(df, 16).first()
    pos, neg = [x[3] for x in rows if x[4]], [x[3] for x in rows if not x[4]]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert one == many and one.roc_auc == pytest.approx(auc, abs=1e-9)
    assert M.ranking_quality(df.filter("false")).first().roc_auc is None


def quantile(values, q):
    v = sorted(values)
    k = q * (len(v) - 1)
    a, b = v[int(k)], v[min(int(k) + 1, len(v) - 1)]
    return a + (b - a) * (k - int(k))


@pytest.mark.parametrize(
    "values",
    [
        [random.Random(3).lognormvariate(6, 2) for _ in range(3001)],
        [1.0] * 50,
        [7.5],
        [random.Random(4).choice([1.0, 2.0, 2.0, 3.0]) for _ in range(2000)],
        [0.0] * 999 + [1.7e308, -1.7e308] + [1e-320 * k for k in range(500)],
        [float(k) for k in range(100)],
    ],
)
def test_exact_quantile(spark, values, monkeypatch):
    from finwake.functions import quantiles

    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    for few in (10_000, 2):
        monkeypatch.setattr(quantiles, "FEW", few)
        for q in (0.0, 0.25, 0.5, 0.96, 1.0):
            assert exact_quantile(df, "x", q) == pytest.approx(quantile(values, q), rel=1e-12)
    assert exact_quantile(df.filter("false"), "x", 0.5) is None


@pytest.mark.parametrize("rows", [1, 7, 100, 1000])
def test_ordered_batches(spark, tmp_path, rows):
    ids = random.Random(5).sample(range(10_000), 300)
    df = spark.createDataFrame([(i, float(i) / 3, i % 2) for i in ids], "txn_id bigint, x double, label int").select("txn_id", F.col("x").cast("float").alias("x"), "label").repartition(5)
    done = write_batches(df, str(tmp_path / "out"), rows=rows).collect()
    tables = list(read_batches(str(tmp_path / "out")))
    assert [t.num_rows for t in tables] == [r["rows"] for r in done] == [min(rows, 300 - k) for k in range(0, 300, rows)]
    got = [x for t in tables for x in t.column("txn_id").to_pylist()]
    assert got == sorted(ids) and tables[0].schema.names == ["txn_id", "x", "label"] and str(tables[0].schema.field("x").type) == "float"
    import numpy as np

    assert [x for t in tables for x in t.column("x").to_pylist()] == [float(np.float32(i / 3)) for i in sorted(ids)]
    assert [f for f in (tmp_path / "out").iterdir() if f.name.startswith(".batch")] == []


def test_tasks_of_the_ordered_export_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "TASK_ROWS", 100)
    monkeypatch.setattr(batches, "TASK_ROWS", 100)
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("txn_id"), F.lit(1).alias("v"))
    seen, written = {}, batches.written
    monkeypatch.setattr(batches, "written", lambda frame, name: seen.update({name: frame.rdd.getNumPartitions()}) or written(frame, name))
    done = write_batches(df, str(tmp_path / "out"), rows=30).collect()
    assert [r.batch for r in done] == list(range(34)) and sum(r.rows for r in done) == 1000
    assert seen["ordered"] == 10 and seen["batches"] == 12  # three batches of 30 rows make a task


def test_partitions_of_joined_order_lines_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "TASK_ROWS", 500)
    tables = [spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("lineitem", "orders", "customer", "supplier")]
    lines = tables[0].count()
    for few in (500_000, 0):
        monkeypatch.setattr(adapters, "FEW", few)
        joined = adapters.from_lineitem(*tables)
        assert joined.rdd.getNumPartitions() == -(-lines // 500) and joined.count() == lines


def test_ordered_batches_of_nothing_and_of_ties(spark, tmp_path):
    df = spark.createDataFrame([(None, 1.0), (5, 2.0), (5, 3.0)], "txn_id bigint, x double")
    assert sorted(r._row for r in numbered(df).collect()) == [0, 1, 2]
    assert write_batches(df.filter("false"), str(tmp_path / "none")).count() == 0
    write_batches(df, str(tmp_path / "ties"))
    assert next(read_batches(str(tmp_path / "ties"))).column("txn_id").to_pylist() == [None, 5, 5]


def test_block_maxima(spark):
    r = random.Random(6)
    rows, t = [], datetime(2024, 1, 1)
    for i in range(500):
        t += timedelta(seconds=r.choice([0, 20, 40, 3600, 86_400, 40 * 86_400 if r.random() < 0.03 else 60]))
        rows.append((i, t.isoformat(" "), r.choice("ABC"), r.choice("ABC"), r.choice([None, -5.0, 10.0 * r.random(), 2.0])))
    rows.append((900, (datetime(2024, 1, 1) + timedelta(days=30)).isoformat(" "), "A", "B", 1.0))
    events = two_sided(tx_frame(spark, rows))
    key = lambda df: sorted(map(str, df.select("txn_id", "side", *BASE).collect()))
    sliced = history_sliced(events, linear=True)
    assert key(sliced) == key(history(events))
    frames = [x for x in sliced._jdf.queryExecution().executedPlan().toString().split("specifiedwindowframe")[1:]]
    assert frames and all("unboundedpreceding" in x[:60] for x in frames)


def test_repeated_ids_are_sliced_too(spark):
    tx = make_transactions(spark, 400)
    tx = tx.unionByName(tx.filter("txn_id = 7"))
    assert sorted(map(str, features_frame(tx).collect())) == sorted(map(str, feature_table(tx).collect()))


def test_sorted_uniforms(spark):
    draw = uniform("id", 3, "t")
    a = [(x.id, x.share) for x in sorted_uniforms(spark, 5000, draw, block=64).orderBy("id").collect()]
    b = [(x.id, x.share) for x in sorted_uniforms(spark, 5000, draw).orderBy("id").collect()]
    s = [x for _, x in a]
    assert a == b and len(s) == 5000 and s == sorted(s) and 0 < s[0] and s[-1] < 1
    # uniform order statistics: Kolmogorov's distance, and gaps that vary as exponential ones do
    assert max(abs(x - (k + 0.5) / 5000) for k, x in enumerate(s)) < 1.63 / 5000**0.5
    gaps = [y - x for x, y in zip(s, s[1:])]
    mean = sum(gaps) / len(gaps)
    assert 0.9 < (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / mean < 1.1


def test_counts_of_a_run_follow_the_time_of_day(spark, tmp_path):
    src = str(tmp_path / "tx.parquet")
    tx = make_transactions(spark, 1500)
    holes = F.when(F.col("txn_id") % 100 == 0, None).otherwise(F.col("event_time"))
    tx = tx.withColumns({"event_time": holes, "event_date": F.date_sub("event_date", (F.col("txn_id") % 2).cast("int"))})
    tx.write.parquet(src)
    metrics = run(spark, src, "2024-02-01 12:00:00", str(tmp_path / "out"), trees=2, depth=2)
    early = tx.filter("event_time < timestamp_ntz'2024-02-01 12:00:00'").count()
    late = tx.filter("event_time >= timestamp_ntz'2024-02-01 12:00:00'").count()
    assert (metrics["train_rows"], metrics["test_rows"]) == (early, late) and early + late == 1485


def test_folders_are_read_to_any_depth_by_default(spark, tmp_path):
    make_demo(spark, str(tmp_path / "in/a/b/part.parquet"), 300)
    assert read_transactions(spark, str(tmp_path / "in")).count() == 300
    make_transactions(spark, 300).withColumn("month", F.month("event_date")).write.partitionBy("month").parquet(str(tmp_path / "hive"))
    assert not is_nested(spark, str(tmp_path / "hive")) and is_nested(spark, str(tmp_path / "in"))
    assert read_transactions(spark, str(tmp_path / "hive")).count() == 300


def test_groups(spark):
    r = random.Random(8)
    edges = [(f"n{k}", f"n{k + 1}") for k in range(60)] + [(f"m{r.randrange(80)}", f"m{r.randrange(80)}") for _ in range(50)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {x.node: x.root for x in groups_of(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in up}


def test_ring_split(spark):
    rows = [(1, "2024-01-01 00:00:00", "A", "B", 1.0), (2, "2024-03-01 00:00:00", "B", "C", 1.0), (3, "2024-03-02 00:00:00", "C", "D", 1.0)]
    rows += [(4, "2024-03-03 00:00:00", "X", "Y", 1.0), (5, "2024-03-04 00:00:00", "Y", "Z", 1.0), (6, "2024-03-05 00:00:00", "A", "X", 1.0), (7, "2024-01-05 00:00:00", "X", "Q", 1.0)]
    tx = tx_frame(spark, rows).withColumn("is_laundering", F.when(F.col("txn_id").isin(1, 6), 1).otherwise(0).cast("tinyint"))
    # ring 2 shares C with ring 1, which began before the cut; ring 3 stands alone
    rings = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 3), (5, 3), (99, 9)], "txn_id bigint, ring_id bigint")
    train, test, report = ring_split(tx, rings, "2024-02-01")
    assert sorted(x.txn_id for x in train.collect()) == [1, 7] and sorted(x.txn_id for x in test.collect()) == [4, 5, 6]
    assert tuple(report.first()) == (3, 2, 1, pytest.approx(66.67))
    accounts = lambda df: {y for x in df.join(rings.distinct(), "txn_id").collect() for y in (x.sender_id, x.receiver_id)}
    assert not accounts(train) & accounts(test)
    assert tuple(reconcile(tx, rings).first()) == (2, 5, 1, 1, 4, 50.0)
    assert tuple(ring_split(tx, rings.filter("false"), "2024-02-01")[2].first()) == (0, 0, 0, None)


def test_command_line_demo(spark, tmp_path):
    from finwake.plans import cli

    metrics = cli.main(["demo", "--rows", "1200", "--output", str(tmp_path / "demo"), "--trees", "2"])
    assert metrics["train_rows"] + metrics["test_rows"] == 1200 and (tmp_path / "demo" / "metrics.json").exists()
