"""The tree learner against a plain one, with missing values, any partitioning and damaged inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from finwake.operators import archive_metrics as M
from finwake.operators import boosting as B
from finwake.plans import catalog

INPUTS = ["a", "b", "c"]
SCHEMA = "txn_id bigint, a double, b double, c double, is_laundering tinyint"


def table(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.gauss(0, 1), r.choice([1.0, 2.0, 3.0]), r.random()
        y = int(a + (b == 2) + (0.8 if c < 0.3 else 0) + r.gauss(0, 0.5) > 1.2)
        # a missing value tells something about the label
        rows.append((i, None if r.random() < (0.4 if y else 0.1) else a, float("nan") if r.random() < 0.1 else b, c, y))
    return rows


def plain(rows, trees, depth, leaves, min_rows):
    """Scores of boosted trees grown leaf by leaf, by loops over rows and cuts."""
    x = [[None if v is None or math.isnan(v) else v for v in r[1:4]] for r in rows]
    y = [r[4] for r in rows]
    cuts = [sorted({float(np.quantile([v[c] for v in x if v[c] is not None], k / 64)) for k in range(1, 64)}) for c in range(3)]
    n1 = sum(y)
    weight = {1: len(y) / (2 * n1), 0: len(y) / (2 * (len(y) - n1))}
    raw = [0.0] * len(y)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in raw]
        g = [round(weight[t] * (q - t) * 2**20) for t, q in zip(y, p)]
        h = [round(weight[t] * q * (1 - q) * 2**20) for t, q in zip(y, p)]
        score = lambda rs: (sum(g[i] for i in rs) / 2**20) ** 2 / (sum(h[i] for i in rs) / 2**20)

        def best(rs):
            top = (1e-9, None, None)
            for c in range(3):
                for cut in cuts[c]:
                    for missing in (False, True):
                        left = [i for i in rs if (missing if x[i][c] is None else x[i][c] <= cut)]
                        right = [i for i in rs if not (missing if x[i][c] is None else x[i][c] <= cut)]
                        if min(len(left), len(right)) >= min_rows:
                            gain = score(left) + score(right) - score(rs)
                            if gain > top[0] + 1e-12:
                                top = (gain, left, right)
            return top

        open_, done = [(best(range(len(y))), 0, list(range(len(y))))], []
        while open_ and len(open_) + len(done) < leaves:
            open_.sort(key=lambda o: -o[0][0])
            (gain, left, right), level, rs = open_.pop(0)
            if left is None:
                done.append(rs)
                continue
            for part in (left, right):
                if level + 1 < depth:
                    open_.append((best(part), level + 1, part))
                else:
                    done.append(part)
        for rs in done + [o[2] for o in open_]:
            value = -0.1 * sum(g[i] for i in rs) / sum(h[i] for i in rs)
            for i in rs:
                raw[i] += value
    return [1 / (1 + math.exp(-s)) for s in raw]


@pytest.mark.parametrize("depth, leaves", [(3, 31), (3, 5)])
def test_equal_to_a_plain_learner(spark, depth, leaves):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    got = B.fit(df.repartition(3), INPUTS, trees=3, depth=depth, leaves=leaves).score(df, "txn_id").orderBy("txn_id").collect()
    assert [r.score for r in got] == pytest.approx(plain(rows, 3, depth, leaves, 20), abs=1e-9)


def test_any_partitioning_and_saved_trees_score_the_same(spark, tmp_path):
    df = spark.createDataFrame(table(600, 2), SCHEMA)
    a, b = (B.fit(d, INPUTS, trees=12, depth=4) for d in (df.repartition(1), df.repartition(5).orderBy("a")))
    assert [(t.splits, t.values) for t in a.trees] == [(t.splits, t.values) for t in b.trees]
    a.save(str(tmp_path / "model"), spark)
    c = B.BoostedTrees.load(str(tmp_path / "model"), spark)
    key = lambda m: [(r.txn_id, r.score) for r in m.score(df, "txn_id").orderBy("txn_id").collect()]
    assert key(a) == key(c)


def test_missing_values_tell_something(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 7), 1.0, 0.5, int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = B.fit(df, INPUTS, trees=5, depth=2)
    low = {r.is_laundering: r.s for r in model.score(df, "is_laundering").groupBy("is_laundering").agg(F.avg("score").alias("s")).collect()}
    assert low[1] > 0.6 and low[0] < 0.4


def test_odd_tables(spark):
    df = spark.createDataFrame(table(60), SCHEMA)
    assert B.fit(df.filter("false"), INPUTS, trees=2).score(df, "txn_id").filter("score = 0.5").count() == 60
    one = B.fit(df.filter("is_laundering = 1"), INPUTS, trees=2)  # one class only
    assert one.score(df, "txn_id").filter("score > 0.5").count() == 60
    blank = df.select("txn_id", *[F.lit(None).cast("double").alias(c) for c in INPUTS], "is_laundering")
    assert B.fit(blank, INPUTS, trees=2).score(blank, "txn_id").count() == 60
    holes = df.withColumn("is_laundering", F.when(F.col("txn_id") > 30, F.col("is_laundering")))
    assert B.fit(holes, INPUTS, trees=1, min_rows=3).score(holes, "txn_id").count() == 60


@pytest.mark.parametrize("name, floor", [("boosted_scores", 0.95), ("gbt_scores", 0.9), ("logistic_scores", 0.8)])
def test_learners_rank_later_transfers(spark, name, floor):
    scored = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    row = M.ranking_quality(scored).first()
    assert row.roc_auc > floor and scored.filter("score is null or not score between 0 and 1").count() == 0


def test_models_read_written_features(spark, monkeypatch):
    """F1, F5, F8: neither fitting nor scoring builds the feature table again."""
    from finwake.operators import model
    from finwake.plans import catalog

    seen = []
    monkeypatch.setattr(model, "fit", lambda train, *a, **k: seen.append(train))
    monkeypatch.setattr(model, "score", lambda fitted, test: test)
    seen.append(catalog.queries()["logistic_scores"](spark, "/root/testdata/sf0.001"))
    assert len(seen) == 2
    for frame in seen:
        assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()
