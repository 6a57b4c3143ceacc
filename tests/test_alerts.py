"""Alert budgets: ties, missing scores, empty inputs, archived per-day numbers."""

from datetime import date

import pytest

from finwake.operators import alerts as A
from finwake.operators import archive_metrics as M

D1, D2 = date(2024, 1, 1), date(2024, 1, 2)
SCORED = [
    (D1, "a", "b", 0.9, 1),
    (D1, "c", "b", 0.9, 0),
    (D1, "d", "d", 0.2, 0),
    (D2, "a", "c", float("nan"), 1),
    (D2, "b", "c", 0.1, 0),
]
SCHEMA = "event_date date, sender_id string, receiver_id string, score double, is_laundering tinyint"


def frame(spark, rows=SCORED):
    return spark.createDataFrame(rows, SCHEMA)


def test_ranks(spark):
    rows = A.daily_rank(A.account_days(frame(spark))).collect()
    ranks = {(r.day, r.account): r["rank"] for r in rows}
    assert [ranks[D1, x] for x in "abcd"] == [1, 2, 3, 4]
    assert (ranks[D2, "b"], ranks[D2, "c"], ranks[D2, "a"]) == (1, 2, None)


def test_budget_metrics(spark):
    row = A.budget_metrics(frame(spark), (1, 2)).first()
    assert (row.account_days, row.positive_account_days) == (7, 4)
    assert (row["precision@1"], row["recall@1"]) == (0.5, 0.25)
    assert (row["precision@2"], row["recall@2"]) == (0.75, 0.75)


def test_no_positives_and_empty(spark):
    row = A.budget_metrics(frame(spark, [(D1, "a", "b", 0.5, 0)]), (1,)).first()
    assert row["precision@1"] == 0 and row["recall@1"] is None
    row = A.budget_metrics(frame(spark, []), (1,)).first()
    assert row.account_days == 0 and row["precision@1"] is None


def test_per_day_metrics(spark):
    counts = spark.createDataFrame([(D1, 100, 30), (D2, 4, 2)], "day date, n_d bigint, n_positive bigint")
    c = {r.budget: r for r in M.recall_ceiling(counts, (10, 50)).collect()}
    assert c[10].ceiling_count == 12 and c[10].budget_limited == 10 and c[10].recall_ceiling == 12 / 32
    assert {r.budget: r.slots for r in M.alert_slots(counts, (10, 50)).collect()} == {10: 14, 50: 54}
    assert {r.budget: r.days for r in M.nonbinding_days(counts, (10, 50)).collect()} == {10: 1, 50: 1}
    p = {r.budget: r.precision for r in M.random_null_precision(counts, (10,)).collect()}
    assert p[10] == pytest.approx((10 * 0.3 + 4 * 0.5) / 14, abs=1e-6)


def test_ranking_quality(spark):
    rows = [(D1, "a", "b", s, y) for s, y in ((0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0))]
    row = M.ranking_quality(frame(spark, rows)).first()
    assert row.roc_auc == pytest.approx(0.875) and row.average_precision == pytest.approx((1 + 2 / 3) / 2)
