"""End-to-end plans: build the feature table; train, score and evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finwake.operators import alerts, model
from finwake.operators.events import two_sided
from finwake.operators.features import FEATURES, feature_table, feature_table_onepass
from finwake.operators.history import history
from finwake.sources.sinks import read_features, write_features, write_metrics
from finwake.sources.transactions import duplicate_ids, read_transactions


def features_frame(tx: DataFrame, linear: bool = True, exact: bool = True, sliced: bool = True, unique: bool | None = None) -> DataFrame:
    """One-pass assembly where txn_id is unique (counted unless the caller knows), else the two-join plan.

    By default frames are differences of running sums within 30-day slices of each account:
    linear on busy accounts, and spread over tasks.
    """
    if unique or unique is None and duplicate_ids(tx).isEmpty():
        return feature_table_onepass(tx, exact, linear, sliced)
    return feature_table(tx, exact, linear, sliced)


def register_views(spark: SparkSession, src: str, prefix: str = "finwake_", features: str | None = None, recursive: bool | None = None) -> list[str]:
    """Temporary views for SQL users: the transfers, their two-sided events, histories and features.

    With ``features`` the written feature store at that path is a view too.
    """
    tx = read_transactions(spark, src, recursive)
    sides = two_sided(tx)
    views = {"tx": tx, "events": sides, "history": history(sides), "feature_table": features_frame(tx)}
    if features:
        views["features"] = read_features(spark, features)
    for name, frame in views.items():
        frame.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]


def build_features(
    spark: SparkSession, src: str, dest: str, mode: str = "static", linear: bool = True, exact: bool = True, recursive: bool | None = None
) -> str:
    tx = read_transactions(spark, src, recursive)
    return write_features(features_frame(tx, linear, exact), dest, mode)


def run(
    spark: SparkSession, src: str, cut: str, output: str, kind: str = "histogram", trees: int = 200, depth: int = 8, recursive: bool | None = None
) -> dict:
    """Features, time split, training, scoring and budget metrics; writes all of them."""
    path = build_features(spark, src, f"{output}/features", recursive=recursive)
    features = read_features(spark, path)
    train, test = model.split(features, cut)
    fitted = model.fit(train, kind, trees, depth)
    row = alerts.budget_metrics(model.score(fitted, test)).first().asDict()
    early, late = model.parts(cut)
    sizes = features.agg(F.count_if(early).alias("train"), F.count_if(late).alias("test")).first()
    metrics = {"train_rows": sizes.train, "test_rows": sizes.test, "features": len(FEATURES), "cut": cut, **row}
    model.save(fitted, f"{output}/model", spark)
    write_metrics(metrics, f"{output}/metrics.json", spark)
    return metrics
