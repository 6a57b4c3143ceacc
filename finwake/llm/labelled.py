"""Labelled rows for the text classifiers: folds and a bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def remainder(key: Column, parts: int = 5) -> Column:
    """crc32 of the id's text modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def training_labels(labels: DataFrame, label: str, key: str = "doc_id", held: int = 0) -> DataFrame:
    """(_k, _y): the label of every id outside fold ``held``; of conflicting ones the larger, null ids and other labels than 0 and 1 left out."""
    known = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
    known = known.filter("_k is not null and _y in (0, 1)").groupBy("_k").agg(F.max("_y").alias("_y"))
    return known.filter(remainder(F.col("_k")) != held)


def training_rows(
    documents: DataFrame, labels: DataFrame, label: str, per_class: int | None, key: str = "doc_id", text: str = "text", held: int = 0
) -> DataFrame:
    """Labelled texts as (_k, f, _y, _text), f being the fold, outside fold ``held``; with ``per_class`` at most so many ids a class.

    The choice is the same at every size and partitioning: ids are taken in the order of their
    hash. Of conflicting labels of an id the larger one counts; null ids and other labels than 0
    and 1 do not. Of rows that share an id the least text counts, picked by the executors before
    anything is collected, so there are never more rows than ids, however often one repeats.
    Only bounded choices are broadcast, and texts stay on the executors.
    """
    known = training_labels(labels, label, key, held)
    if per_class is not None:
        parts = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("_k", F.lit(7)), "_k").limit(per_class) for y in (0, 1)]
        known = F.broadcast(parts[0].unionByName(parts[1]))
    body = documents.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = body.join(known, "_k").groupBy("_k", "_y").agg(F.min("_text").alias("_text"))
    return found.select("_k", remainder(F.col("_k")).cast("int").alias("f"), "_y", "_text")


def by_id(rows: list[tuple]) -> list[tuple]:
    """(id, ...) rows in the order of the ids: independent of partitioning."""
    return sorted(rows, key=lambda r: r[0])


def logistic_fit(x, y, l2: float = 1.0, rounds: int = 30, weight=None):
    """Newton steps for logistic regression on standardised inputs; the last weight is the intercept's."""
    import numpy as np

    w = np.zeros(x.shape[1])
    s = np.ones(len(y)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (s * (p - y)) + l2 * w
        h = (x * (s * p * (1 - p))[:, None]).T @ x + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
