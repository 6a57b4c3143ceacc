"""Quality by Bradley-Terry pairwise ranking.

A document's score is linear in features of its text. The weights minimise the logistic
loss of feature differences in preference pairs (a document labelled good over one labelled
bad). All training documents take part: each class is numbered in the order of a hash of the
ids, and every document of the larger class meets the next few of the smaller one in that
order, at least ``MEETINGS`` (all, if there are fewer). A small table has more meetings, so that
there are about ``PAIRS`` pairs; there is no upper bound. The decision threshold is a score
quantile: the share of bad documents among the training labels, found exactly in the scores of
all training documents. Scores map to (0, 1) so that the threshold falls on ``CUT``.

Features are computed once, by the executors, and written (as 32-bit floats) for fitting and
scoring. The driver gets sums only: a gradient and a curvature of each task and Newton step.

Edge cases: null counts as empty; an empty text has all features zero and gets a score
like any other; without labels of both classes every score is 0.5; of rows of one
labelled id the least text is fitted, of its conflicting labels the larger; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finwake.llm import textops as X
from finwake.llm.labelled import remainder, training_labels, training_rows
from finwake.llm.store import materialise

CUT = 0.3
PAIRS = 60_000
MEETINGS = 4
L2 = 2.5  # against a loss whose pairs weigh ``PAIRS`` in all
TASK_ROWS = 1 << 15
FEW = 50_000  # rows of features that may be broadcast
BINS = 1024
NAMES = [
    "upper",
    "digit",
    "symbol",
    "mark",
    "space",
    "line",
    "wide",
    "word_len",
    "word_len_sd",
    "long_words",
    "short_words",
    "bare_symbol_words",
    "title_words",
    "distinct_words",
    "repeat_next",
    "repeat_pairs",
    "top_word",
    "ends_marked",
    "symbol_ends",
    "line_repeats",
    "log_words",
    "line_words",
]
_UPPER, _DIGIT, _LOWER = X.table_of((65, 90)), X.table_of((48, 57)), X.table_of((97, 122))
_MARK = np.isin(np.arange(256), np.frombuffer(b".,;:?!'\"()-", np.uint8))
_SYMBOL = X.table_of((33, 47), (58, 64), (91, 96), (123, 126)) & ~_MARK
_WIDE = X.table_of((128, 255))
_LINE = np.arange(256) != 10


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _top_and_distinct(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, how many different values it has and how often the most frequent one occurs."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(r)))
    top = np.zeros(rows)
    np.maximum.at(top, r[at], runs)
    return np.bincount(r[at], minlength=rows).astype(float), top


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each text of a slice."""
    rows = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    out = np.zeros((rows, len(NAMES)))
    col = {n: i for i, n in enumerate(NAMES)}
    share = {"upper": _UPPER, "digit": _DIGIT, "symbol": _SYMBOL, "mark": _MARK, "space": X.SPACE, "line": ~_LINE, "wide": _WIDE}
    for name, table in share.items():
        out[:, col[name]] = _per_row(table[data], offsets) / size
    start, end, row = X.words(data, offsets)
    n = np.bincount(row, minlength=rows).astype(float)
    many = np.maximum(n, 1)
    if len(start):
        mean = lambda x: np.bincount(row, weights=x, minlength=rows) / many
        length = (end - start).astype(float)
        out[:, col["word_len"]] = m = mean(length)
        out[:, col["word_len_sd"]] = np.sqrt(np.maximum(mean(length**2) - m**2, 0))
        out[:, col["long_words"]] = mean(length > 15)
        out[:, col["short_words"]] = mean(length <= 3)
        lone = (length == 1) & (_SYMBOL | _MARK)[data[start]]
        out[:, col["bare_symbol_words"]] = mean(lone)
        out[:, col["title_words"]] = mean(_UPPER[data[start]])
        out[:, col["ends_marked"]] = mean(_MARK[data[end - 1]])
        out[:, col["symbol_ends"]] = mean(_SYMBOL[data[end - 1]])
        h = X.word_hashes(data, start, end)
        distinct, top = _top_and_distinct(row, h, rows)
        out[:, col["distinct_words"]] = distinct / many
        out[:, col["top_word"]] = top / many
        inner = row[1:] == row[:-1]
        out[:, col["repeat_next"]] = np.bincount(row[1:], weights=inner & (h[1:] == h[:-1]), minlength=rows) / many
        pair = X.mix(h[:-1] * np.uint64(3) + h[1:])[inner]
        if len(pair):
            distinct, _ = _top_and_distinct(row[1:][inner], pair, rows)
            out[:, col["repeat_pairs"]] = 1 - distinct / np.maximum(np.bincount(row[1:][inner], minlength=rows), 1)
            out[:, col["repeat_pairs"]] *= n > 1
    a, b, lrow = X.words(data, offsets, ~_LINE)
    if len(a):
        lines = np.maximum(np.bincount(lrow, minlength=rows), 1)
        distinct, _ = _top_and_distinct(lrow, X.word_hashes(data, a, b), rows)
        out[:, col["line_repeats"]] = np.where(distinct > 0, 1 - distinct / lines, 0)
        out[:, col["line_words"]] = np.log1p(n / lines)
    out[:, col["log_words"]] = np.log1p(n)
    return out


def text_features(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    parts = [features(data, offsets) for _, _, data, offsets in X.slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def expand(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features and their squares, bounded so that no odd text leaves the fitted range far behind."""
    z = np.clip((x - centre) / scale, -8, 8)
    return np.concatenate([z, z * z / 8], axis=1)


def _mapped(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, x): the features of column ``_text``, computed where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(text_features(batch.column(len(keys))).astype(np.float32).ravel())
            x = pa.FixedSizeListArray.from_arrays(x, len(NAMES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], x], [*keys, "x"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "_text").mapInArrow(run, f"{kinds}, x array<float>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def training_features(featured: DataFrame, documents: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(_k, _y, x) of all training documents, one row an id; ``featured`` holds (_k, x) of all rows of ``documents``.

    Only ids that repeat need their texts again, for the least one.
    """
    known = training_labels(labels, "quality", key)
    met = featured.join(known, "_k").groupBy("_k", "_y").agg(F.count("*").alias("n"), F.first("x").alias("x"))
    met = materialise(met, "quality-labelled")
    found, repeated = met.filter("n = 1").drop("n"), met.filter("n > 1").select(F.col("_k").alias(key), F.col("_y").alias("quality"))
    if not repeated.isEmpty():
        found = found.unionByName(_mapped(training_rows(documents, repeated, "quality", None, key, text), "_k", "_y"))
    return found


def numbered(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``_i``: 0, 1, ... within each class, in the order of a hash of the ids; the same however rows are dealt."""
    order = ["_y", "_h", "_k"]
    dealt = rows.withColumn("_h", F.xxhash64("_k", F.lit(7))).repartitionByRange(-(-total // TASK_ROWS), *order).sortWithinPartitions(*order)
    dealt = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "quality-numbered")
    counts = dealt.groupBy("_part", "_y").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))  # two rows a partition at most
    above = Window.partitionBy("_y").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "_y", "_first", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_start"))
    return dealt.join(starts, ["_part", "_y"]).select("_k", "_y", "x", (F.col("_start") + F.col("_at") - F.col("_first")).alias("_i"))


def preferences(train: DataFrame, counts: dict[int, int], pairs: int = PAIRS) -> DataFrame:
    """(good, bad): the features of the documents of every pair. Each training document is in one pair or more."""
    rows = numbered(train, sum(counts.values()))
    large = int(counts[1] >= counts[0])
    most, least = counts[large], counts[1 - large]
    turns = min(least, max(MEETINGS, -(-pairs // most)))
    side = {1: "good", 0: "bad"}
    meets = F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))
    a = rows.filter(F.col("_y") == large).select("_i", F.col("x").alias(side[large]), meets.alias("_t"))
    a = a.withColumn("_j", F.pmod(F.col("_i") + F.col("_t"), F.lit(least)))
    b = rows.filter(F.col("_y") == 1 - large).select(F.col("_i").alias("_j"), F.col("x").alias(side[1 - large]))
    return a.join(F.broadcast(b) if least <= FEW else b, "_j").select("good", "bad")


def fit(train: DataFrame, pairs: int = PAIRS, rounds: int = 30) -> dict | None:
    """Bradley-Terry weights from all training documents, or None without both classes."""
    counts = {r._y: r.n for r in train.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    x = [F.col("x")[i].cast("double") for i in range(len(NAMES))]
    moments = np.array(train.agg(*[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first(), dtype=float)
    centre, scale = moments[: len(NAMES)], np.maximum(moments[len(NAMES) :], 1e-6)
    width = 2 * len(NAMES)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, bad = (expand(_matrix(batch.column(c), len(NAMES)), centre, scale) for c in (0, 1))
            z = pa.FixedSizeListArray.from_arrays(pa.array((good - bad).astype(np.float32).ravel()), width)
            yield pa.RecordBatch.from_arrays([z.cast(pa.list_(pa.float32()))], ["z"])

    drawn = materialise(preferences(train, counts, pairs).mapInArrow(differences, "z array<float>"), "quality-pairs")
    unit = pairs / drawn.count()
    w = np.zeros(width)
    for _ in range(rounds):
        # of a preference the difference won; the same one lost adds an equal loss, gradient and curvature
        def slopes(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            g, h = np.zeros(width), np.zeros((width, width))
            for batch in batches:
                z = _matrix(batch.column(0), width)
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                g += z.T @ (p - 1)
                h += (z * (p * (1 - p))[:, None]).T @ z
            sums = np.concatenate([g, h.ravel()])
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(sums), len(sums)).cast(pa.list_(pa.float64()))], ["s"])

        sums = unit * sum(np.array(r.s) for r in drawn.mapInArrow(slopes, "s array<double>").collect())
        step = np.linalg.solve(sums[width:].reshape(width, width) + L2 * np.eye(width), sums[:width] + L2 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return {"w": w, "centre": centre, "scale": scale, "counts": counts}


def raw_scores(featured: DataFrame, key: str, model: dict) -> DataFrame:
    """(key, v): the linear score of every row."""
    w, centre, scale = model["w"], model["centre"], model["scale"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = expand(_matrix(batch.column(1), len(NAMES)), centre, scale) @ w
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v)], [key, "v"])

    return featured.select(key, "x").mapInArrow(run, f"`{key}` {featured.schema[key].dataType.simpleString()}, v double")


def threshold(scores: DataFrame, counts: dict[int, int], share_bad: float) -> tuple[float, float]:
    """The score below which a ``share_bad`` of the (re-weighted) training documents lies, and a score unit.

    ``scores`` holds (_y, v) of all training documents. A histogram is narrowed to the one value at
    which the weight below reaches the share; the cut stands beside it, on the side nearer to the share.
    """
    v, y = F.col("v"), F.col("_y")
    mass = lambda good, bad: good * (1 - share_bad) / counts[1] + bad * share_bad / counts[0]
    ends = scores.agg(F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_pop(v).alias("sd")).first()
    low, high, good, bad, here = ends.low, ends.high, 0, 0, (counts[1], counts[0])
    while low < high:
        bin_ = F.least(F.floor((v - F.lit(low)) / F.lit(high - low) * BINS), F.lit(BINS - 1)).alias("bin")
        bins = scores.filter(v.between(low, high)).groupBy(bin_)
        bins = bins.agg(F.sum(y).alias("good"), F.sum(1 - y).alias("bad"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("bin").collect()
        for b in bins:
            low, high, here = b.low, b.high, (b.good, b.bad)
            if b is bins[-1] or mass(good + b.good, bad + b.bad) >= share_bad - 1e-9:
                break
            good, bad = good + b.good, bad + b.bad
    near = scores.agg(F.max(F.when(v < low, v)).alias("before"), F.min(F.when(v > low, v)).alias("after")).first()
    above = abs(mass(good + here[0], bad + here[1]) - share_bad) <= abs(share_bad - mass(good, bad))
    other = near.after if above else near.before
    return (low if other is None else (low + other) / 2), max(ends.sd / 2, 1e-6)


def bad_share(labels: DataFrame, key: str = "doc_id", label: str = "quality", held: int = 0) -> float:
    """Share of bad documents among all training labels."""
    known = labels.filter(F.col(key).isNotNull() & (remainder(F.col(key)) != held) & F.col(label).isin(0, 1))
    row = known.agg(F.avg((F.col(label) == 0).cast("double"))).first()
    return float(row[0]) if row[0] is not None else 0.0


def score_quality(
    documents: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    pairs: int = PAIRS,
    row: str | None = None,
) -> DataFrame:
    """(key, score): the quality score of every row of ``documents``; with ``row`` that column instead of the key."""
    out = row or key
    body = documents.select(F.col(out).alias("_o"), F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    featured = materialise(_mapped(body, "_o", "_k"), "quality-features")
    train = training_features(featured.select("_k", "x"), documents, labels, key, text)
    model = fit(train, pairs)
    if not model:
        return featured.select(F.col("_o").alias(out), F.lit(0.5).alias("score"))
    scores = materialise(raw_scores(train, "_y", model), "quality-scores")
    cut, unit = threshold(scores, model["counts"], bad_share(labels, key))
    raw = (F.col("v") - F.lit(cut)) / F.lit(unit) + F.lit(float(np.log(CUT / (1 - CUT))))
    score = 1 / (1 + F.exp(-F.greatest(F.least(raw, F.lit(30.0)), F.lit(-30.0))))
    return raw_scores(featured, "_o", model).select(F.col("_o").alias(out), score.alias("score"))


def decisions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract rows of query op10."""
    scored = score_quality(documents, labels)
    held = (remainder(F.col("doc_id")) == 0).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
