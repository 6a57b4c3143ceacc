"""Toxicity by class-conditional Kneser-Ney models.

One Kneser-Ney bigram model is fitted on toxic and one on ordinary texts:

    P_c(w | v) = (n_c(v w) - D) / n_c(v .) + g_c(v) (B_c(w) / 2 + S(w | v) / 2)
    B_c(w)     = (N_c(. w) - D) / N_c(. .) + g_c S(w)

n_c counts the documents of class c with the pair (equal texts once), N_c(. w) the different
words before w. The discounts D of each class and order follow from its counts of counts
(Chen and Goodman), g is the mass that they set free. S, the backoff shared by both classes,
is a Kneser-Ney bigram model of both together: a rare expression is about equally likely under
both models and says little.

A text is judged by the difference of the two log-likelihoods, divided by its length: of the
whole text and of the run that looks most toxic (toxic expressions are short, so a run is one
word or one pair), each under both orders of the model. A logistic curve turns the four
differences into a score in (0, 1). It is fitted on training texts that the models have not
seen: models of two of the four training folds judge the other two. No setting was chosen on
held-out labels.

Fitting uses at most ``PER_CLASS`` labelled documents of each class (a parameter); every
document is scored from its whole text. Words are counted on the executors; what comes back
are the counts of the bounded choice.

Edge cases: null counts as empty; an empty text scores as one without any evidence;
without labels of both classes every score is 0; of conflicting labels of an id the larger
counts, of its rows the least text; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finwake.llm import textops as X
from finwake.llm.labelled import by_id, logistic_fit, remainder, training_rows

PER_CLASS = 1000
ADDITIVE = 10.0  # of every word in the lowest order of the shared backoff; compared with 0.5, 3 and 30 on training rows
FEATURES = 4
_FLAG_BITS = 22


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, hash of the word before or 0 at the start, row) of lower-cased texts."""
    start, end, row = X.words(data, offsets, X.NOT_WORD)
    h = X.word_hashes(data, start, end)
    before = np.zeros_like(h)
    before[1:] = h[:-1]
    if len(row):
        before[np.concatenate([[True], row[1:] != row[:-1]])] = 0
    return h, before, row


def pair_key(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return X.mix(before * np.uint64(0x9E3779B97F4A7C15) + h)


def pair_counts(texts: DataFrame) -> DataFrame:
    """(_y, half, v, w, n): documents of a class and half of the folds that hold the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, half = (batch.column(k).to_numpy() for k in (0, 1))
            for a, _, data, offsets in X.slices(batch.column(2)):
                h, v, row = tokens(data, offsets)
                key = pair_key(v, h)
                order = np.lexsort((key, row))
                new = np.ones(len(order), bool)
                new[1:] = (row[order[1:]] != row[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
                one = order[new]
                at = row[one] + a
                yield pa.RecordBatch.from_arrays([pa.array(y[at]), pa.array(half[at]), pa.array(v[one].view(np.int64)), pa.array(h[one].view(np.int64))], ["_y", "half", "v", "w"])

    pairs = texts.select("_y", "half", "t").mapInArrow(run, "_y int, half int, v bigint, w bigint")
    return pairs.groupBy("_y", "half", "v", "w").agg(F.count("*").cast("int").alias("n"))


def discounts(count: np.ndarray) -> np.ndarray:
    """What is taken from each count: modified Kneser-Ney discounts for one, two and more, from the counts of counts."""
    n = [max(1, int((count == k).sum())) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    d = [0.0, *(min(max(x, 0.1), 0.95 * k) for k, x in zip((1, 2, 3), d))]
    return np.array(d)[np.minimum(count, 3).astype(np.int64)]


def order_two(v: np.ndarray, count: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair its discounted share of the pairs that begin alike; of each word the mass left to the backoff."""
    cut = discounts(count)
    total = np.bincount(v, weights=count, minlength=words)
    left = np.bincount(v, weights=cut, minlength=words)
    return (count - cut) / np.maximum(total, 1)[v], np.where(total > 0, left / np.maximum(total, 1), 1.0)


def fit_pair(v: np.ndarray, w: np.ndarray, count: np.ndarray) -> dict | None:
    """The models as tables: of pairs v w (hashes; ``count`` of both classes) and of words."""
    some = count.sum(axis=0) > 0
    v, w, count = v[some], w[some], count[:, some]
    if not count.shape[1] or not count.sum(axis=1).all():
        return None
    words = np.unique(np.concatenate([w, np.zeros(1, np.uint64)]))  # 0, the start, comes first
    a, b, size = np.searchsorted(words, v), np.searchsorted(words, w), len(words)
    pooled = count.sum(axis=0)
    seen = np.bincount(b, minlength=size).astype(float)
    low = (seen + ADDITIVE) / (seen.sum() + ADDITIVE * size)
    share, left = order_two(a, pooled, size)
    shared = share + left[a] * low[b]
    base, mass, pair = [], [], []
    for c in (0, 1):
        seen = np.bincount(b[count[c] > 0], minlength=size).astype(float)
        cut = discounts(seen)
        base.append((seen - cut) / seen.sum() + cut.sum() / seen.sum() * low)
        share, free = order_two(a, count[c], size)
        mass.append(free)
        pair.append(share + free[a] * (base[c][b] / 2 + shared / 2))
    key = pair_key(v, w)
    order = np.argsort(key)
    flags = np.zeros(1 << _FLAG_BITS, bool)
    flags[key >> np.uint64(64 - _FLAG_BITS)] = True
    narrow = lambda x: np.asarray(x, np.float32)
    return {"words": words, "low": narrow(low), "left": narrow(left), "base": narrow(base), "mass": narrow(mass), "key": key[order], "ratio": narrow(np.log(pair[1] / pair[0]))[order], "flags": np.packbits(flags)}


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def ratios(m: dict, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log P_1 / P_0 of every token by the lower order and by the whole model."""
    at, known = _places(m["words"], h)
    one = np.where(known, np.log(m["base"][1][at] / m["base"][0][at]), 0.0)
    v, old = _places(m["words"], before)
    shared = np.where(old, m["left"][v], 1.0) * m["low"][at]
    p = [np.where(old, m["mass"][c][v], 1.0) * (m["base"][c][at] / 2 + shared / 2) for c in (0, 1)]
    two = np.where(known, np.log(p[1] / p[0]), np.where(old, np.log(m["mass"][1][v] / m["mass"][0][v]), 0.0))
    key = pair_key(before, h)
    flagged = np.flatnonzero(m["bits"][key >> np.uint64(64 - _FLAG_BITS)])
    at, hit = _places(m["key"], key[flagged])
    two[flagged[hit]] = m["ratio"][at[hit]]
    return one, two


def evidence(m: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: the largest ratio of any word and the mean, by the lower order and by the whole model."""
    rows = len(offsets) - 1
    h, before, row = tokens(data, offsets)
    out = np.zeros((rows, FEATURES))
    if not len(h):
        return out
    n = np.bincount(row, minlength=rows)
    for k, x in enumerate(ratios(m, h, before)):
        top = np.full(rows, -np.inf)
        top[n > 0] = np.maximum.reduceat(x, np.concatenate([[0], np.cumsum(n)])[:-1][n > 0])
        out[:, 2 * k] = np.where(n > 0, top, 0.0)
        out[:, 2 * k + 1] = np.bincount(row, weights=x, minlength=rows) / np.maximum(n, 1)
    return out


def _opened(m: dict) -> dict:
    return m | {"bits": np.unpackbits(m["flags"]).view(bool)}


def evidence_of(m: dict, column) -> np.ndarray:
    parts = [evidence(m, data, offsets) for _, _, data, offsets in X.slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


def _inputs(e: np.ndarray) -> np.ndarray:
    return np.concatenate([e, np.ones((len(e), 1))], axis=1)


def fit(rows: DataFrame, prior: float) -> dict | None:
    """The models of both classes and the curve, from training rows (_k, f, _y, _text)."""
    # equal texts of a class count once and are judged once
    texts = rows.groupBy("_y", F.lower("_text").alias("t")).agg(F.min("_k").alias("_k"), F.min(F.col("f") % 2).cast("int").alias("half"))
    table = pair_counts(texts).toArrow()
    v, w = (table.column(c).to_numpy().view(np.uint64) for c in ("v", "w"))
    y, half, n = (table.column(c).to_numpy() for c in ("_y", "half", "n"))
    _, first, at = np.unique(pair_key(v, w), return_index=True, return_inverse=True)
    v, w = v[first], w[first]
    counts = np.zeros((2, 2, len(first)))  # half, class, pair
    np.add.at(counts, (half, y, at), n)
    del table, first, at, half, n
    pa.default_memory_pool().release_unused()
    model = fit_pair(v, w, counts.sum(axis=0))
    if model is None:
        return None
    halves = [fit_pair(v, w, counts[1 - k]) for k in (0, 1)]  # what judges half k has not seen it
    del v, w, counts
    if None in halves:
        return model | {"curve": np.array([1.0, 0.0, 0.0, 0.0, -4.0])}
    kind = rows.schema["_k"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(halves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [_opened(m) for m in shared.value]
        for batch in batches:
            half = batch.column(1).to_numpy()
            e = np.where((half == 0)[:, None], *(evidence_of(m, batch.column(3)) for m in models))
            x = pa.FixedSizeListArray.from_arrays(pa.array(e.ravel()), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), x], ["_k", "_y", "x"])

    judged = texts.select("_k", "half", "_y", "t").mapInArrow(run, f"_k {kind}, _y int, x array<double>").toArrow()
    found = by_id(list(zip(*(judged.column(c).to_pylist() for c in ("_k", "_y", "x")))))
    shared.destroy()
    y, e = np.array([r[1] for r in found]), np.array([r[2] for r in found])
    # the choice is balanced by class; weights bring the curve back to the share of toxic labels
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    return model | {"curve": logistic_fit(_inputs(e), y, l2=0.01, weight=weight)}


def toxic_share(labels: DataFrame, key: str = "doc_id", held: int = 0) -> float:
    known = labels.filter(F.col(key).isNotNull() & (remainder(F.col(key)) != held) & F.col("toxic").isin(0, 1))
    row = known.agg(F.avg(F.col("toxic").cast("double"))).first()
    return min(max(float(row[0] or 0.0), 1e-3), 1 - 1e-3)


def score_toxicity(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """(key, score, word_ratio, word_mean, pair_ratio, pair_mean): score and length-normalised differences of every row."""
    model = fit(training_rows(documents, labels, "toxic", per_class, key, text), toxic_share(labels, key))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # as long as the chosen texts: per_class of them a class
    kind = documents.schema[key].dataType.simpleString()
    names = ["word_ratio", "word_mean", "pair_ratio", "pair_mean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value and _opened(shared.value)
        for batch in batches:
            if m is None:
                e, score = np.zeros((batch.num_rows, FEATURES)), np.zeros(batch.num_rows)
            else:
                e = evidence_of(m, batch.column(1))
                score = 1 / (1 + np.exp(-np.clip(_inputs(e) @ m["curve"], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), *(pa.array(x) for x in e.T.copy())], [key, "score", *names])

    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    return documents.select(key, body).mapInArrow(run, f"`{key}` {kind}, score double, " + ", ".join(f"{n} double" for n in names))


def decisions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract rows of query op4, with the four differences."""
    scored = score_toxicity(documents, labels)
    held = (remainder(F.col("doc_id")) == 0).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "word_ratio", "word_mean", "pair_ratio", "pair_mean")
