"""Boosted trees over quantile bins, grown by Spark aggregates, with missing values as they are.

Inputs are cut into at most ``BINS`` bins at exact quantiles of a sample drawn by the hash of
the id (at most about ``SAMPLE`` rows); bin 0 is the missing value. A level of a tree is one pass
over the rows: tasks add up gradients and hessians by node, input and bin, a node's sums meet in
one task, which tries every cut with the missing rows on either side, and the driver gets one
row a node. All nodes down to ``depth`` are tried, then the best ones are taken, largest gain
first, until the tree has ``leaves`` leaves: the same tree as growing it leaf by leaf.

Gradients are whole numbers (units of 2**-20), so sums, trees and scores do not depend on how
rows are dealt over partitions. Missing inputs in later data go where a split sent those of the
training rows, or to its larger side if there were none.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finwake.sources.shared import written
from finwake.sources.sinks import write_metrics

BINS = 64
SAMPLE = 100_000
UNIT = float(1 << 20)
RATE, LEAVES, MIN_ROWS, MIN_HESSIAN = 0.1, 31, 20, 1e-3
KEEP = 10  # trees between two writings of the raw scores


@dataclass
class Tree:
    """Splits by heap number (children of i: 2i and 2i + 1) and the value of each leaf."""

    splits: dict[int, tuple[int, int, bool]] = field(default_factory=dict)  # input, last bin on the left, missing left
    values: dict[int, float] = field(default_factory=dict)

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        at = np.ones(len(bins), np.int64)
        size = 2 * max(self.splits, default=0) + 2
        column, last, missing = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, bool)
        for i, (c, b, m) in self.splits.items():
            column[i], last[i], missing[i] = c, b, m
        moving = np.arange(len(bins))
        while len(moving):
            moving = moving[(at[moving] < size) & (column[np.minimum(at[moving], size - 1)] >= 0)]
            here = at[moving]
            b = bins[moving, column[here]]
            left = np.where(b == 0, missing[here], b <= last[here])
            at[moving] = 2 * here + ~left
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        value = np.zeros(max(self.values) + 1)
        value[list(self.values)] = list(self.values.values())
        return value[self.places(bins)]


def to_bins(columns: list[pa.Array], cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of all rows and inputs; null and NaN are bin 0, x is in bin k + 1 if k cuts are below it."""
    out = np.zeros((len(columns[0]), len(columns)), np.uint8)
    for c, column in enumerate(columns):
        x = column.to_numpy(zero_copy_only=False).astype(float)
        out[:, c] = np.where(np.isnan(x), 0, np.searchsorted(cuts[c], x, side="left") + 1)
    return out


def best_split(sums: np.ndarray, min_rows: int = MIN_ROWS) -> tuple:
    """(input, bin, missing left, gain, left g and h, right g and h) from sums [input, bin, (g, h, n)]; input -1: no split."""
    total = sums[0].sum(axis=0)
    g, h, n = (sums[:, :, k] for k in range(3))
    score = lambda a, b: np.where(b > 0, (a / UNIT) ** 2 / np.maximum(b / UNIT, 1e-300), 0)
    best = (-1, 0, False, 0.0, int(total[0]), int(total[1]), 0, 0)
    whole = float(score(total[:1], total[1:2])[0])
    sides = []
    for missing in (False, True):
        left = np.stack([np.cumsum(x[:, 1:], axis=1) + missing * x[:, :1] for x in (g, h, n)])
        right = total[:, None, None] - left
        fine = (np.minimum(left[2], right[2]) >= min_rows) & (np.minimum(left[1], right[1]) >= MIN_HESSIAN * UNIT)
        gain = np.where(fine, score(left[0], left[1]) + score(right[0], right[1]) - whole, -np.inf)
        sides.append((gain, left, right))
    gain = np.stack([s[0] for s in sides], axis=2)  # ties: first input, first bin, missing right
    c, b, m = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[c, b, m] > 1e-9:
        _, left, right = sides[m]
        if n[c, 0] == 0:
            m = left[2, c, b] > right[2, c, b]
        best = (int(c), int(b) + 1, bool(m), float(gain[c, b, min(int(m), 1)] if n[c, 0] else gain[c, b, 0]), int(left[0, c, b]), int(left[1, c, b]), int(right[0, c, b]), int(right[1, c, b]))
    return best


def grow(found: dict[int, tuple], leaves: int = LEAVES, rate: float = RATE) -> Tree:
    """The best-first tree from the best split of every node that was tried."""
    tree, value = Tree(), lambda g, h: -rate * g / h if h else 0.0
    tree.values[1] = value(found[1][4] + found[1][6], found[1][5] + found[1][7]) if 1 in found else 0.0
    heap = [(-found[1][3], 1)] if 1 in found and found[1][0] >= 0 else []
    while heap and len(tree.values) < leaves:
        _, i = heapq.heappop(heap)
        c, b, m, _, lg, lh, rg, rh = found[i]
        tree.splits[i] = (c, b, m)
        del tree.values[i]
        for child, v in ((2 * i, value(lg, lh)), (2 * i + 1, value(rg, rh))):
            tree.values[child] = v
            if child in found and found[child][0] >= 0:
                heapq.heappush(heap, (-found[child][3], child))
    return tree


def _bins_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, width)


def _level(state: DataFrame, trees: list[Tree], grown: Tree, depth: int, width: int, weights: dict[int, float], min_rows: int) -> dict[int, tuple]:
    """The best split of every node at ``depth`` of the tree in growth."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = 1 << depth
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            bins, y, raw = _bins_of(batch, width), batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy().copy()
            for tree in trees:
                raw += tree.scores(bins)
            p = 1 / (1 + np.exp(-raw))
            w = np.where(y == 1, weights.get(1, 0.0), weights.get(0, 0.0))
            parts = [np.rint(w * (p - y) * UNIT), np.rint(w * p * (1 - p) * UNIT), np.ones(len(y))]
            at = grown.places(bins)
            rows = np.flatnonzero(at >= first)
            nodes, place = np.unique(at[rows], return_inverse=True)
            # one count over (node, input, bin) a batch, however many nodes the level has
            cell = ((place[:, None] * width + np.arange(width)) * (BINS + 1) + bins[rows]).ravel()
            size = len(nodes) * width * (BINS + 1)
            met = [np.bincount(cell, np.repeat(part[rows], width), size).astype(np.int64) for part in parts]
            for node, here in zip(nodes.tolist(), np.stack(met, axis=1).reshape(-1, width, BINS + 1, 3)):
                sums[node] = sums[node] + here if node in sums else here
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["node", "sums"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for node, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(packed, np.int64).reshape(width, BINS + 1, 3)
                sums[node] = sums[node] + part if node in sums else part
        rows = [(node, json.dumps(best_split(s, min_rows))) for node, s in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["node", "best"])

    met = state.mapInArrow(add_up, "node bigint, sums binary").repartition("node")
    return {r.node: tuple(json.loads(r.best)) for r in met.mapInArrow(choose, "node bigint, best string").collect()}


@dataclass
class BoostedTrees:
    """Cuts of the inputs and the trees; ``score`` gives the probability of label 1."""

    inputs: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree]

    def score(self, rows: DataFrame, *keep: str) -> DataFrame:
        inputs, cuts, trees, n = self.inputs, self.cuts, self.trees, len(keep)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", score double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = to_bins(batch.columns[n:], cuts)
                raw = np.zeros(batch.num_rows)
                for tree in trees:
                    raw += tree.scores(bins)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(1 / (1 + np.exp(-raw)))], [*batch.schema.names[:n], "score"])

        return rows.select(*keep, *[F.col(c).cast("double").alias(f"_in{i}") for i, c in enumerate(inputs)]).mapInArrow(run, schema)

    def save(self, path: str, spark: SparkSession) -> str:
        trees = [{"splits": [[i, *s] for i, s in t.splits.items()], "values": list(t.values.items())} for t in self.trees]
        return write_metrics({"inputs": self.inputs, "cuts": [c.tolist() for c in self.cuts], "trees": trees}, f"{path}/trees.json", spark)

    @staticmethod
    def load(path: str, spark: SparkSession) -> BoostedTrees:
        data = json.loads(spark.read.text(f"{path}/trees.json", wholetext=True).first()[0])
        trees = [Tree({s[0]: tuple(s[1:]) for s in t["splits"]}, dict(map(tuple, t["values"]))) for t in data["trees"]]
        return BoostedTrees(data["inputs"], [np.array(c) for c in data["cuts"]], trees)


def quantile_cuts(rows: DataFrame, inputs: list[str], key: str, count: int, sample: int = SAMPLE) -> list[np.ndarray]:
    """Up to ``BINS`` - 1 ascending cuts of each input: quantiles of the rows whose id's hash falls in the sample."""
    some = rows.filter(F.pmod(F.xxhash64(key), F.lit(max(1, -(-count // sample)))) == 0)
    shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    row = some.agg(*[F.percentile(value(c), shares).alias(f"q{i}") for i, c in enumerate(inputs)]).first()
    return [np.unique(np.array(q or [], float)) for q in row]


def fit(
    rows: DataFrame,
    inputs: list[str],
    label: str = "is_laundering",
    key: str = "txn_id",
    trees: int = 200,
    depth: int = 8,
    leaves: int = LEAVES,
    rate: float = RATE,
    min_rows: int = MIN_ROWS,
) -> BoostedTrees:
    """Trees on balanced classes; rows without a label take no part."""
    rows = rows.filter(F.col(label).isNotNull())
    counts = {int(r[0]): r.n for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two labels
    total = sum(counts.values())
    weights = {c: total / (2.0 * n) for c, n in counts.items()}
    if not total:
        return BoostedTrees(list(inputs), [np.zeros(0)] * len(inputs), [])
    cuts, width = quantile_cuts(rows, inputs, key, total), len(inputs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = to_bins(batch.columns[1:], cuts)
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), batch.column(0), pa.array(np.zeros(len(bins)))], ["bins", "y", "raw"])

    numbers = [F.col(c).cast("double").alias(f"_in{i}") for i, c in enumerate(inputs)]
    state = written(rows.select(F.col(label).cast("int"), *numbers).mapInArrow(cut, "bins binary, y int, raw double"), "boosting")
    out: list[Tree] = []
    fresh: list[Tree] = []  # not yet in the written raw scores
    for _ in range(trees):
        grown, found = Tree(), {}
        for level in range(depth):
            here = _level(state, fresh, grown, level, width, weights, min_rows)
            found |= here
            more = {i: s[:3] for i, s in here.items() if s[0] >= 0}
            if not more:
                break
            grown.splits |= more
        fresh.append(grow(found, leaves, rate))
        out.append(fresh[-1])
        if len(fresh) == KEEP:
            state, fresh = written(_advanced(state, fresh, width), "boosting"), []
    return BoostedTrees(list(inputs), cuts, out)


def _advanced(state: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, raw = _bins_of(batch, width), batch.column(2).to_numpy().copy()
            for tree in trees:
                raw += tree.scores(bins)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw)], ["bins", "y", "raw"])

    return state.mapInArrow(run, state.schema)
