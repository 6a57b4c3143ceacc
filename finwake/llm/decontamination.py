"""Benchmark decontamination by the CGK embedding and bit-sampling LSH.

Texts are lower-cased and cut into words: runs of letters, marks and digits of any script.
Spaces, punctuation and controls of all of Unicode separate words; in scripts without
spaces (Chinese, Japanese, Thai and others) every character is a word, and so is a symbol
such as an emoji. Stretches of a document within the allowed edit distance of an item are
found in three steps:

1. Embedding: a random walk reads a word at each step and stays or moves on by a random bit
   of (walk, step, word). Two texts read by the same walk meet again after an edit, so a few
   edits become few differing steps (Chakraborty, Goldenberg and Koucky).
2. Bit sampling: each repetition has its own walk and samples a few of its steps; the words
   read there are the key (``PLANS``, by the item's number of words). Walks begin at every
   word of a document and of an item (long items: every second), so some begin behind an
   edit wherever the edits stand. Where the key is equal, the item would start as many words
   earlier as its walk did.
3. Exact verification: the smallest edit distance in words between the item and any
   stretch of the document around these places. A hit needs similarity
   1 - edits / words >= ``similarity``.

Only the benchmark is shared with the tasks, in passes of at most ``MAX_ITEMS`` items of
bounded total size; documents are never shuffled to find hits.

Edge cases: null counts as empty; items of fewer words than one edit needs (five, at 0.8)
match word for word only; items without any word match nothing; equal items are separate
items; repeated documents each get their rows; other columns are not read; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finwake.llm import textops as X
from finwake.llm.store import free_names, with_rows

SIMILARITY = 0.8
MAX_ITEMS = 20_000
MAX_ITEM_BYTES = 4 << 20
# Of items with at least so many words: between starts of walks so many words, then the sampled steps of each repetition.
PLANS = (
    (64, 2, ((0, 2, 4, 7), (0, 2, 5, 8))),
    (20, 1, ((0, 2, 4, 7), (0, 3, 5, 8), (0, 2, 5, 8))),
    (10, 1, ((0, 2, 5), (0, 3, 5), (0, 3, 6), (0, 3, 6))),
    (5, 1, ((0, 2), (1, 4), (0, 3), (0, 3))),
)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FLAG_BITS = 22


def tokenise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with a zero (the pad) after each text, the text of each, and where each text begins."""
    rows = len(offsets) - 1
    start, end, row = X.unicode_words(data, offsets)
    h = X.word_hashes(data, start, end) | np.uint64(1)
    n = np.bincount(row, minlength=rows)
    out = np.zeros(len(h) + rows, np.uint64)
    out[np.arange(len(h)) + row] = h
    first = np.concatenate([[0], np.cumsum(n + 1)])
    return out, np.repeat(np.arange(rows), n + 1), first


def run_hashes(number: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` word numbers."""
    n = max(0, len(number) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _STEP + number[j : j + n].astype(np.uint64)
    return X.mix(h)


def walks(number: np.ndarray, repetition: int, steps: int) -> list[np.ndarray]:
    """Of each step the words that the walks of one repetition read which begin at every word (at the end: the last one)."""
    seed = np.uint64((1 + repetition) * int(_STEP) % (1 << 64))
    bits = X.mix(number.astype(np.uint64) + seed).astype(np.uint32)
    at = np.arange(len(number), dtype=np.int32)
    out = []
    for j in range(steps):
        out.append(at)
        at = at + (bits.take(at, mode="clip") >> np.uint32(j) & np.uint32(1)).astype(np.int32)
    return out


def sampled(number: np.ndarray, walk: list[np.ndarray], steps: tuple[int, ...]) -> np.ndarray:
    """The key of each walk: a hash of the words read at ``steps``."""
    h = np.zeros(len(number), np.uint64)
    wide = number.astype(np.uint64)
    for j in steps:
        h = h * _STEP + wide.take(walk[j], mode="clip")
    return X.mix(h)


def plan_of(words: int) -> int | None:
    """The index of the plan for an item, or None if it must match word for word."""
    return next((p for p, (least, _, _) in enumerate(PLANS) if words >= least), None)


class Items:
    """The benchmark, prepared: vocabulary, allowed edits, and the sorted keys of each plan and repetition."""

    def __init__(self, ids: list, texts: list[str], similarity: float):
        lowered = pa.array(texts, pa.large_string())
        parts = [tokenise(data, offsets) for _, _, data, offsets in X.slices(lowered)]
        taken = []
        for tokens, row, first in parts:
            taken += [tokens[first[i] : first[i + 1] - 1] for i in range(len(first) - 1)]
        keep = [i for i, w in enumerate(taken) if len(w)]
        self.ids = [ids[i] for i in keep]
        self.words = [taken[i] for i in keep]
        self.n = np.array([len(w) for w in self.words], np.int64)
        # at least one word must agree
        self.edits = np.minimum(np.floor(self.n * (1 - similarity) + 1e-9).astype(np.int64), self.n - 1)
        self.whole, self.keys = {}, {}
        if not len(self.words):
            return
        self.vocabulary = np.unique(np.concatenate(self.words))
        self.numbers = [np.searchsorted(self.vocabulary, w) + 1 for w in self.words]  # 0: in no item
        whole: dict[int, list] = {}
        keyed: dict[tuple[int, int], list] = {}
        for i, number in enumerate(self.numbers):
            n = len(number)
            plan = plan_of(n)
            if plan is None or not self.edits[i]:
                k = min(n, PLANS[-1][0])
                whole.setdefault(k, []).append((run_hashes(number, k)[:1], np.array([i]), np.array([0])))
                continue
            _, stride, repetitions = PLANS[plan]
            some = False
            for r, steps in enumerate(repetitions):
                walk = walks(number, r, max(steps) + 1)
                start = np.arange(0, n, stride)
                read = np.array([walk[j][start] for j in steps])
                # walks that end inside the item and read different places say most
                good = (read[-1] < n) & (np.diff(read, axis=0) > 0).all(axis=0)
                if r + 1 == len(repetitions) and not some and not good.any():
                    good = read[-1] < n
                some |= good.any()
                start = start[good]
                keyed.setdefault((plan, r), []).append((sampled(number, walk, steps)[start], np.full(len(start), i), start))
        self.whole = {k: self._table(v) for k, v in sorted(whole.items())}
        self.keys = {k: self._table(v) for k, v in sorted(keyed.items())}

    @staticmethod
    def _table(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        keys, item, offset = (np.concatenate(x) for x in zip(*rows))
        order = np.argsort(keys, kind="stable")
        flags = np.zeros(1 << _FLAG_BITS, bool)
        flags[keys >> np.uint64(64 - _FLAG_BITS)] = True
        return flags, keys[order], item[order].astype(np.int64), offset[order].astype(np.int64)


def _looked_up(table: tuple[np.ndarray, ...], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``h``, item, offset of the key in the item) of all equal keys."""
    flags, keys, of, offset = table
    at = np.flatnonzero(flags[h >> np.uint64(64 - _FLAG_BITS)])
    lo, hi = np.searchsorted(keys, h[at], side="left"), np.searchsorted(keys, h[at], side="right")
    many = hi - lo
    which = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
    return np.repeat(at, many), of[which], offset[which]


def candidates(items: Items, number: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, text, word where the item would start) of every key found, in this order and without repeats."""
    found = [_looked_up(table, run_hashes(number, k)) for k, table in items.whole.items()]
    for r in sorted({r for _, r in items.keys}):
        mine = [(PLANS[p][2][q], table) for (p, q), table in items.keys.items() if q == r]
        walk = walks(number, r, max(max(steps) for steps, _ in mine) + 1)
        found += [_looked_up(table, sampled(number, walk, steps)) for steps, table in mine]
    at, item, offset = (np.concatenate(x) for x in zip(*found))
    text, start = row[at], at - offset
    order = np.lexsort((start, text, item))
    item, text, start = item[order], text[order], start[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1])
    return item[new], text[new], start[new]


def smallest_distance(pattern: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``windows``: the least edit distance of ``pattern`` to any stretch of it, and where that ends."""
    c, width = windows.shape
    n = len(pattern)
    index = np.arange(n + 1, dtype=np.int32)
    d = np.broadcast_to(index, (c, n + 1)).copy()
    best, end = d[:, n].copy(), np.zeros(c, np.int64)
    for j in range(width):
        w = windows[:, j]
        x = np.empty_like(d)
        x[:, 0] = 0
        np.minimum(d[:, 1:] + 1, d[:, :-1] + (pattern[None, :] != w[:, None]), out=x[:, 1:])
        x -= index
        np.minimum.accumulate(x, axis=1, out=x)
        x += index
        d = x
        better = d[:, n] < best
        best[better], end[better] = d[better, n], j + 1
    return best, end


def verify(items: Items, number: np.ndarray, first: np.ndarray, item: np.ndarray, text: np.ndarray, start: np.ndarray):
    """(text, item, edits, end word) of the true hits: one per text and item, the closest.

    Candidates whose surroundings overlap are one stretch, so its words are compared once.
    """
    best: dict[tuple[int, int], tuple[int, int]] = {}
    if not len(item):
        return []
    n, e = items.n[item], items.edits[item]
    lo = np.maximum(start - e, first[text])
    hi = np.minimum(start + n + e, first[text + 1] - 1)
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (lo[1:] > hi[:-1])
    head = np.flatnonzero(new)
    item, text, lo, hi = item[head], text[head], lo[head], np.maximum.reduceat(hi, head)
    for i in np.unique(item):
        mine = np.flatnonzero(item == i)
        mine = mine[np.argsort(hi[mine] - lo[mine], kind="stable")]
        n, e = int(items.n[i]), int(items.edits[i])
        own = np.zeros(len(items.vocabulary) + 1, bool)
        own[items.numbers[i]] = True
        a = 0
        while a < len(mine):
            # rows of about the same width, of bounded size in all
            width = int(hi[mine[a]] - lo[mine[a]])
            b = min(len(mine), a + max(1, (1 << 21) // (max(n, width) + 1)))
            b = a + int(np.searchsorted(hi[mine[a:b]] - lo[mine[a:b]], 2 * width + 16, side="right"))
            part = mine[a:b]
            a = b
            grid = lo[part][:, None] + np.arange(int((hi[part] - lo[part]).max()))
            window = np.where(grid < hi[part][:, None], number[np.minimum(grid, len(number) - 1)], 0)
            # at least n - e words of the stretch must be words of the item
            good = own[window].sum(axis=1) >= n - e
            if not good.any():
                continue
            part = part[good]
            edits, end = smallest_distance(items.numbers[i], window[good])
            for k in np.flatnonzero(edits <= e).tolist():
                r = int(text[part[k]])
                hit = (int(edits[k]), int(lo[part[k]] + end[k] - first[r]))
                best[r, int(i)] = min(best.get((r, int(i)), hit), hit)
    return [(r, i, d, w) for (r, i), (d, w) in sorted(best.items())]


def matches(items: Items, column) -> list[tuple[int, int, int, int]]:
    """(row of the column, item, edits, word after the hit) over a whole column of lower-cased texts."""
    out = []
    if not items.ids:
        return out
    for a, _, data, offsets in X.slices(column):
        tokens, row, first = tokenise(data, offsets)
        number = np.searchsorted(items.vocabulary, tokens)
        number[number == len(items.vocabulary)] = 0
        number = np.where(items.vocabulary[number] == tokens, number + 1, 0)
        out += [(a + r, i, d, w) for r, i, d, w in verify(items, number, first, *candidates(items, number, row))]
    return out


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(key, item, edits, similarity, end_word): every document and item that it holds a copy of."""
    spark = documents.sparkSession
    facts = benchmark.agg(F.count("*"), F.sum(F.octet_length(F.col(text)))).first()
    passes = max(1, math.ceil((facts[0] or 0) / MAX_ITEMS), math.ceil((facts[1] or 0) / MAX_ITEM_BYTES))
    kind, item_kind = documents.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item}` {item_kind}, edits int, similarity double, end_word bigint"
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    body = documents.select(key, lowered)
    result = None
    for p in range(passes):
        part = benchmark.select(F.col(item).alias("i"), lowered.alias("t")).filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == p)
        rows = sorted(((r.i, r.t) for r in part.collect()), key=lambda x: (str(x[0]), x[1]))  # at most MAX_ITEMS, MAX_ITEM_BYTES
        prepared = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], similarity))

        def run(batches: Iterator[pa.RecordBatch], prepared=prepared) -> Iterator[pa.RecordBatch]:
            items = prepared.value
            for batch in batches:
                hits = matches(items, batch.column(1))
                if hits:
                    r, i, d, w = (np.array(x) for x in zip(*hits))
                    names = pa.array([items.ids[k] for k in i.tolist()])
                    if names.type == pa.null():
                        names = names.cast(pa.int64())
                    arrays = [batch.column(0).take(pa.array(r)), names, pa.array(d, pa.int32()), pa.array(1 - d / items.n[i]), pa.array(w, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, [key, item, "edits", "similarity", "end_word"])

        found = body.mapInArrow(run, schema)
        result = found if result is None else result.unionByName(found)
    return result


def clean(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents without any hit, columns unchanged; rows that share a key are decided one by one.

    The rows of contaminated documents go back by an anti join that Spark plans by their size.
    """
    (row,) = free_names([*documents.columns, *benchmark.columns], "_row")
    rows = with_rows(documents, key, row, "clean-rows")
    bad = contaminated(rows, benchmark, row).select(row).distinct()
    return rows.join(bad, row, "left_anti").select(*documents.columns)
