"""Spelling variants: words of the vocabulary that differ in one code point, by dynamic programming over sorted lists.

1. Vocabulary. Tasks count runs of letters and keep one row a word and task; what arrives
   at a word's sum is as many rows as tasks.
2. Cells. An edit stands in one half of the shorter word, so the two words share all that is
   outside that half. A word of n letters thus joins four lists: as the shorter and as the
   longer word of a pair, with either half of the shorter word open. A list that is too long
   is cut again, by halving its open part, until it is short or one letter is open; then
   the alphabet bounds it. Each pair meets in exactly one list: the one in which its first
   difference is open.
3. Scan. The open parts of a list stand in sorted order. Rows of the edit matrix (three cells
   of the band around the diagonal) are made once for each prefix that neighbours in the
   list share, as their longest common prefixes tell, and reused for all of them; a
   query leaves a whole range of the list when its row for the range's prefix holds nothing
   below two. All lists of a batch advance together, one letter a turn.
4. Forms. A word's form is its near word with the largest count; roots follow by pointer
   jumping, which ends because a form's count is at least twice the word's.

Null texts have no words; a null id reads as the empty text before the colon. Texts are read in
pieces cut between runs. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finwake.llm.store import materialise

LETTERS = "a-zA-ZÀ-ÿ"
RUN, GAP = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")
EVERY = 97  # one run in so many loses a letter
SHORTEST, LEAST, TIMES = 5, 3, 2
PIECE = 1 << 20
HELD = 1 << 18  # words that a task holds before it hands on their counts
LONGEST_LIST = 20_000
BATCH = 30_000


# ------------------------------------------------------------------ vocabulary
class _Runs:
    """Runs of letters by number, with their lengths and checksums, and how often each was seen (whole or shortened)."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.runs: list[str] = []
        self.size, self.crc = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.seen = np.zeros(1 << 12, np.int64)
        self.shortened: dict[str, int] = {}

    def numbers(self, found: list[str]) -> np.ndarray:
        for run in set(found).difference(self.number):
            if len(self.runs) == len(self.size):
                self.size, self.crc, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.crc, self.seen))
            raw = run.encode()
            self.size[len(self.runs)], self.crc[len(self.runs)] = len(raw), zlib.crc32(raw)
            self.number[run] = len(self.runs)
            self.runs.append(run)
        return np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))

    def add(self, doc: str, found: list[str]) -> None:
        at = self.numbers(found)
        start, size = zlib.crc32(f"{doc}:".encode()), self.size[at]
        # a checksum is linear: of start and run together it is the run's own, changed by start moved over as many zeros
        moved = np.zeros(int(size.max()) + 1, np.int64)
        for n in np.unique(size).tolist():
            zeros = b"\0" * n
            moved[n] = zlib.crc32(zeros, start) ^ zlib.crc32(zeros)
        h = self.crc[at] ^ moved[size]
        cut = h % EVERY == 0
        self.seen += np.bincount(at[~cut], minlength=len(self.seen))
        for i, c in zip(at[cut].tolist(), h[cut].tolist()):
            run = self.runs[i]
            k = c % len(run)
            word = run[:k] + run[k + 1 :]
            self.shortened[word] = self.shortened.get(word, 0) + 1

    def counts(self) -> pa.RecordBatch:
        total = dict(self.shortened)
        for run, n in zip(self.runs, self.seen[: len(self.runs)].tolist()):
            if n:
                total[run] = total.get(run, 0) + n
        kept = [(w, n) for w, n in total.items() if len(w) >= SHORTEST]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])


def lower_ascii(text: str) -> str:
    return text.encode().lower().decode()


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    at = 0
    while len(text) - at > limit:
        gap = GAP.search(text, at + limit)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def vocabulary(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least five code points with at least three occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for r in range(batch.num_rows):
                for piece in pieces(texts[r].as_py() or ""):
                    found = RUN.findall(lower_ascii(piece))
                    if found:
                        runs.add(ids[r].as_py() or "", found)
                if len(runs.runs) > HELD:
                    yield runs.counts()
                    runs = _Runs()
        yield runs.counts()

    counted = documents.select(F.col(key).cast("string").alias("_id"), F.col(text).alias("_text")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


# ------------------------------------------------------------------ cells
def _cell(length: F.Column, a: F.Column, b: F.Column) -> list[F.Column]:
    """cell, mid: the list of words of ``length`` (or one more) whose letters a to b of the shorter word are open."""
    tail = length - b
    own = F.char_length("word")
    cell = F.concat_ws("\u0001", length, a, b, F.expr("substring(word, 1, _a)"), F.when(tail > 0, F.expr("substring(word, -_tail)")))
    return [cell.alias("cell"), F.expr("substring(word, _a + 1, _own - _a - _tail)").alias("mid"), (own == length).alias("short")]


def _placed(words: DataFrame) -> DataFrame:
    """Rows (word, n, length, a, b) with their cells."""
    c = F.col
    words = words.withColumns({"_a": c("a"), "_tail": c("length") - c("b"), "_own": F.char_length("word")})
    return words.select("word", "n", "length", "a", "b", *_cell(c("length"), c("a"), c("b")))


def lists(words: DataFrame, longest: int = LONGEST_LIST) -> DataFrame:
    """(cell, mid, short, last, n, word): all lists that hold a pair, each of bounded length."""
    own = F.char_length("word")
    halves = lambda size: [
        F.struct(size.alias("length"), F.lit(0).alias("a"), F.floor(size / 2).cast("int").alias("b")),
        F.struct(size.alias("length"), F.floor(size / 2).cast("int").alias("a"), size.alias("b")),
    ]
    roles = words.select("word", "n", F.inline(F.array(*halves(own), *halves(own - 1))))
    todo, out = _placed(roles.filter(F.col("length") >= SHORTEST - 1)), None
    while True:
        sizes = todo.groupBy("cell").agg(F.count("*").alias("m"), F.count_if("short").alias("shorts")).filter("m > 1 and shorts > 0")
        placed = materialise(todo.join(sizes, "cell"), "variants-lists")
        long = (F.col("m") > longest) & (F.col("b") - F.col("a") > 1)
        ready = placed.filter(~long).select("cell", "mid", "short", (F.col("b") == F.col("length")).alias("last"), "n", "word")
        out = ready if out is None else out.unionByName(ready)
        todo = placed.filter(long)
        if todo.isEmpty():
            return out
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        cut = F.array(F.struct("length", "a", middle.alias("b")), F.struct("length", middle.alias("a"), "b"))
        todo = _placed(todo.select("word", "n", F.inline(cut)))


# ------------------------------------------------------------------ the scan of sorted lists
def near_pairs(group: np.ndarray, mids: list[bytes], query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(q, e): entries at edit distance one, e from the list of q; entries are sorted by list and text, texts are single-byte.

    ``query`` marks the entries that ask; all of a list's queries have one length, m, and its entries m or m + 1.
    """
    n = len(mids)
    size = np.fromiter(map(len, mids), np.int64, n)
    width = int(size.max(initial=0)) + 3
    letters = np.zeros((n, width), np.uint8)
    flat = np.frombuffer(b"".join(mids), np.uint8)
    row = np.repeat(np.arange(n), size)
    letters[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    # longest common prefix with the entry before; -1 where a list begins
    lcp = np.full(n, -1, np.int64)
    alike = letters[1:] == letters[:-1]
    lcp[1:] = np.where(group[1:] == group[:-1], np.minimum(np.where(alike.all(axis=1), width, alike.argmin(axis=1)), np.minimum(size[1:], size[:-1])), -1)

    begin = np.flatnonzero(lcp < 0)
    end = np.r_[begin[1:], n]
    asks = np.flatnonzero(query)
    at = np.searchsorted(begin, asks, side="right") - 1
    lo, hi, q = begin[at], end[at], asks
    big = np.int8(9)
    rows = [np.full(len(q), big, np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)]
    left, right, depth = [], [], 0
    while len(q):
        # the ranges of entries that share one letter more, below the range of each (range, query)
        bounds = np.flatnonzero(lcp <= depth)
        starts = bounds[size[bounds] > depth]
        first = np.searchsorted(starts, lo)
        count = np.searchsorted(starts, hi) - first
        parent = np.repeat(np.arange(len(q)), count)
        child = starts[np.repeat(first, count) + np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)]
        q = q[parent]
        letter = letters[child, depth]
        r0, r1, r2 = (r[parent] for r in rows)
        differs = lambda k: (letters[q, k] != letter).astype(np.int8)
        n0 = np.minimum(r1 + 1, r0 + differs(depth - 1)) if depth else r1 + 1
        n1 = np.minimum(np.minimum(n0, r2) + 1, r1 + differs(depth))
        n2 = np.minimum(n1 + 1, r2 + differs(depth + 1))
        rows = [n0.astype(np.int8), n1.astype(np.int8), n2.astype(np.int8)]
        depth += 1
        ends = size[child] == depth
        found = ends & (np.where(size[q] == depth, n1, np.where(size[q] == depth - 1, n0, big)) == 1)
        left.append(q[found]), right.append(child[found])
        # a range whose prefix is over one edit away is left as a whole
        after = np.r_[bounds, n]
        lo = child
        hi = after[np.searchsorted(after, child, side="right")]
        alive = (np.minimum(np.minimum(n0, n1), n2) <= 1) & (hi - lo > ends)
        q, lo, hi, rows = q[alive], lo[alive], hi[alive], [r[alive] for r in rows]
    return np.concatenate(left or [asks[:0]]), np.concatenate(right or [asks[:0]])


def _near(table: pa.Table) -> pa.RecordBatch:
    """(word, n_near, best_n, best) of the words of complete lists, from these lists alone."""
    cell = table.column("cell").combine_chunks()
    group = np.cumsum(np.r_[0, np.asarray(cell.dictionary_encode().indices[1:]) != np.asarray(cell.dictionary_encode().indices[:-1])])
    mids = [m.encode("latin-1") for m in table.column("mid").to_pylist()]
    short, last = (table.column(c).to_numpy() for c in ("short", "last"))
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    q, e = near_pairs(group, mids, short)
    # a longer word that begins with the whole open part differs after it, unless nothing follows
    beyond = np.array([mids[b].startswith(mids[a]) for a, b in zip(q.tolist(), e.tolist())], bool)
    keep = short[e] | ~beyond | last[e]
    q, e = q[keep], e[keep]
    back = ~short[e]
    x, y = np.r_[q, e[back]], np.r_[e, q[back]]
    # of each word the near word of largest n, then the first in code-point order
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else x
    count = np.diff(np.r_[first, len(x)])
    take = lambda at: pa.array([words[i] for i in at.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([take(x[first]), pa.array(count), pa.array(n[y[first]]), take(y[first])], ["word", "n_near", "best_n", "best"])


def near_words(placed: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word that has a near one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows >= BATCH:
                at = rest.column("cell").to_pylist()
                cut = at.index(at[-1])
                if cut:
                    yield _near(rest.slice(0, cut))
                    rest = rest.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            yield _near(rest)

    dealt = placed.repartition("cell").sortWithinPartitions("cell", "mid")
    found = dealt.mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


# ------------------------------------------------------------------ the operator
def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words that have a form, by pointer jumping; each turn doubles how far a pointer reaches."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_onward"))
        now = materialise(now.join(onward, "root", "left").select("word", F.coalesce("_onward", "root").alias("root"), F.col("_onward").isNotNull().alias("moved")), "variants-roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(documents: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST_LIST) -> DataFrame:
    """One row a word: word, n, n_near, form (its near word of largest count, if at least twice its own), form_n, root."""
    words = materialise(vocabulary(documents, key, text), "variants-words")
    near = words.join(near_words(lists(words, longest)), "word", "left")
    follows = F.col("best_n") >= TIMES * F.col("n")
    near = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(follows, F.col("best")).alias("form"), F.when(follows, F.col("best_n")).alias("form_n")
    )
    near = materialise(near, "variants-near")
    roots = with_roots(near.filter("form is not null"))
    out = near.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
