"""Language-model scores by a weighted backoff automaton of order three.

Model: Jelinek-Mercer smoothing, the weight of the backoff following the count of the history,

    P(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1))
    P(w | v)   = (1 - b2(c(v))) c(v w) / c(v) + b2(c(v)) P(w)
    P(w | u v) = (1 - b3(c(u v))) c(u v w) / c(u v) + b3(c(u v)) P(w | v)

b_k(c) = d c^(a - 1): a history seen c times has about c^a different successors (Heaps), so
this is the share of new ones. d comes from the counts of counts of order k, a from the
number of different n-grams and the histogram of their histories' counts, both over all
training documents; nothing is tuned.

Automaton: the root, every training word and every training pair are states. State u v has an
arc for every w seen after it, with weight log10 P(w | u v), and a failure arc with weight
log10 b3(c(u v)) to state v, whose own leads with log10 b2(c(v)) to the root. The root has an arc
for every training word and one for all others. Each text is one left-to-right traversal from
the start (the end token): at a state without an arc for the next word failure arcs are
followed, adding their weights, then the arc found; the state after it is the longest seen
suffix, a pair, a word or the root.

``Automaton`` holds the part of it that a block can reach: arrays of states (failure target and
weight) and of arcs (state left, state reached, weight). A block's n-grams are numbered, and arc
number i stands for n-gram i, so the arc of a state for the next word is found without a search:
it is the number of the n-gram there, if that arc leaves this very state. All texts are walked side
by side, a word a step, each with its state. Long texts are cut into pieces of ``PIECE`` words; a
piece starts two words early at the root, which is enough to be in the state of the whole walk,
because no state remembers more than two words.

The model grows with the corpus and is never whole in one place. Each task
packs its texts into blocks, which are written down. A block lists its different words, pairs and
triples once, with its training counts, packed into sorted runs by hash range (64-bit keys).
One task per range merges the runs of all blocks (adding counts) and answers each block with
the corpus counts of what it asked for, in the order asked. So a block receives exactly the
part of the automaton that its texts can reach, and traverses all of them at once.

Edge cases: null counts as empty; an empty text is the end token alone; unseen words get
P with c = 0; repeated rows count each; other columns are not read; an empty table gives an
empty result; without training rows N = V = 0 and every word is unseen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finwake.llm import textops as X
from finwake.llm.labelled import remainder
from finwake.llm.store import materialise

END = np.uint64(0x5EED0F7E57E4D000)
HELD = 1  # the remainder that is kept out of training
BLOCK_BYTES = 10 << 20
MAX_ROWS = 1 << 18  # of a block, for very short texts
PIECE = 512  # words walked in one piece
ORDERS = ("w", "p", "t")  # words, pairs, triples
_STEP = np.uint64(0x9E3779B97F4A7C15)


def range_bits(blocks: int) -> int:
    """High key bits that deal runs to merge tasks: as many ranges as blocks, so a merge task stays the size of a block."""
    return max(4, math.ceil(math.log2(max(1, blocks))))


def text_tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """(token hash, row) of lower-cased (A-Z) texts; every row ends with one END."""
    hs, rs, base = [], [], 0
    for a, b, data, offsets in X.slices(column):
        data = X.lower_ascii(data)
        start, end, row = X.words(data, offsets)
        h = X.word_hashes(data, start, end)
        n = np.bincount(row, minlength=b - a)
        out = np.full(len(h) + b - a, END, np.uint64)
        at = np.arange(len(h)) + row
        out[at] = h
        hs.append(out)
        rs.append(np.repeat(np.arange(a, b), n + 1))
        base = b
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hs), np.concatenate(rs)


def grams(tokens: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first of its text, hashes of the token, of it with the one before, of it with the two before).

    The first token of a text follows END; a text's first token has no triple (its hash is that of the pair).
    """
    first = np.ones(len(tokens), bool)
    first[1:] = row[1:] != row[:-1]
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first] = END
    pairs = X.mix(before * _STEP + tokens)
    history = np.empty_like(pairs)
    history[1:] = pairs[:-1]
    triples = np.where(first, pairs, X.mix(history * _STEP + (tokens ^ END)))
    return first, tokens, pairs, triples


def _narrow(counts: np.ndarray) -> bytes:
    """Counts as bytes: a width byte, then fixed-width integers."""
    top = int(counts.max()) if len(counts) else 0
    kind = np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64
    if kind is np.uint8:
        return b"\x01" + counts.astype(np.uint8).tobytes()
    # few counts are large: one byte each, with the large ones listed apart
    big = np.flatnonzero(counts >= 255)
    small = np.where(counts >= 255, 255, counts).astype(np.uint8)
    return b"\x02" + len(counts).to_bytes(8, "little") + small.tobytes() + big.astype(np.uint32).tobytes() + counts[big].astype(np.uint64).tobytes()


def _wide(blob: bytes) -> np.ndarray:
    if blob[:1] == b"\x01":
        return np.frombuffer(blob, np.uint8, offset=1).astype(np.int64)
    n = int.from_bytes(blob[1:9], "little")
    out = np.frombuffer(blob, np.uint8, n, offset=9).astype(np.int64)
    k = (len(blob) - 9 - n) // 12
    at = np.frombuffer(blob, np.uint32, k, offset=9 + n)
    out[at] = np.frombuffer(blob[9 + n + 4 * k :], np.uint64, k).astype(np.int64)
    return out


def _pack(sorted_keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences, compressed."""
    import zstandard

    deltas = np.diff(sorted_keys, prepend=np.uint64(0))
    # byte planes compress far better than whole integers: the high planes are nearly constant
    planes = deltas.view(np.uint8).reshape(-1, 8).T.copy().tobytes()
    return len(deltas).to_bytes(8, "little") + zstandard.compress(planes, 3)


def _unpack(blob: bytes) -> np.ndarray:
    import zstandard

    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(zstandard.decompress(blob[8:], max_output_size=8 * n), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _requests(keyed: tuple[np.ndarray, ...], first: np.ndarray, train: np.ndarray, bits: int) -> Iterator[tuple[str, int, bytes, bytes]]:
    """(order, range, keys, training counts) of one block: every different n-gram it holds."""
    for kind, values in zip(ORDERS, keyed):
        use = ~first if kind == "t" else np.ones(len(values), bool)
        keys, at = np.unique(values[use], return_inverse=True)
        counts = np.bincount(at[train[use]], minlength=len(keys))
        part = (keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
        for r in range(1 << bits):
            a, b = cuts[r], cuts[r + 1]
            if a < b:
                yield kind, r, _pack(keys[a:b]), _squeeze(_narrow(counts[a:b]))


def _merge(table: pa.Table) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """For one order and range: all blocks' counts added up, answered to each block in its own order; and all counts."""
    runs = [_unpack(k) for k in table.column("keys").to_pylist()]
    counts = [_wide(_unsqueeze(c)) for c in table.column("counts").to_pylist()]
    keys, at = np.unique(np.concatenate(runs), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
    edges = np.cumsum([0, *map(len, runs)])
    answers = [(block, _squeeze(_narrow(total[at[edges[i] : edges[i + 1]]]))) for i, block in enumerate(table.column("block").to_pylist())]
    return answers, total


def _squeeze(blob: bytes) -> bytes:
    import zstandard

    return zstandard.compress(blob, 1)


def _unsqueeze(blob: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(blob)


def histogram(counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, how many, sum) of positive counts: 1, 2, then powers of two."""
    counts = counts[counts > 0]
    bucket = np.where(counts < 3, counts, np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 2)
    kinds, at = np.unique(bucket, return_inverse=True)
    n, s = np.bincount(at, minlength=len(kinds)), np.bincount(at, weights=counts, minlength=len(kinds))
    return [(int(k), int(x), int(y)) for k, x, y in zip(kinds, n, s)]


def backoff(order: dict[int, tuple[int, int]], histories: dict[int, tuple[int, int]]) -> tuple[float, float]:
    """(d, a - 1) of b(c) = d c^(a - 1), from the histograms of an order's counts and of its histories'."""
    n1, n2 = order.get(1, (0, 0))[0], order.get(2, (0, 0))[0]
    d = min(max(n1 / max(1, n1 + 2 * n2), 0.05), 0.95)
    types = sum(n for n, _ in order.values())
    lo, hi = 0.0, 1.0
    for _ in range(40):
        a = (lo + hi) / 2
        lo, hi = (a, hi) if sum(n * (s / n) ** a for n, s in histories.values()) < types else (lo, a)
    return d, (lo + hi) / 2 - 1


class Automaton:
    """States and arcs that one block can reach.

    States: 0 the root, then the block's words, then its pairs; ``words`` and ``pairs`` are the
    last numbers of the first two. Arcs: 0 the root's arc for unseen words, then one for each of the
    block's words, pairs and triples. States and arcs of n-grams that training has not seen
    have no arc to them: ``source`` is -1.
    """

    def __init__(self, counts: list[np.ndarray], sources: list[np.ndarray], lower: list[np.ndarray], n: int, v: int, weights: tuple[tuple[float, float], ...]):
        """``counts`` of the block's words, pairs and triples; of its pairs and triples the n-gram
        they start with (``sources``) and end with (``lower``), as numbers within the lower order.
        """
        sizes = [len(c) for c in counts]
        self.words, self.pairs = sizes[0], sizes[0] + sizes[1]
        base = [1, 1 + sizes[0], 1 + self.pairs]  # first arc of each order; also first state of words and pairs
        total = 1 + sum(sizes)
        self.base = base
        self.source = np.full(total, -1, np.int32)
        self.target = np.zeros(total, np.int32)
        self.weight = np.zeros(total)
        self.fail_to = np.zeros(1 + self.pairs, np.int32)
        self.fail_weight = np.zeros(1 + self.pairs)
        # the root's arcs
        self.weight[0] = math.log10(0.5) - math.log10(n + 0.5 * (v + 1))
        self.weight[1 : base[1]] = np.log10(counts[0] + 0.5) - math.log10(n + 0.5 * (v + 1))
        seen = np.flatnonzero(counts[0])
        self.source[1 + seen], self.target[1 + seen] = 0, 1 + seen
        for k in (0, 1):  # arcs of word states, then of pair states
            d, power = weights[k]
            states = np.maximum(counts[k], 1).astype(float)
            lose = d * states**power
            self.fail_weight[base[k] : base[k] + sizes[k]] = np.log10(lose)
            if k:
                self.fail_to[base[1] :] = base[0] + lower[0]
            i = np.flatnonzero(counts[k + 1])
            at, below = sources[k][i], self.weight[base[k] + lower[k][i]]
            self.source[base[k + 1] + i] = base[k] + at
            self.target[base[k + 1] + i] = base[1] + (i if k == 0 else lower[1][i])
            self.weight[base[k + 1] + i] = np.log10((1 - lose[at]) * counts[k + 1][i] / states[at] + lose[at] * 10.0**below)

    def walk(self, grams: list[np.ndarray], first: np.ndarray, size: np.ndarray, begin: int, piece: int = PIECE) -> np.ndarray:
        """log10 probability of each text. ``grams``: at each token the number of its word, pair and
        triple (the last -1 at a text's first); texts are ``size`` tokens from ``first``; ``begin`` is the state they start in.
        """
        many = -(-size // piece)
        text = np.repeat(np.arange(len(size)), many)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        early = np.where(turn > 0, 2, 0)
        at = first[text] + turn * piece - early
        steps = np.minimum(piece, size[text] - turn * piece) + early
        order = np.argsort(-steps, kind="stable")  # the pieces that still walk are the first ones
        text, at, steps, early = text[order], at[order], steps[order], early[order]
        state = np.where(early > 0, 0, begin).astype(np.int32)
        score = np.zeros(len(text))
        live = np.searchsorted(-steps, -np.arange(int(steps.max(initial=0))), side="left")
        for t, m in enumerate(live):
            s, here, gained = state[:m], at[:m] + t, np.zeros(m)
            arc = np.zeros(m, np.int32)
            for k, least in ((2, self.words), (1, 0)):
                number = grams[k][here]
                try_arc = np.where(number < 0, 0, self.base[k] + number)
                has = (s > least) & (self.source[try_arc] == s)
                arc[has] = try_arc[has]
                stuck = (s > least) & ~has & (arc == 0)
                gained[stuck] += self.fail_weight[s[stuck]]
                s = np.where(stuck, self.fail_to[s], s)
            free = np.flatnonzero(arc == 0)  # at the root; its arc for unseen words is number 0
            word = self.base[0] + grams[0][here[free]]
            arc[free] = np.where(self.source[word] == 0, word, 0)
            gained += self.weight[arc]
            score[:m] += np.where(t < early[:m], 0.0, gained)
            state[:m] = self.target[arc]
        return np.bincount(text, weights=score, minlength=len(size))


def _blocks(documents: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    """(block, ids, train, packed): runs of a task's rows of about ``block_bytes`` of text as one row each, written down."""
    kind = documents.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        packer = zstandard.ZstdCompressor(level=9)
        first, number, parts, held = TaskContext.get().partitionId() << 32, 0, [], 0

        def row():
            ids, train, texts = (pa.concat_arrays([p[k] for p in parts]) for k in range(3))
            sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
            body = packer.compress(sizes.tobytes() + b"".join(texts.to_pylist()))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([pa.array([first + number], pa.int64()), one(ids), one(train), pa.array([body], pa.binary())], ["block", "ids", "train", "packed"])

        for batch in batches:
            texts = batch.column(2).cast(pa.large_string()).fill_null("").cast(pa.large_binary())
            ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            a = 0
            while a < batch.num_rows:
                start = int(ends[a - 1]) if a else 0
                b = min(batch.num_rows, max(a + 1, int(np.searchsorted(ends, start + block_bytes - held))))
                parts.append((batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), texts.slice(a, b - a)))
                held += int(ends[b - 1]) - start
                a = b
                if held >= block_bytes or sum(len(p[0]) for p in parts) >= MAX_ROWS:
                    yield row()
                    parts, held, number = [], 0, number + 1
        if parts:
            yield row()

    rows = documents.select(F.col(key).alias("_id"), (remainder(F.col(key)) != HELD).alias("_train"), F.col(text).alias("_text"))
    return materialise(rows.mapInArrow(pack, f"block bigint, ids array<{kind}>, train array<boolean>, packed binary"), "lm-blocks")


def _unpacked(packed: bytes, rows: int) -> pa.Array:
    """The texts of a block."""
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(packed)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(body, np.int64, rows))])
    return pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body).slice(8 * rows)])


def score_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    blocks = _blocks(documents, key, text, block_bytes)
    bits = range_bits(blocks.count())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                train = batch.column(1)[i].values.to_numpy(zero_copy_only=False).astype(bool)
                tokens, row = text_tokens(_unpacked(batch.column(2)[i].as_py(), len(train)))
                first, *keyed = grams(tokens, row)
                for kind, r, keys, counts in _requests(keyed, first, train[row], bits):
                    arrays = [batch.column(0).slice(i, 1), pa.array([kind]), pa.array([r], pa.int32()), pa.array([keys], pa.binary()), pa.array([counts], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["block", "kind", "range", "keys", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        got, total = _merge(table)
        found = histogram(total)
        pad = [None] * len(found)
        return pa.table(
            {
                "block": pa.array([b for b, _ in got] + pad, pa.int64()),
                "kind": pa.array([table.column("kind")[0].as_py()] * (len(got) + len(found))),
                "range": pa.array([table.column("range")[0].as_py()] * (len(got) + len(found)), pa.int32()),
                "counts": pa.array([c for _, c in got] + pad, pa.binary()),
                "bucket": pa.array([None] * len(got) + [x[0] for x in found], pa.int32()),
                "n": pa.array([None] * len(got) + [x[1] for x in found], pa.int64()),
                "s": pa.array([None] * len(got) + [x[2] for x in found], pa.int64()),
            }
        )

    requests = blocks.select("block", "train", "packed").mapInArrow(ask, "block bigint, kind string, range int, keys binary, counts binary")
    answers = requests.groupBy("kind", "range").applyInArrow(merge, "block bigint, kind string, range int, counts binary, bucket int, n bigint, s bigint")
    answers = materialise(answers, "lm-answers")
    table: dict[str, dict[int, tuple[int, int]]] = {kind: {} for kind in ORDERS}
    for r in answers.filter("block is null").groupBy("kind", "bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        table[r.kind][r.bucket] = (r.n, r.s)  # at most some sixty rows an order
    n_train, n_types = sum(s for _, s in table["w"].values()), sum(n for n, _ in table["w"].values())
    weights = (backoff(table["p"], table["w"]), backoff(table["t"], table["p"]))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, train = (left.column(c).combine_chunks().values for c in ("ids", "train"))
        rows = len(ids)
        tokens, row = text_tokens(_unpacked(left.column("packed")[0].as_py(), rows))
        replies = sorted(zip(right.column("kind").to_pylist(), right.column("range").to_pylist(), right.column("counts").to_pylist()), key=lambda x: x[:2])
        first, *keyed = grams(tokens, row)
        sizes = np.bincount(row, minlength=rows).astype(np.int64)
        begins = np.flatnonzero(first)
        ends = tokens == END
        del tokens
        numbers, counts, sources, lower = [], [], [], []
        while keyed:  # one order at a time, its keys freed before the next
            kind, values = ORDERS[len(counts)], keyed.pop(0)
            use = np.flatnonzero(~first) if kind == "t" else np.arange(len(values))
            keys, where, at = np.unique(values[use], return_index=True, return_inverse=True)
            corpus = np.concatenate([_wide(_unsqueeze(c)) for k, _, c in replies if k == kind]) if len(keys) else np.zeros(0, np.int64)
            number = np.full(len(values), -1, np.int32)
            number[use] = at
            if numbers:  # the n-gram's last token stands at ``where``; what it starts with ends one token earlier
                where = use[where]
                lower.append(numbers[-1][where])
                before = numbers[-1][where - 1]
                sources.append(np.where(first[where], numbers[0][np.argmax(ends)], before) if kind == "p" else before)
            numbers.append(number)
            counts.append(corpus)
            del values, keys, where, at, use
        # every training text starts after one END, so END's count as a state is its count as a token
        begin = int(numbers[0][np.argmax(ends)]) if rows else 0
        begin = 1 + begin if rows and counts[0][begin] else 0
        machine = Automaton(counts, sources, lower, n_train, n_types, weights)
        root = machine.weight[1 + numbers[0]]
        known = counts[0][numbers[0]] > 0
        total = lambda x: np.bincount(row, weights=x, minlength=rows)
        return pa.table(
            {
                "_id": ids,
                "held_out": pa.array(~train.to_numpy(zero_copy_only=False).astype(bool)),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(total(known).astype(np.int64)),
                "base_score": pa.array(total(root)),
                "score": pa.array(machine.walk(numbers, begins, sizes, begin)),
            }
        )

    kind = documents.schema[key].dataType.simpleString()
    schema = f"_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    scored = blocks.groupBy("block").cogroup(answers.filter("block is not null").select("block", "kind", "range", "counts").groupBy("block")).applyInArrow(score, schema)
    return scored.select(
        F.col("_id").alias(key), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
