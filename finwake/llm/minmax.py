"""Near-duplicates by min-max hashing: Jaccard similarity of word shingles, links confirmed on full sets.

1. Sketch: each of ``PERMUTATIONS`` hash functions runs once over a text's shingles and leaves
   both its minimum and its maximum, so 64 evaluations a shingle give 128 values. Two texts agree
   in each value with a probability equal to their similarity (the estimate stays unbiased,
   and the pairs of values vary less than independent ones).
2. Bands: two functions' four values make one of 32 keys. Texts of similarity s share a key
   with probability 1 - (1 - s^4)^32: all but 5 in 10^8 of the pairs at 0.8 do.
3. Equal sets are one node, found by a 128-bit hash of the set, so copies never meet.
4. Nearest: in cells of at most ``GROUP`` members (a larger bucket is dealt evenly) the equal
   share of all 128 values is compared, and each member's ``NEAREST`` nearest of all its cells
   are verified on the full sets. Components follow from verified links.
5. Rest: a bucket that holds more than one component is looked at again, as one cell; only a
   bucket of over ``CELL_MEMBERS`` members or ``CELL_SHINGLES`` shingles is dealt into parts, and
   every two parts that hold different components make a cell, so all its pairs meet. A pair of different
   components whose values allow the similarity (within ``SLACK``, five standard deviations)
   is verified, unless it was before or its members are connected by then, and in one of the
   buckets that it shares, chosen by its hash. Such pairs travel one by one, or as one cell,
   to which its members bring their sets once, where a cell has many.

So work is linear in the number of members, however large a family of copies is; only in a bucket
of very many members outside its largest component all their pairs are compared. What may be
missed is a pair that shares no key (5 in 10^8) or whose estimate lies five deviations off; the
tests measure recall against all pairs.

Words are either maximal runs of other than white space, with A-Z lower-cased ("space"), or
runs of letters, marks and digits of any script in lower case ("unicode"). A text of fewer words
than a shingle is one shingle; texts without words, null or empty, are linked with nothing.
Words are 64-bit hashes (XXH64) and shingles combine them; sets are compared by these.
Repeated ids are decided row by row; a null id is the smallest of its component only if all are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finwake.llm import textops as X
from finwake.llm.simhash import components
from finwake.llm.store import materialise, runs_of

PERCENT = 80
PERMUTATIONS, BANDS = 64, 32
VALUES = 2 * PERMUTATIONS
WIDTH = VALUES // BANDS
NEAREST = 4
GROUP = 256
SLACK = 18  # percent
SMALL = 8  # cells up to this size are compared in bulk
CELL_MEMBERS, CELL_SHINGLES = 1 << 12, 1 << 20
PIECE = 1 << 20
_ODD = X.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)
_FLIP = X.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).astype(np.uint32)
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


# ------------------------------------------------------------------ words, shingles, sketches
class _Words(dict):
    """XXH64 of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 19:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def pieces(text: bytes, limit: int = PIECE) -> Iterator[bytes]:
    """``text`` in pieces of about ``limit`` bytes, cut at white space."""
    at = 0
    while len(text) - at > limit:
        cut = _BLANK.search(text, at + limit)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(column: pa.Array, words: str) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order) of every text that has words."""
    known = _Words()
    texts = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for r in range(len(texts)):
        text = texts[r].as_py()
        if not text:
            continue
        found = []
        for piece in pieces(text):
            if words == "space":
                found.append(np.fromiter(map(known.__getitem__, piece.lower().split()), np.uint64))
            else:
                data = np.frombuffer(piece, np.uint8)
                start, end, _ = X.unicode_words(data, np.array([0, len(data)]))
                found.append(X.word_hashes(data, start, end))
        h = np.concatenate(found)
        if len(h):
            yield r, h


def shingle_set(h: np.ndarray, size: int) -> np.ndarray:
    """The sorted different shingles of a text's word hashes."""
    k = min(size, len(h))
    s = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        s = X.mix(s * np.uint64(31) + h[j : len(h) - k + 1 + j])
    return np.unique(s)


def extremes(s: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each hash function over the shingles ``s``, side by side."""
    high = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(PERMUTATIONS, np.iinfo(np.uint32).max, np.uint32)
    most = np.zeros(PERMUTATIONS, np.uint32)
    for lo in range(0, len(s), 256):
        values = (high[lo : lo + 256, None] ^ _FLIP) * _ODD
        np.minimum(least, values.min(axis=0), out=least)
        np.maximum(most, values.max(axis=0), out=most)
    return np.stack([least, most], axis=1).ravel()


def sketches(documents: DataFrame, key: str, text: str, size: int, words: str) -> DataFrame:
    """(_id, n, same, sign, keys) of every row: shingles, a hash of the set (null: no words), one byte of each value, band keys."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, same, at, values = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [], []
            for r, h in word_hashes(batch.column(1), words):
                s = shingle_set(h, size)
                n[r], same[r] = len(s), xxhash.xxh3_128_digest(s.tobytes())
                at.append(r), values.append(extremes(s))
            m = np.array(values, np.uint64).reshape(-1, VALUES)
            keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(m), BANDS))
            for j in range(WIDTH):
                keys = X.mix(keys * np.uint64(31) + m.reshape(len(m), BANDS, WIDTH)[:, :, j])
            sign = (X.mix(m) >> np.uint64(56)).astype(np.uint8)
            signs, lists = [None] * batch.num_rows, [None] * batch.num_rows
            for i, r in enumerate(at):
                signs[r], lists[r] = sign[i].tobytes(), keys[i].view(np.int64)
            columns = [batch.column(0), pa.array(n), pa.array(same, pa.binary()), pa.array(signs, pa.binary()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n", "same", "sign", "keys"])

    column = F.lower(text) if words == "unicode" else F.col(text)
    return documents.select(F.col(key).alias("_id"), column.alias("_text")).mapInArrow(run, f"_id {kind}, n bigint, same binary, sign binary, keys array<bigint>")


def shingle_sets(documents: DataFrame, text: str, size: int, words: str) -> DataFrame:
    """(same, _set): the hash of each text's set and its packed sorted shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = [shingle_set(h, size).tobytes() for _, h in word_hashes(batch.column(0), words)]
            same = [xxhash.xxh3_128_digest(x) for x in value]
            yield pa.RecordBatch.from_arrays([pa.array(same, pa.binary()), pa.array(value, pa.binary())], ["same", "_set"])

    column = F.lower(text) if words == "unicode" else F.col(text)
    return documents.select(column.alias("_text")).mapInArrow(run, "same binary, _set binary")


# ------------------------------------------------------------------ cells
def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Share of equal values in percent, -1 where two cannot be similar; broadcasts over members."""
    equal = (x == y).sum(axis=-1, dtype=np.int16) * np.float32(100 / x.shape[-1])
    return np.where((equal < percent - SLACK) | (100 * np.minimum(n, m) < percent * np.maximum(n, m)), -1, equal)


class Cells:
    """The members of complete cells, sorted by cell, with what their comparison needs."""

    def __init__(self, table: pa.Table, percent: int):
        column = lambda name: table.column(name).combine_chunks()
        self.at, self.n, self.percent = column("at").to_numpy(), column("n").to_numpy(), percent
        self.same, self.sign = table.column("same").to_pylist(), _matrix(column("sign"))
        cuts = np.flatnonzero(np.diff(self.at)) + 1
        self.starts, self.ends = np.r_[0, cuts], np.r_[cuts, len(self.at)]
        self.root = self.keys = None
        if "root" in table.column_names:
            self.root = column("root").dictionary_encode().indices.to_numpy()
            self.keys = column("keys").flatten().to_numpy().reshape(-1, BANDS)
            self.whole = column("whole").to_numpy(zero_copy_only=False)

    def _kept(self, i: np.ndarray, j: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of different components where these are known, and only in the bucket that the pair's hash picks."""
        if self.root is None:
            return i, j, e
        keep = self.root[i] != self.root[j]
        i, j, e = i[keep], j[keep], e[keep]
        whole = np.flatnonzero(self.whole[i])
        x, y = self.keys[i[whole]], self.keys[j[whole]]
        draw = X.mix((x ^ (x[:, :1] + y[:, :1])).view(np.uint64)) | np.uint64(1)
        pick = np.where(x == y, draw, 0).argmax(axis=1)
        mine = np.ones(len(i), bool)
        mine[whole] = x[np.arange(len(x)), pick] == self.at[i[whole]]
        return i[mine], j[mine], e[mine]

    def small(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, share of equal values) of the possible pairs i < j of all small cells, offset by offset."""
        size = self.ends - self.starts
        long, found = np.repeat(size, size) > SMALL, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for o in range(1, SMALL):
            i = np.flatnonzero((self.at[:-o] == self.at[o:]) & ~long[:-o])
            e = possible(self.sign[i], self.sign[i + o], self.n[i], self.n[i + o], self.percent)
            found.append(self._kept(i[e >= 0], i[e >= 0] + o, e[e >= 0]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def large(self) -> Iterator[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The same for each larger cell, in blocks of rows."""
        for c in np.flatnonzero(self.ends - self.starts > SMALL).tolist():
            yield self._blocks(int(self.starts[c]), int(self.ends[c]))

    def _blocks(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        step = max(1, (1 << 18) // (hi - lo))
        for a in range(lo, hi, step):
            b = min(hi, a + step)
            e = possible(self.sign[a:b, None], self.sign[None, a:hi], self.n[a:b, None], self.n[None, a:hi], self.percent)
            e[np.arange(a, hi)[None] <= np.arange(a, b)[:, None]] = -1
            i, j = np.nonzero(e >= 0)
            yield self._kept(i + a, j + a, e[i, j])


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of complete cells, from batches sorted by ``at``."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        at = table.column("at").to_numpy()
        cut = int(np.searchsorted(at, at[-1])) if len(at) else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def pair_name(a: bytes, b: bytes) -> int:
    return xxhash.xxh64_intdigest(min(a, b) + max(a, b), 42) - (1 << 63)


def nearest_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(at, a, b) with a < b: each member's nearest others in all its cells; ``at`` names the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            cells = Cells(table, percent)
            same = cells.same
            found = [cells.small(), *[block for cell in cells.large() for block in cell]]
            i, j, e = (np.concatenate(x) for x in zip(*found))
            if not len(i):
                continue
            i, j, e = np.r_[i, j], np.r_[j, i], np.r_[e, e]
            order = np.lexsort((j, -e, i))
            i, j, e = i[order], j[order], e[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            nth = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
            i, j, e = i[nth < NEAREST], j[nth < NEAREST], e[nth < NEAREST]
            take = lambda x: pa.array([same[k] for k in x.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([take(i), take(j), pa.array(e)], ["x", "y", "e"])

    dealt = members.select("at", "same", "n", "sign").repartition("at").sortWithinPartitions("at")
    near = dealt.mapInArrow(run, "x binary, y binary, e float").distinct()
    # at most NEAREST a cell were kept, so these lists are short
    best = near.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("e", "y")), False), 1, NEAREST).alias("best"))
    pairs = best.select("x", F.explode("best.y").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [pair_name(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *batch.columns], ["at", "a", "b"])

    return pairs.mapInArrow(name, "at bigint, a binary, b binary")


def are_similar(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two packed shingle sets have this Jaccard similarity."""
    s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [are_similar(x, y, percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    for side in "ab":
        pairs = pairs.join(sets.select(F.col("same").alias(side), F.col("_set").alias(f"{side}_set")), side)
    return pairs.select("a", "b", "a_set", "b_set").mapInArrow(run, "a binary, b binary")


def _chunks(members: DataFrame, size: F.Column) -> F.Column:
    """``at``, or one of the even parts of a cell that is too large."""
    return F.when(size <= GROUP, F.col("at")).otherwise(F.xxhash64("at", F.pmod(F.xxhash64("same", "at"), F.ceil(size / GROUP))))


def _parts_if(flag: F.Column) -> F.Column:
    """The number of parts for the members of a bucket with ``flag``."""
    m, w = F.count_if(flag), F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0))
    return F.greatest(F.ceil(m / (CELL_MEMBERS // 2)), F.least(F.ceil(w / (CELL_SHINGLES // 2)), F.ceil(m / (GROUP // 2)))).cast("bigint")


def split_cells(places: DataFrame, named: DataFrame) -> DataFrame:
    """(at, same, whole) with cells of bounded size in which all pairs of different components of a bucket meet.

    A bucket that is too large is dealt into parts, and every pair of parts becomes a cell. Members
    of the bucket's largest component are dealt apart: two parts of it need not meet.
    """
    fits = (F.col("m") <= CELL_MEMBERS) & ((F.col("w") <= CELL_SHINGLES) | (F.col("m") <= GROUP))
    done, cells = places.filter(fits).select("at", "same", F.lit(True).alias("whole")), places.filter(~fits)
    if cells.isEmpty():
        return done
    cells = cells.join(named.select("same", "n", "root"), "same")
    sizes = cells.groupBy("at", "root").agg(F.count("*").alias("c"))
    most = sizes.groupBy("at").agg(F.max(F.struct("c", "root"))["root"].alias("_most"))
    cells = cells.join(most, "at").withColumn("_main", F.col("root") == F.col("_most"))
    counted = cells.groupBy("at").agg(*[_parts_if(flag).alias(name) for flag, name in ((F.col("_main"), "_pm"), (~F.col("_main"), "_po"))])
    cells = cells.join(counted, "at")
    # parts of the others are 0 to _po - 1, those of the largest component follow
    mine = F.when(F.col("_main"), F.col("_po") + F.pmod(F.xxhash64("same"), F.col("_pm"))).otherwise(F.pmod(F.xxhash64("same"), F.col("_po")))
    last = F.when(F.col("_main"), F.col("_po") - 1).otherwise(F.col("_po") + F.col("_pm") - 1)
    met = cells.withColumn("_part", mine).select("at", "same", "_part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_other"))
    cell = F.xxhash64("at", F.least("_part", "_other"), F.greatest("_part", "_other"))
    return done.unionByName(met.select(cell.alias("at"), "same", F.lit(False).alias("whole")))


def open_cells(members: DataFrame, percent: int) -> DataFrame:
    """(at, same, whole): members of possible pairs of different components, by pair, or by cell where a cell has many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            cells = Cells(table, percent)
            same, at, who, whole = cells.same, [], [], []

            def as_pairs(i: np.ndarray, j: np.ndarray) -> None:
                for a, b in zip(i.tolist(), j.tolist()):
                    at.extend([pair_name(same[a], same[b])] * 2)
                    who.extend((same[a], same[b]))
                    whole.extend((False, False))

            as_pairs(*cells.small()[:2])
            for cell in cells.large():
                few, count, involved = [], 0, np.zeros(len(same), bool)
                for i, j, _ in cell:
                    count += len(i)
                    involved[i] = involved[j] = True
                    few.append((i, j))
                    heavy = cells.n[involved].sum() > 2 * CELL_SHINGLES
                    if not heavy and count > 2 * involved.sum():
                        few = []
                    elif heavy:  # such texts travel by pairs, block by block
                        for x in few:
                            as_pairs(*x)
                        few, count = [], 0
                k = np.flatnonzero(involved)
                if count > 2 * len(k):
                    at.extend(cells.at[k].tolist()), who.extend(same[x] for x in k.tolist()), whole.extend(cells.whole[k].tolist())
                else:
                    for x in few:
                        as_pairs(*x)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(who, pa.binary()), pa.array(whole, pa.bool_())], ["at", "same", "whole"])

    dealt = members.select("at", "same", "whole", "n", "sign", "keys", "root").repartition("at").sortWithinPartitions("at")
    return dealt.mapInArrow(run, "at bigint, same binary, whole boolean").distinct()


def connecting_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): similar pairs that connect the components of a cell; pairs connected by then are not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, "at"):
            cells, packed = Cells(table, percent), table.column("_set").to_pylist()
            sets: dict[int, frozenset] = {}
            up = list(range(int(cells.root.max()) + 1))

            def top(x: int) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            def of(k: int) -> frozenset:
                if k not in sets:
                    sets[k] = frozenset(np.frombuffer(packed[k], np.uint64).tolist())
                return sets[k]

            found = []
            for block in [cells.small()] if len(cells.at) <= SMALL else next(cells.large()):
                for i, j in zip(block[0].tolist(), block[1].tolist()):
                    a, b = top(int(cells.root[i])), top(int(cells.root[j]))
                    if a == b:
                        continue
                    both = len(of(i) & of(j))
                    if 100 * both >= percent * (len(of(i)) + len(of(j)) - both):
                        up[b] = a
                        found.append((i, j))
            yield pa.RecordBatch.from_arrays([pa.array([cells.same[p[k]] for p in found], pa.binary()) for k in (0, 1)], ["x", "y"])

    dealt = members.select("at", "same", "whole", "n", "sign", "keys", "root", "_set").repartition("at").sortWithinPartitions("at")
    return dealt.mapInArrow(run, "x binary, y binary").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


# ------------------------------------------------------------------ the operator
def similar_groups(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2, percent: int = PERCENT, words: str = "space") -> DataFrame:
    """One row per input row: key, n_shingles, component_id (smallest id reachable, itself included)."""
    rows = materialise(sketches(documents, key, text, size, words), "minmax-rows")
    nodes = rows.filter("same is not null").groupBy("same").agg(F.first("n").alias("n"), F.first("sign").alias("sign"), F.first("keys").alias("keys"))
    nodes = materialise(nodes, "minmax-nodes")
    placed = nodes.select(F.explode("keys").alias("at"), "same", "n")
    shared = placed.groupBy("at").agg(F.count("*").alias("m"), F.sum("n").alias("w")).filter("m > 1")
    places = materialise(placed.join(shared, "at").select("at", "same", "m", "w"), "minmax-places")

    even = places.select(_chunks(places, F.col("m")).alias("at"), "same")
    pairs = materialise(nearest_pairs(even.join(nodes.select("same", "n", "sign"), "same"), percent), "minmax-pairs")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Sets of ``wanted`` from the texts of one id each; where ids repeat some others come along."""
        one = rows.join(wanted, "same", "left_semi").groupBy("same").agg(F.min("_id").alias("_least")).select("_least").distinct()
        texts = documents.select(F.col(key).alias("_id"), F.col(text).alias("_body"))
        texts = texts.join(one, F.col("_id").eqNullSafe(F.col("_least")), "left_semi")
        return materialise(shingle_sets(texts, "_body", size, words), "minmax-sets")

    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("same")).distinct())
    roots = components(verified(pairs, sets, percent), "minmax-groups")
    named = nodes.select("same", "n", "sign").join(roots, F.col("same") == F.col("node"), "left").select("same", "n", "sign", F.coalesce("root", "same").alias("root"))
    named = materialise(named, "minmax-named")

    mixed = places.join(named.select("same", "root"), "same").groupBy("at").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("at")
    cells = split_cells(places.join(mixed, "at", "left_semi"), named)
    facts = named.join(nodes.select("same", "keys"), "same")
    left = open_cells(cells.join(facts, "same"), percent).join(pairs.select("at"), "at", "left_anti")
    left = materialise(left, "minmax-open")
    if not left.isEmpty():
        sets = sets_of(left.select("same").distinct())
        links = connecting_links(left.join(sets, "same").join(facts, "same"), percent)
        links = materialise(links, "minmax-links")
        if not links.isEmpty():
            roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(links), "minmax-groups")

    labels = rows.filter("same is not null").groupBy("same").agg(F.min("_id").alias("least"))
    labels = labels.join(roots, F.col("same") == F.col("node"), "left").select("same", F.coalesce("root", "same").alias("root"), "least")
    smallest = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = labels.join(smallest, "root").select("same", "component_id")
    out = rows.select("_id", "n", "same").join(labels, "same", "left")
    return out.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("same").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def digest(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    return similar_groups(documents).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = """WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM docs),
flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (
  SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT r.doc_id, CAST(len(any_value(s)) AS BIGINT) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r JOIN sets USING (doc_id) GROUP BY r.doc_id"""
