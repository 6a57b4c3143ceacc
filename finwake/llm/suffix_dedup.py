"""Removal of repeated 200-byte strings by a range-partitioned suffix array.

A byte goes if some 200-byte string that covers it also starts anywhere else in the
corpus. A suffix array decides this by sorting all suffixes and comparing neighbours on
their first 200 bytes. Sorting every suffix would ship 200 bytes for each byte of text,
so neighbouring starts are sorted as one long suffix first, in levels of one shape:

- A run of neighbouring starts has a core (bytes that all its 200-byte strings share) and
  a union (all bytes they cover). If its core occurs nowhere else, no string of the run is
  repeated: the run is dropped. If its union occurs elsewhere, all its strings are
  repeated: its span is removed, and one run stands for all equal ones. Only runs whose
  core is repeated and which meet different unions go to the next level.
- Level 1 takes runs whose 200-byte strings have the same anchor (the leftmost 64-byte
  string of least hash, so content alone decides it); the anchor is the core.
- Level 2 cuts the runs that are left, one of each union, into runs of ``BLOCKS`` starts.
- Level 3 takes single starts: the union is the 200-byte string itself.

At each level the unions are sorted as suffixes: sampled splitters range-partition them by
their leading bytes, each bucket is sorted by multikey quicksort on 8-byte words, and
neighbours are compared on all bytes. A run of equal leading bytes that is split over
several buckets is dealt by its whole content, so equal strings never face each other
across a bucket boundary and each boundary needs no comparison but this rule.

Hashes (64 bits of cores, 64 of unions) only leave out what cannot be equal: a run goes to the
sort if both are met again. What is removed was compared byte by byte, in the sort or, for
copies within one batch of a task, there. Each task settles its own copies and ships one run
for them, so a hot passage sends one row a batch; unions that still have over ``HOT`` rows
are sorted in salted parts, and one row of each part once more. Buckets follow the number of
rows. Joins on hot cores are equi-joins that adaptive execution may split. Texts travel
twice, compressed.

Edge cases: null is empty; texts under 200 bytes lose nothing; matches never cross rows;
rows with repeated or null ids are separate documents (a surrogate id is written first);
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finwake.llm import textops as X
from finwake.llm.store import materialise

LENGTH = 200  # a string of so many bytes counts as repeated
GRAM = 64  # leading bytes of an anchored suffix
BLOCKS = (8,)  # starts in a run, from level 2 on
PIECE = 2 << 20  # longer texts are scanned in pieces that overlap by one string
UNION = 2  # seed of the union hashes; cores have seed 1
SAMPLE = 20_000  # about so many suffixes are drawn for the splitters, more for over 1,000 buckets
BUCKET = 32 << 20  # bytes of the sorted strings of a bucket
HOT = 2048  # a union of more rows is sorted in parts of about so many
RUN_SCHEMA = "kind int, rid bigint, start bigint, count int, base bigint, origin bigint, core bigint, whole bigint, n int"


def gram_hashes(sums: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of data[p : p + size] for every p where it fits."""
    n = len(sums) - size
    _, q = X.powers(seed, max(1, len(sums)))
    return X.mix((sums[size:] - sums[:n]) * q[:n] + np.uint64(size))


def sliding_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """min(v[i : i + width]) for every i, by doubling."""
    have, m = 1, v
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Runs of window starts that share an anchor: (row, first start, last start, anchor, gram hash, union hash).

    The anchor of a window is its leftmost ``GRAM``-byte string of least hash, so it depends on
    the window's content alone: equal windows have equal anchors at equal distances.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < LENGTH:
        return none
    sums = X.prefix_sums(data)
    h = gram_hashes(sums, GRAM)
    order = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    least = sliding_minimum(order, LENGTH - GRAM + 1) & np.uint64((1 << 24) - 1)
    n_windows = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    valid = np.zeros(len(least) + 1, np.int32)
    has = n_windows > 0
    np.add.at(valid, offsets[:-1][has], 1)
    np.add.at(valid, offsets[:-1][has] + n_windows[has], -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[offsets[:-1][has]] = True
    new[1:] |= ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = np.zeros(len(least), bool)
    stop[:-1] = new[1:] | ~valid[1:]
    stop[-1] = True
    last = np.flatnonzero(stop & valid)
    at = least[first].astype(np.int64)
    union = X.span_hashes(X.prefix_sums(data, UNION), first, last + LENGTH, UNION) ^ X.mix((at - first).astype(np.uint64))
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, first, last, at, h[at], union


def pieces(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each text, its offset in the row, bytes, offsets): slices, with very long texts cut into overlapping pieces."""
    for a, b, data, offsets in X.slices(column):
        if len(data) <= PIECE:
            yield np.arange(a, b), np.zeros(b - a, np.int64), data, offsets
            continue
        for r in range(b - a):
            text = data[offsets[r] : offsets[r + 1]]
            for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
                part = text[at : at + PIECE + LENGTH - 1]
                yield np.array([a + r]), np.array([at]), part, np.array([0, len(part)])


def _rows(kind, rid, start, count, base, origin, core, whole, n) -> pa.RecordBatch:
    k = len(rid)
    full = lambda x, t: pa.array(np.full(k, x) if np.isscalar(x) else x, t)
    arrays = [
        full(kind, pa.int32()),
        full(rid, pa.int64()),
        full(start, pa.int64()),
        full(count, pa.int32()),
        full(base, pa.int64()),
        full(origin, pa.int64()),
        pa.array(core.view(np.int64)),
        pa.array(whole.view(np.int64)),
        full(n, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["kind", "rid", "start", "count", "base", "origin", "core", "whole", "n"])


def merged_spans(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each row joined where they touch or overlap."""
    if not len(rid):
        return rid, start, end
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order], end[order]
    # a running maximum within each row: rows are lifted apart by more than any text is long
    _, number = np.unique(rid, return_inverse=True)
    lift = number.astype(np.int64) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (start[1:] + lift[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return rid[at], start[at], np.append(reach[at[1:] - 1], reach[-1]) - lift[at]


def equal_rows(key: np.ndarray, same: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(representatives, group size of every row) of rows with equal ``key`` that ``same(rows, others)`` confirms.

    A row that only shares the key of its group's first row stands alone.
    """
    _, first, at, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    many = np.flatnonzero(n[at] > 1)
    odd = many[~same(many, first[at[many]])]
    size = n[at]
    if len(odd):
        n = n - np.bincount(at[odd], minlength=len(n))
        size = n[at]
        size[odd] = 1
    return np.concatenate([first, odd]), size


def same_bytes(texts: list[np.ndarray], part: np.ndarray, at: np.ndarray, size: np.ndarray) -> Callable:
    """Whether the strings of rows i and j, ``size`` bytes of ``texts[part]`` from ``at``, are equal."""

    def body(i: int) -> bytes:
        return texts[part[i]][at[i] : at[i] + size[i]].tobytes()

    return lambda rows, others: np.fromiter((body(i) == body(j) for i, j in zip(rows.tolist(), others.tolist())), bool, len(rows))


def settle(same: Callable, rid, start, count, base, origin, core, whole) -> Iterator[pa.RecordBatch]:
    """Of the runs of one batch: spans of unions that repeat within it (kind 0), and one run of each union (kind 1).

    ``same`` compares the bytes of unions whose hashes agree.
    """
    if not len(rid):
        return
    key = X.mix(core * np.uint64(3) + whole)
    first, n = equal_rows(key, same)
    twice = n > 1
    if twice.any():
        r, s, e = merged_spans(rid[twice], start[twice], start[twice] + count[twice] - 1 + LENGTH)
        # a span needs no core; one that is spread evenly keeps the later join even
        spread = X.mix(r.astype(np.uint64) * np.uint64(7) + s.astype(np.uint64))
        yield _rows(0, r, s, e - s, 0, 0, spread, spread, 2)
    yield _rows(1, rid[first], start[first], count[first], base[first], origin[first], core[first], whole[first], np.minimum(n[first], 2))


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level 1: anchored runs of (rid, text) rows."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        parts, texts = [], []
        for rows, base, data, offsets in pieces(batch.column(1)):
            row, first, last, at, core, whole = anchors(data, offsets)
            if len(row):
                shift = base[row] - offsets[row]
                parts.append((ids[rows[row]], first + shift, last - first + 1, at + shift, core, whole, first, np.full(len(row), len(texts))))
                texts.append(data)
        if parts:
            rid, start, count, origin, core, whole, first, part = (np.concatenate(x) for x in zip(*parts))
            yield from settle(same_bytes(texts, part, first, count - 1 + LENGTH), rid, start, count, start, origin, core, whole)


def cut_runs(size: int) -> Callable:
    """Level 2: (rid, base, origin, body) rows, cut by the distance to the anchor into runs of ``size`` starts.

    The cuts and the core follow the anchor, not the run, so runs that begin elsewhere cut alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bases, origins = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            parts, texts = [], []
            for a, b, data, offsets in X.slices(batch.column(3)):
                windows = np.diff(offsets) - LENGTH + 1
                far = origins[a:b] - bases[a:b]  # distance of the first start, the largest
                near = far - windows + 1
                cuts = far // size - near // size + 1
                row = np.repeat(np.arange(b - a), cuts)
                k = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                block = (far // size)[row] - k
                most = np.minimum(block * size + size - 1, far[row])
                least = np.maximum(block * size, near[row])
                anchor = offsets[row] + far[row]
                sums = X.prefix_sums(data)
                core = X.span_hashes(sums, anchor - block * size, anchor - block * size - (size - 1) + LENGTH)
                whole = X.span_hashes(X.prefix_sums(data, UNION), anchor - most, anchor - least + LENGTH, UNION)
                start = (origins[a:b])[row] - most
                where = (anchor - most, np.full(len(row), len(texts)))
                parts.append((ids[a + row], start, most - least + 1, bases[a + row], origins[a + row], core, whole, *where))
                texts.append(data)
            if parts:
                *runs, at, part = (np.concatenate(x) for x in zip(*parts))
                yield from settle(same_bytes(texts, part, at, runs[2] - 1 + LENGTH), *runs)

    return run


def count_cores(scan: Callable) -> Callable:
    """The cores of a scan with how often each occurs in its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan(batches):
            runs = batch.filter(pa.array(batch.column(0).to_numpy() == 1))
            if not runs.num_rows:
                continue
            cores = np.repeat(runs.column(6).to_numpy(), runs.column(8).to_numpy())
            values, n = np.unique(cores, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.minimum(n, 2), pa.int32())], ["core", "seen"])

    return run


def one_level(source: DataFrame, scan: Callable, fetch: Callable, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(spans, open runs) of a level: spans are (rid, start, stop); open runs stand one for each union, with its bytes.

    ``fetch`` adds the bytes to runs; none has more than ``size``.
    """
    repeated = source.mapInArrow(count_cores(scan), "core bigint, seen int").groupBy("core").agg(F.sum("seen").alias("seen"))
    repeated = repeated.filter("seen > 1").select("core", F.lit(1).alias("hit"))
    runs = source.mapInArrow(scan, RUN_SCHEMA).join(repeated, "core", "left").filter("kind = 0 or hit is not null").drop("hit")
    runs = materialise(runs, f"suffix-{name}")
    live = runs.filter("kind = 1").drop("kind")
    unions = materialise(live.groupBy("core", "whole").agg(F.count("*").alias("met")), f"suffix-{name}-unions")
    several = unions.groupBy("core").agg(F.count("*").alias("unions")).filter("unions > 1").select("core")
    # runs whose union is met again are sorted; one of its own union is open if its core has others
    again = live.join(unions.filter("met > 1"), ["core", "whole"])
    alone = live.join(unions.filter("met = 1"), ["core", "whole"]).join(several, "core", "left_semi")
    bodies = fetch(again.unionByName(alone).select(
        "*",
        (F.col("count") + (LENGTH - 1)).cast("bigint").alias("size"),
        F.ceil(F.col("met") / HOT).cast("int").alias("parts"),
        (F.col("met") > 1).alias("sorted"),
    ))
    bodies = materialise(bodies, f"suffix-{name}-bodies")
    first, found = sort_unions(bodies.filter("sorted"), size, f"{name}-sorted")
    spans = runs.filter("kind = 0").select("rid", "start", (F.col("start") + F.col("count")).alias("stop")).unionByName(found)
    each = first.unionByName(bodies.filter("not sorted").select(first.columns))
    mixed = each.groupBy("core").agg(F.count("*").alias("unions")).filter("unions > 1").select("core")
    return spans, each.join(mixed, "core", "left_semi").select("rid", F.col("start").alias("base"), "origin", "body")


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [packer.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["rid", "packed"])


def packed_texts(texts: DataFrame) -> DataFrame:
    return texts.mapInArrow(_zip, "rid bigint, packed binary")


BODY_SCHEMA = "rid bigint, start bigint, origin bigint, core bigint, whole bigint, n int, parts int, sorted boolean, body binary"


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each text with their bytes."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        lists = batch.column(2)
        runs = lists.flatten()
        rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        fields = {f.name: runs.field(i) for i, f in enumerate(runs.type)}
        start, size = fields["start"].to_numpy(), fields["size"].to_numpy()
        body, text, now = [], b"", -1
        for r, a, k in zip(rows.tolist(), start.tolist(), size.tolist()):
            if r != now:
                text, now = unpack(batch.column(1)[r].as_py()), r
            body.append(text[a : a + k])
        names = ["start", "origin", "core", "whole", "n", "parts", "sorted"]
        arrays = [batch.column(0).take(pa.array(rows)), *(fields[x] for x in names), pa.array(body, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["rid", *names, "body"])


def bodies_of_texts(texts: DataFrame) -> Callable:
    """Adds the bytes to runs of ``texts``."""

    def fetch(runs: DataFrame) -> DataFrame:
        of_text = F.struct("start", "size", "origin", "core", "whole", "n", "parts", "sorted")
        wanted = runs.groupBy("rid").agg(F.collect_list(of_text).alias("runs"))  # within one text
        return packed_texts(texts).join(wanted, "rid").select("rid", "packed", "runs").mapInArrow(_bodies, BODY_SCHEMA)

    return fetch


def bodies_of_runs(source: DataFrame) -> Callable:
    """Adds the bytes to runs that were cut from those of ``source``."""

    def fetch(runs: DataFrame) -> DataFrame:
        joined = runs.join(source.select("rid", "base", F.col("body").alias("of_run")), ["rid", "base"])
        body = F.substring("of_run", (F.col("start") - F.col("base") + 1).cast("int"), F.col("size").cast("int"))
        return joined.select("rid", "start", "origin", "core", "whole", "n", "parts", "sorted", body.alias("body"))

    return fetch


# ----------------------------------------------------------------- the suffix array
def words_of(suffixes: np.ndarray) -> np.ndarray:
    """Rows of LENGTH bytes as big-endian 8-byte words."""
    return np.ascontiguousarray(suffixes).view(">u8").astype(np.uint64)


def multikey_quicksort(keys: np.ndarray, small: int = 4096) -> np.ndarray:
    """Order of the rows of ``keys``: three-way partition on one word at a time, equal rows go on to the next word.

    Segments of at most ``small`` rows are finished together, one word a round for all of them.
    """
    n, depth_end = keys.shape
    order = np.arange(n)
    todo, rest = [(0, n, 0)], []
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == depth_end:
            continue
        if b - a <= small:
            rest.append((a, b, depth))
            continue
        idx = order[a:b]
        column = keys[idx, depth]
        tried = np.sort(column[:: max(1, (b - a) // 63)])
        pivot = tried[len(tried) // 2]
        less, more = column < pivot, column > pivot
        lt, eq, gt = idx[less], idx[~(less | more)], idx[more]
        order[a:b] = np.concatenate([lt, eq, gt])
        m, e = a + len(lt), a + len(lt) + len(eq)
        todo += [(a, m, depth), (m, e, depth + 1), (e, b, depth)]
    if rest:
        first, last, depth = (np.array(x) for x in zip(*sorted(rest)))
        size = last - first
        segment = np.repeat(np.arange(len(rest)), size)
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        while len(at):
            rows = order[at]
            word = keys[rows, depth[segment]]
            by = np.lexsort((word, segment))
            order[at] = rows[by]
            word = word[by]  # segments keep their places, only rows within them move
            new = np.ones(len(at), bool)
            new[1:] = (segment[1:] != segment[:-1]) | (word[1:] != word[:-1])
            number = np.cumsum(new) - 1
            depth = depth[segment[new]] + 1
            open_ = (np.bincount(number) > 1) & (depth < depth_end)
            keep = open_[number]
            at, segment = at[keep], (np.cumsum(open_) - 1)[number[keep]]
            depth = depth[open_]
    return order


def neighbours_equal(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each row of ``keys``: whether a neighbour in sorted order equals it in full."""
    out = np.zeros(len(order), bool)
    if len(order) > 1:
        same = (keys[order[1:]] == keys[order[:-1]]).all(axis=1)
        out[order[1:]] |= same
        out[order[:-1]] |= same
    return out


def explode_suffixes(splitters: np.ndarray) -> Callable:
    """(rid, start, bucket, suffix, settled) for every start of each run; what repeats within the batch is settled at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                part = batch.slice(lo, 20_000)
                ids, starts = (part.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                for a, b, data, offsets in X.slices(part.column(2)):
                    n = np.diff(offsets) - LENGTH + 1
                    row = np.repeat(np.arange(b - a), n)
                    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    at = offsets[row] + k
                    matrix = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]
                    keys = words_of(matrix)
                    h = X.span_hashes(X.prefix_sums(data), at, at + LENGTH)
                    first, many = equal_rows(h, lambda i, j: (keys[i] == keys[j]).all(axis=1))
                    bucket = bucket_of(keys[:, 0], h, splitters)
                    rid, start = ids[a:b][row], starts[a:b][row] + k
                    twice = many > 1
                    if twice.any():
                        blank = pa.array([None] * int(twice.sum()), pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(rid[twice]), pa.array(start[twice]), pa.array(bucket[twice], pa.int32()), blank, pa.array(np.ones(int(twice.sum()), bool))],
                            ["rid", "start", "bucket", "suffix", "settled"],
                        )
                    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(first), [None, pa.py_buffer(np.ascontiguousarray(matrix[first]))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid[first]), pa.array(start[first]), pa.array(bucket[first], pa.int32()), flat.cast(pa.binary()), pa.array(np.zeros(len(first), bool))],
                        ["rid", "start", "bucket", "suffix", "settled"],
                    )

    return run


def sort_bucket(table: pa.Table) -> pa.Table:
    """Repeated suffixes of one bucket as spans (rid, start, stop)."""
    rid, start = (table.column(i).to_numpy() for i in (0, 1))
    settled = table.column(4).to_numpy().astype(bool)
    hit = settled.copy()
    live = np.flatnonzero(~settled)
    if len(live):
        column = table.column(3).combine_chunks()
        matrix = np.concatenate([d.reshape(-1, LENGTH) for _, _, d, _ in X.slices(column.drop_null())])
        keys = words_of(matrix)
        hit[live] = neighbours_equal(keys, multikey_quicksort(keys))
    r, s, e = merged_spans(rid[hit], start[hit], start[hit] + LENGTH)
    return pa.table({"rid": pa.array(r, pa.int64()), "start": pa.array(s, pa.int64()), "stop": pa.array(e, pa.int64())})


def splitters_of(bodies: DataFrame, size: int, starts: int) -> np.ndarray:
    """Leading bytes that cut ``bodies``, ``starts`` suffixes of ``size`` bytes in all, into buckets of about ``BUCKET`` bytes."""
    buckets = max(8, -(-starts * size // BUCKET))
    # leading bytes of about SAMPLE rows, or 20 a bucket, picked by a hash
    share = max(1, -(-bodies.count() // max(SAMPLE, 20 * buckets)))
    lead = bodies.filter(F.pmod(F.xxhash64("rid", "start"), F.lit(share)) == 0).select(F.substring("body", 1, 8).alias("lead"))
    tokens = np.sort(np.array([int.from_bytes(bytes(r.lead), "big") for r in lead.collect()], dtype=np.uint64))
    at = (np.arange(1, buckets) * len(tokens)) // buckets
    return tokens[at] if len(tokens) else np.zeros(0, np.uint64)


def bucket_of(lead: np.ndarray, content: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Bucket of each leading word; one that several splitters repeat is dealt by the hash of its whole content."""
    left = np.searchsorted(splitters, lead, side="left")
    right = np.searchsorted(splitters, lead, side="right")
    return left + (content % (right - left + 1).astype(np.uint64)).astype(np.int64)


def deal_unions(splitters: np.ndarray) -> Callable:
    """Adds the bucket to rows of ``BODY_SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lead = np.concatenate([data[offsets[:-1, None] + np.arange(8)].view(">u8")[:, 0] for _, _, data, offsets in X.slices(batch.column(8))])
            whole = batch.column(4).to_numpy().view(np.uint64)
            bucket = bucket_of(lead.astype(np.uint64), whole, splitters)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int32())], [*batch.schema.names, "bucket"])

    return run


SORTED_SCHEMA = "rid bigint, start bigint, stop bigint, origin bigint, core bigint, whole bigint, n int, parts int, bucket int, found boolean, body binary"


def sort_unions_of(size: int) -> Callable:
    """Sorts the unions of a bucket: ``found`` rows have an equal one; the first of equal rows keeps its bytes, the others lose them."""
    words = -(-size // 8)

    def run(table: pa.Table) -> pa.Table:
        keys = []
        column = table.column("body").combine_chunks()
        length = np.zeros(len(table), np.int64)
        for a, b, data, offsets in X.slices(column):
            length[a:b] = np.diff(offsets)
            padded = np.zeros((b - a, words * 8), np.uint8)
            padded[np.arange(words * 8) < length[a:b, None]] = data
            keys.append(words_of(padded))
        keys = np.column_stack([np.concatenate(keys), length.astype(np.uint64)])
        order = multikey_quicksort(keys)
        new = np.ones(len(order), bool)
        new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        n = table.column("n").to_numpy()
        rid, start = table.column("rid").to_numpy(), table.column("start").to_numpy()
        ranked = np.lexsort((start, rid, group))
        first = np.zeros(len(order), bool)
        first[ranked[np.append(True, np.diff(group[ranked]) > 0)]] = True
        many = np.bincount(group)[group] > 1
        out = {x: table.column(x) for x in ("rid", "start", "origin", "core", "whole", "parts", "bucket")}
        out["stop"] = pa.array(start + length)
        out["n"] = pa.array(np.where(many, 2, n), pa.int32())
        out["found"] = pa.array(many & (n == 1))
        out["body"] = pc.if_else(pa.array(first), column, pa.scalar(None, column.type)).cast(pa.binary())
        return pa.table({f.split(" ")[0]: out[f.split(" ")[0]] for f in SORTED_SCHEMA.split(", ")})

    return run


def sort_unions(bodies: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(one row of each union with its bytes, spans of rows that have an equal one), both decided by sorted bytes."""
    splitters = splitters_of(bodies, size, bodies.count())
    dealt = bodies.mapInArrow(deal_unions(splitters), f"{BODY_SCHEMA}, bucket int")
    part = F.pmod(F.xxhash64("rid", "start"), F.col("parts").cast("bigint"))
    done = dealt.groupBy("bucket", part.alias("part")).applyInArrow(sort_unions_of(size), SORTED_SCHEMA)
    done = materialise(done, f"suffix-{name}")
    spans = done.filter("found")
    first = done.filter("body is not null and parts = 1")
    halved = done.filter("body is not null and parts > 1")
    if not halved.isEmpty():
        again = halved.groupBy("bucket").applyInArrow(sort_unions_of(size), SORTED_SCHEMA)
        again = materialise(again, f"suffix-{name}-parts")
        spans = spans.unionByName(again.filter("found"))
        first = first.unionByName(again.filter("body is not null"))
    return first.select("rid", "start", "origin", "core", "body"), spans.select("rid", "start", "stop")


def suffix_spans(runs: DataFrame) -> DataFrame:
    """(rid, start, stop) of the single starts of ``runs`` (rid, base, origin, body) whose 200 bytes are met again."""
    starts = runs.agg(F.sum(F.octet_length("body") - (LENGTH - 1))).first()[0] or 0
    splitters = splitters_of(runs.withColumnRenamed("base", "start"), LENGTH, int(starts))
    runs = runs.select("rid", "base", "body")
    suffixes = runs.mapInArrow(explode_suffixes(splitters), "rid bigint, start bigint, bucket int, suffix binary, settled boolean")
    return suffixes.groupBy("bucket").applyInArrow(sort_bucket, "rid bigint, start bigint, stop bigint")


# ------------------------------------------------------------------------- operator
def repeated_spans(texts: DataFrame) -> DataFrame:
    """(rid, start, stop): byte spans to remove, possibly overlapping, of unique (rid, text) rows."""
    spans, left = one_level(texts, scan_runs, bodies_of_texts(texts), 2 * LENGTH - GRAM, "anchors")
    for size in BLOCKS:
        source = materialise(left, "suffix-open")
        more, left = one_level(source, cut_runs(size), bodies_of_runs(source), LENGTH + size - 1, f"blocks-{size}")
        spans = spans.unionByName(more)
    return spans.unionByName(suffix_spans(materialise(left, "suffix-starts")))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        size, kept, spans = [], [], []
        for packed, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text = unpack(packed)
            own = sorted((x["start"], x["stop"]) for x in found or ())
            joined: list[list[int]] = []
            for a, b in own:
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            at, left = 0, []
            for a, b in joined:
                left.append(text[at:a])
                at = b
            left.append(text[at:])
            size.append(len(text)), kept.append(b"".join(left)), spans.append([{"start": a, "stop": b} for a, b in joined])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        arrays = [batch.column(0), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)]
        yield pa.RecordBatch.from_arrays(arrays, ["rid", "n_bytes", "kept", "spans"])


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, kept, spans): the remaining bytes and the removed byte spans of every row."""
    ids = documents.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).filter("n > 1 or k is null")
    unique = dict(documents.dtypes)[key] in ("bigint", "int", "smallint", "tinyint") and ids.isEmpty()
    if unique:
        base = documents.select(F.col(key).cast("bigint").alias("rid"), F.col(text).alias("text"))
        names = None
    else:
        numbered = documents.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("k"), F.col(text).alias("text"))
        numbered = materialise(numbered, "suffix-numbered")
        base, names = numbered.select("rid", "text"), numbered.select("rid", "k")
    spans = materialise(repeated_spans(base), "suffix-spans")
    own = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("found"))  # within one text
    done = packed_texts(base).join(own, "rid", "left").select("rid", "packed", "found")
    done = done.mapInArrow(_finish, "rid bigint, n_bytes bigint, kept binary, spans array<struct<start:bigint,stop:bigint>>")
    if names is None:
        return done.select(F.col("rid").cast(dict(documents.dtypes)[key]).alias(key), "n_bytes", "kept", "spans")
    return done.join(names, "rid").select(F.col("k").alias(key), "n_bytes", "kept", "spans")


def digest(documents: DataFrame) -> DataFrame:
    """The contract rows of query op3."""
    return remove_repeats(documents).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
