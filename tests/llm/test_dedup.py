"""Exact dedup, SimHash and repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_cases import ODD, prose

from finwake.llm import exact_dedup, minmax, simhash, suffix_dedup
from finwake.llm import textops as X


def test_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(4)]
    runs = defaultdict(list)
    for p in parts:
        for q, r, c in exact_dedup.build_filter(p, 6):
            runs[q].append((r, c))
    got = {}
    for q, rs in runs.items():
        remainders, counts = exact_dedup.merge_runs(rs)
        assert (np.diff(remainders.astype(object)) > 0).all()
        got |= {(q << 58) | int(r): int(c) for r, c in zip(remainders, counts)}
    assert got == dict(Counter(int(x) for p in parts for x in p))
    assert exact_dedup.build_filter(np.zeros(0, np.uint64), 6) == []


def brute_groups(rows):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[body(t)].append((-len(t or ""), i is not None, i or 0, k))
    out = []
    for k, (i, t) in enumerate(rows):
        g = groups[body(t)]
        out.append((i, rows[min(g)[3]][0], len(g), min(g)[3] == k, hashlib.sha256(body(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [ODD, [(i, prose(5, i % 4) + " " * (i % 3)) for i in range(40)], [(7, "ab"), (7, "a  b"), (8, "ab"), (9, "x"), (9, "x")], []])
def test_exact_groups(frame, rows):
    got = exact_dedup.exact_groups(frame(rows)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=str) == brute_groups(rows)
    assert exact_dedup.quotient_bits(0) == 8 and exact_dedup.quotient_bits(1 << 34) == 14


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_groups(frame):
    base = prose(400, 1)
    rows = [(i, base.replace("alpha", f"alpha{i}", 1) if i else base) for i in range(12)] + [(20 + i, prose(60, 50 + i)) for i in range(15)]
    rows += [(100 + (i or 0), t) for i, t in ODD if i is not None]
    prints = {i: brute_fingerprint(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = simhash.near_groups(frame(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", find(r.doc_id)), r.doc_id
    assert simhash.near_groups(frame([])).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_covering(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    r = random.Random(2)
    for _ in range(2000):
        diff = sum(1 << b for b in r.sample(range(64), radius))
        assert any(not diff & m for m in masks)


def test_links_and_components_on_random_fingerprints(spark):
    r = random.Random(3)
    prints = {r.getrandbits(64) for _ in range(40)}
    for x in list(prints):
        for _ in range(r.randrange(4)):
            x ^= 1 << r.randrange(64)
            if r.random() < 0.5:
                x ^= 1 << r.randrange(64)
            prints.add(x)
    signed = sorted(simhash.signed(p) for p in prints)
    nodes = spark.createDataFrame([(p,) for p in signed], "_fp bigint")
    edges = simhash.links(nodes)
    for e in edges.collect():
        assert ((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 2
    roots = {x.node: x.root for x in simhash.components(edges).collect()}
    parent = {p: p for p in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert all(roots.get(p, p) == find(p) for p in signed)


def near_copies(df, **how):
    """The component of every text that is linked, by 5-word shingles of words of any script."""
    got = minmax.similar_groups(df, size=5, words="unicode", **how).collect()
    n = Counter(r.component_id for r in got)
    return {r.doc_id: r.component_id for r in got if n[r.component_id] > 1}


def brute_similar(rows, ratio=0.8):
    """The smallest id of each component of texts whose 5-word shingles have this Jaccard similarity."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if (w := t.split())}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= ratio * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets if sum(find(j) == find(i) for j in sets) > 1}


def test_similar_groups_of_trimmed_and_extended_copies(frame):
    rows = []
    for s in range(24):
        text = prose(150 + 40 * s, 300 + s)
        w = text.split()
        cut = int(len(w) * (0.06, 0.12, 0.18)[s % 3])
        rows += [(10 * s, text), (10 * s + 1, " ".join(w[cut:] if s % 2 else w[:-cut])), (10 * s + 2, text + " " + prose(cut, 600 + s))]
    want = brute_similar(rows)
    assert len(want) == 72
    assert near_copies(frame(rows)) == want


def test_similar_groups_of_permuted_texts(frame):
    # five arrangements of the same paragraphs, three near copies of each, ids dealt over all of them
    parts = [prose(60, 700 + k) for k in range(8)]
    r = random.Random(5)
    rows = []
    for s in range(5):
        order = [w for p in r.sample(parts, 8) for w in r.sample(p.split(), 60)]
        rows += [(s + 5 * k, " ".join(order[k:])) for k in range(3)]
    rows += [(100 + k, " ".join(f"same{j}" for j in range(40)) + " " + prose(12, 800 + k)) for k in range(12)]
    rows += [(205, rows[-6][1] + " end")]  # a copy of one in the middle of a bucket of texts that are no copies
    want = brute_similar(rows)
    assert len(want) == 17
    assert near_copies(frame(rows)) == want


@pytest.mark.parametrize("group, nearest", [(8, 1), (8, 4), (256, 1), (256, 4)])
def test_components_do_not_depend_on_the_nearest(frame, monkeypatch, group, nearest):
    # one large bucket of versions around the threshold: the nearest of many are no links, farther ones are
    monkeypatch.setattr(minmax, "GROUP", group)
    monkeypatch.setattr(minmax, "NEAREST", nearest)
    r = random.Random(11)
    rows = []
    for s, versions in enumerate((40, 25)):
        w = prose(400, 950 + s).split()
        for k in range(versions):
            edits = set(r.sample(range(0, 400, 5), r.choice((4, 6, 8, 9, 10, 12))))
            rows.append((100 * s + k, " ".join(x + f"v{k}" if j in edits else x for j, x in enumerate(w))))
    rows += [(300 + i, prose(100, 970 + i)) for i in range(4)]
    want = brute_similar(rows)
    assert 10 < len(want) < 65
    assert near_copies(frame(rows)) == want


def brute_repeats(rows):
    texts = [(t or "").encode() for _, t in rows]
    n = suffix_dedup.LENGTH
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeat_rows():
    passage, other = prose(60, 900), prose(80, 901)
    rows = [(i, prose(20 + 5 * i, i) + " " + (passage if i % 3 == 0 else other[i:]) + " " + prose(15, 40 + i)) for i in range(12)]
    rows += [(50, passage + passage), (51, "ab" * 400), (52, "ab" * 150 + "é" * 200), (53, passage[:199]), (54, passage[:200]), (55, passage[3:210])]
    return rows


@pytest.mark.parametrize("rows", [repeat_rows(), [(i, t) for i, t in ODD if i != 6] + [(6, "x " * 500)], []])
def test_repeated_strings(frame, rows):
    got = suffix_dedup.digest(frame(rows).repartition(3)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_repeats(rows)


def test_pieces_of_long_texts(frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)
    monkeypatch.setattr(X, "SLICE", 256)
    rows = repeat_rows()
    parts = []
    import pyarrow as pa

    column = pa.array([t for _, t in rows])
    for rows_, base, data, offsets in suffix_dedup.pieces(column):
        for j, r in enumerate(rows_):
            parts.append((int(r), int(base[j]), bytes(data[offsets[j] : offsets[j + 1]])))
    for r, base, piece in parts:
        assert rows[r][1].encode()[base : base + len(piece)] == piece
    starts = {(r, base + k) for r, base, piece in parts for k in range(len(piece) - 199)}
    assert starts == {(r, k) for r, (_, t) in enumerate(rows) for k in range(len(t.encode()) - 199)}


def test_equal_keys_of_unequal_rows_stand_alone():
    rows = np.array([5, 6, 5, 7, 6, 8])
    key = np.array([1, 1, 1, 2, 1, 3])  # rows 1 and 4 collide with 0 and 2
    first, size = suffix_dedup.equal_rows(key, lambda i, j: rows[i] == rows[j])
    assert sorted(first.tolist()) == [0, 1, 3, 4, 5] and size.tolist() == [2, 1, 2, 1, 1, 1]
    lone, size = suffix_dedup.equal_rows(key[:2], lambda i, j: rows[i] == rows[j])
    assert sorted(lone.tolist()) == [0, 1] and size.tolist() == [1, 1]


def test_repeats_survive_colliding_hashes(frame, monkeypatch):
    """Strings that a batch settles are compared in full, so hashes of four bits change nothing."""
    whole = X.span_hashes
    monkeypatch.setattr(X, "span_hashes", lambda s, a, b, seed=1: whole(s, a, b, seed) & np.uint64(15) if len(a) and (b - a == 200).all() and seed == 1 else whole(s, a, b, seed))
    data = np.frombuffer(" ".join(t or "" for _, t in repeat_rows()).encode(), np.uint8)
    import pyarrow as pa

    n = len(data) - 199
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([data.tobytes()], pa.binary())], ["rid", "base", "body"])
    out = pa.Table.from_batches(list(suffix_dedup.explode_suffixes(np.zeros(0, np.uint64))(iter([batch]))))
    tables = [out.filter(pa.array(out.column("bucket").to_numpy() == b)) for b in set(out.column("bucket").to_pylist())]
    spans = [r for t in tables for r in suffix_dedup.sort_bucket(t).to_pylist()]
    text = data.tobytes()
    seen = Counter(text[k : k + 200] for k in range(n))
    want, got = bytearray(len(text)), bytearray(len(text))
    for k in range(n):
        if seen[text[k : k + 200]] > 1:
            want[k : k + 200] = b"\1" * 200
    for r in spans:
        got[r["start"] : r["stop"]] = b"\1" * (r["stop"] - r["start"])
    assert got == want


def colliding(scan):
    """The scan with cores of three bits and one hash for all unions."""

    def run(batches):
        import pyarrow as pa

        from finwake.llm import textops as X

        real = X.span_hashes
        X.span_hashes = lambda s, a, b, seed=1: real(s, a, b, seed) & np.uint64(7 if seed == 1 else 0)
        try:
            for batch in scan(batches):
                core, live = batch.column("core").to_numpy(), batch.column("kind").to_numpy() == 1
                columns = dict(zip(batch.schema.names, batch.columns))
                columns["core"] = pa.array(np.where(live, core & 7, core))
                columns["whole"] = pa.array(np.zeros(len(core), np.int64))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        finally:
            X.span_hashes = real

    return run


def test_hashes_alone_remove_nothing(frame, monkeypatch):
    """Cores and unions that all collide, at both levels, in one batch and between tasks."""
    scan, cut = suffix_dedup.scan_runs, suffix_dedup.cut_runs
    monkeypatch.setattr(suffix_dedup, "scan_runs", colliding(scan))
    monkeypatch.setattr(suffix_dedup, "cut_runs", lambda size: colliding(cut(size)))
    got = suffix_dedup.digest(frame(repeat_rows()).repartition(3)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_repeats(repeat_rows())


def test_hot_unions_are_sorted_in_parts(frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 4000)
    rows = repeat_rows() + [(100 + i, prose(60, 900) + f" {i} " + prose(10, 300 + i)) for i in range(20)]
    got = suffix_dedup.digest(frame(rows).repartition(12)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_repeats(rows)


def test_texts_of_the_thue_morse_pattern(frame):
    """Sums modulo 2**64 do not tell these apart; the bytes do."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(0, word), (1, word.translate(str.maketrans("ab", "ba"))), (2, prose(50, 7)), (3, word[:300] + prose(50, 8))]
    got = suffix_dedup.digest(frame(rows).repartition(2)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_repeats(rows)


def test_multikey_quicksort():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 3, (3000, 25)).astype(np.uint64)
    keys[::7] = keys[0]
    order = suffix_dedup.multikey_quicksort(keys, small=16)
    assert keys[order].tolist() == sorted(keys.tolist())
    hit = suffix_dedup.neighbours_equal(keys, order)
    count = Counter(map(tuple, keys.tolist()))
    assert hit.tolist() == [count[tuple(k)] > 1 for k in keys.tolist()]
