"""Centroid clustering, spelling variants and min-max hashing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import ODD, prose

from finwake.llm import catalog, centroids, minmax, variants

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ centroids
def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda p: (p[0] is None, hashlib.sha256(f"1:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1]))
    c = [list(v) for _, v in order[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        own = [min(range(len(c)), key=lambda j: (gap(v, c[j]), j)) for _, v in kept]
        if r < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), o in zip(kept, own) if o == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    d = [gap(v, c[o]) for (_, v), o in zip(kept, own)]
    per = Counter()
    for o, x in zip(own, d):
        per[o] += x
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted([(i, o, x, per[o], sum(d), names[o]) for (i, _), o, x in zip(kept, own, d)], key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id bigint, embedding array<float>, cluster bigint, upper string")


def blobs(n, seed=1, spread=0.02):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(9, 64))
    return [(i, [float(np.float32(x)) for x in middle[i % 9] + spread * rng.normal(size=64)]) for i in range(n)]


def odd_vectors():
    rows = blobs(40, 2, 0.5) + [(i, [0.25] * 64) for i in range(100, 130)]
    rows += [(200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 63 + [None]), (204, [0.5] * 63 + [float("nan")]), (205, [float("inf")] + [0.5] * 63)]
    return rows + [(None, [0.75] * 64), (7, rows[7][1]), (7, [-0.01] * 64)]


@pytest.mark.parametrize("rows", [blobs(300), odd_vectors(), blobs(5), [(1, None)], []])
def test_clusters(spark, rows):
    got = centroids.digest(vectors(spark, rows).repartition(3)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_clusters(rows)


def test_bounds_spare_most_of_clear_clusters(spark):
    out = centroids.clusters_of(vectors(spark, blobs(900)), clusters=9).collect()
    assert sum(r.scanned for r in out) < 0.5 * len(out)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(-(1 << 20), 1 << 20, 64)]) for i in range(60)]
    got = centroids.digest(vectors(spark, [*rows, (99, [3e6] * 64)])).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_clusters(rows)


def test_loosening_bounds_every_point_of_the_ball():
    rng = np.random.default_rng(3)
    tighter = 0
    for _ in range(200):
        old = rng.integers(-50, 50, (4, 5))
        new = old + rng.integers(-20, 20, (4, 5))
        radius = rng.uniform(0, 40, 4)
        bound = centroids.loosening(old, new, radius)
        step = rng.normal(size=(4, 400, 5))
        x = old[:, None] + radius[:, None, None] * step / np.linalg.norm(step, axis=2, keepdims=True) * rng.uniform(0, 1, (4, 400, 1)) ** 0.2
        for i in range(4):
            drop = [np.linalg.norm(x[i] - old[j], axis=1) - np.linalg.norm(x[i] - new[j], axis=1) for j in range(4) if j != i]
            assert max(map(np.max, drop)) <= bound[i] + 1e-9
            tighter += bound[i] < max(np.linalg.norm(new[j] - old[j]) for j in range(4) if j != i) - 1e-9
    assert tighter > 200


# ------------------------------------------------------------------ spelling variants
def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    v = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    close = {w: [x for x in v if near(w, x)] for w in v}
    form = {}
    for w, n in v.items():
        best = min(((-v[x], x) for x in close[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None
    out = []
    for w, n in v.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), v[form[w]] if form[w] else None))
    return sorted(out, key=str)


def spelled(seed, docs=60, stems=40):
    r = random.Random(seed)
    letters = "abcÀÿ÷é"
    stem = ["".join(r.choice(letters) for _ in range(r.randrange(4, 9))) for _ in range(stems)]

    def one():
        w = r.choice(stem[: max(1, int(stems * r.random() ** 3))])
        k, kind = r.randrange(len(w)), r.random()
        return w if kind < 0.6 else w[:k] + r.choice(letters) + w[k + (kind < 0.8) :] if kind < 0.9 else w[:k] + w[k + 1 :]

    return [(i, " ".join(one().upper() if r.random() < 0.1 else one() for _ in range(100))) for i in range(docs)]


CHAIN = [(i, "rooted " * 50 + "rootes " * 20 + "roates " * 8 + "croates " * 3 + "aaaaa aaaaaa aaaaaaa " * 4) for i in range(3)]


@pytest.mark.parametrize("longest", [variants.LONGEST_LIST, 2])
@pytest.mark.parametrize("rows", [spelled(1), spelled(2, 20, 4), CHAIN, [*ODD, (8, "x" * 3000 + " ab×Ācd-Straße 12 straße" * 5)], []])
def test_variants(frame, rows, longest):
    got = variants.spelling_variants(frame(rows).repartition(3), longest=longest).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_variants(rows)


def test_texts_are_cut_between_runs(monkeypatch):
    text = " ".join(w for _, t in spelled(3) for w in t.split()[:9]) + "é" * 500
    assert [w for p in variants.pieces(text, 50) for w in variants.RUN.findall(p)] == variants.RUN.findall(text)
    assert max(map(len, variants.pieces(text, 50))) < 700


def test_vocabulary_handed_on_in_parts(frame, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 10)
    rows = spelled(4)
    got = {r.word: r.n for r in variants.vocabulary(frame(rows)).collect()}
    assert got == {r[0]: r[3] for r in brute_variants(rows)}


# ------------------------------------------------------------------ min-max hashing
def brute_minmax(rows):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    out = []
    for i, (key, _) in enumerate(rows):
        c = least.get(top(i))
        out.append((key, len(sets[i]), c, key == c))
    return sorted(out, key=str)


def versions(words, copies, edits, seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(10_000)}" for _ in range(words)]
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(words)] = f"e{r.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def minmax_rows(seed):
    texts = [t for k, (words, copies, edits) in enumerate([(6, 20, 1), (12, 30, 2), (40, 60, 6), (100, 90, 16), (300, 60, 40), (60, 40, 30)]) for t in versions(words, copies, edits, 10 * seed + k)]
    random.Random(seed).shuffle(texts)
    return [*enumerate(texts, 10), *ODD, (900, "one"), (901, "ONE"), (902, "b\x85 a"), (903, "b\x85 A\t")]


@pytest.mark.parametrize("group", [256, 12])
@pytest.mark.parametrize("seed", [1, 2])
def test_minmax(frame, monkeypatch, seed, group):
    monkeypatch.setattr(minmax, "GROUP", group)
    rows = minmax_rows(seed)
    got = minmax.digest(frame(rows).repartition(4)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_minmax(rows)


def test_minmax_of_empty_tables(frame):
    assert minmax.digest(frame([])).collect() == []
    assert [tuple(r) for r in minmax.digest(frame([(1, None), (2, "")])).collect() if not r.kept] == []


def test_many_open_pairs_go_as_cells(frame, monkeypatch):
    """A family just under the threshold with few links: pairs are settled inside whole cells, long texts one by one."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(70):
        edits = set(r.sample(range(0, 120, 2), r.choice((5, 6, 7, 8))))
        rows.append((k, " ".join(f"e{k}x{j}" if j in edits else x for j, x in enumerate(base))))
    want = brute_minmax(rows)
    for limit in (minmax.CELL_SHINGLES, 10):
        monkeypatch.setattr(minmax, "CELL_SHINGLES", limit)
        monkeypatch.setattr(minmax, "NEAREST", 1)
        got = minmax.digest(frame(rows)).collect()
        assert sorted([tuple(x) for x in got], key=str) == want


def test_estimates_are_unbiased():
    rng = np.random.default_rng(6)
    seen = []
    for _ in range(300):
        s = rng.integers(0, 1 << 63, 260, dtype=np.uint64)
        a, b = minmax.extremes(s[:240]), minmax.extremes(s[20:])  # similarity 220 / 260
        seen.append((a == b).mean())
    assert abs(np.mean(seen) - 220 / 260) < 0.005 and np.std(seen) < np.sqrt(0.85 * 0.15 / 128) * 1.15


def test_long_texts_are_read_in_pieces(monkeypatch):
    import pyarrow as pa

    column = pa.array([prose(500, 1), None, "é " * 300, "x" * 700])
    want = list(minmax.word_hashes(column, "space"))
    monkeypatch.setattr(minmax, "PIECE", 64)
    pieces = minmax.pieces
    monkeypatch.setattr(minmax, "pieces", lambda text: pieces(text, 64))
    got = list(minmax.word_hashes(column, "space"))
    assert [(r, h.tolist()) for r, h in want] == [(r, h.tolist()) for r, h in got]


@pytest.mark.parametrize("name", ["op11_centroids", "op13_minmax"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == sorted(map(str, want))


def test_variants_of_the_test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = catalog.queries()["op12_spelling_variants"](spark, SF).collect()
    assert len(got) == len(brute_variants(rows)) and sorted([tuple(r) for r in got], key=str) == brute_variants(rows)


def test_long_words_of_a_known_pattern_differ():
    """Two words whose sums modulo 2**64 agree whatever the base (Thue-Morse)."""
    from finwake.llm import textops as X

    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = "".join("ba"[bin(i).count("1") % 2] for i in range(1024))
    data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    start, end, _ = X.words(data, np.array([0, len(data)]))
    x, y = X.word_hashes(data, start, end)
    assert x != y


def test_all_pairs_of_a_large_bucket_meet(spark, monkeypatch):
    """members whose further values all differ meet as well, unless one component holds both."""
    monkeypatch.setattr(minmax, "CELL_MEMBERS", 8)
    size = 60
    named = [(i.to_bytes(2, "big"), 5, bytes((i * 7 + j * i * i) % 251 for j in range(minmax.VALUES)), b"main" if i % 2 else bytes([i // 8])) for i in range(size)]
    named = spark.createDataFrame(named, "same binary, n bigint, sign binary, root binary")
    places = named.selectExpr("7L as at", "same", f"{size}L as m", f"{5 * size}L as w")
    cells = {}
    for r in minmax.split_cells(places, named).collect():
        assert not r.whole
        cells.setdefault(r["at"], set()).add(int.from_bytes(r.same, "big"))
    met = {(a, b) for c in cells.values() for a in c for b in c}
    assert all((a, b) in met for a in range(size) for b in range(size) if not (a % 2 and b % 2))
    assert len(cells) > 8 and max(map(len, cells.values())) < size
