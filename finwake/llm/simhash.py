"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: texts are lower-cased (A-Z), cut into words and 3-word shingles; bit b of
the fingerprint is 1 if b is set in over half the shingles' XXH64 values.

Candidates: for radius r, bit position i of the fingerprint gets a vector m(i) in
{0,1}^(r+1), and table v (one of the 2^(r+1)-1 nonzero vectors) keeps the positions
with <m(i), v> = 1 modulo 2. Any r positions span at most r dimensions, so some v is
orthogonal to all of them: that table hides every differing bit, and each pair within
the radius collides there. With r = 2 there are seven tables of about 37 bits.

Links: inside a table's bucket, fingerprints differ in hidden bits only. Rather than
comparing pairs, each fingerprint visits itself and its neighbours at one hidden bit;
two fingerprints within two bits meet at such a neighbour, and whoever meets is within
two bits. So links cost (hidden bits + 1) rows a fingerprint, whatever the bucket's
size, and each meeting point emits links to its smallest member only.

Components: alternating large-star and small-star steps over distinct fingerprints,
each step written to the shared folder. Equal fingerprints are one node from the start.

Edge cases: null and empty texts have fingerprint zero and are linked like any other;
null ids never win as the smallest id unless all ids of a component are null; repeated
rows are members of one node; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finwake.llm import textops as X
from finwake.llm.store import materialise

BITS = 64
SEED = 42


def shingle_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words joined by one space, for one text (fewer words: the whole)."""
    n = len(start)
    if n == 0:
        return np.zeros(0, np.uint64)
    digest, raw = xxhash.xxh64_digest, data.tobytes()
    if n > 1 and not np.array_equal(start[1:], end[:-1] + 1):
        raw = b" ".join([raw[a:b] for a, b in zip(start.tolist(), end.tolist())])
        width = end - start
        end = np.cumsum(width + 1) - 1
        start = end - width
    elif n > 1:
        odd = data[end[:-1]]
        if (odd != 32).any():
            fixed = data.copy()
            fixed[end[:-1]] = 32
            raw = fixed.tobytes()
    k = min(size, n)
    a, b = start[: n - k + 1].tolist(), end[k - 1 :].tolist()
    return np.frombuffer(b"".join([digest(raw[i:j], SEED) for i, j in zip(a, b)]), dtype=">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[a : a + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(_id, _fp): the signed 64-bit fingerprint of every row."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for a, b, data, offsets in X.slices(batch.column(1)):
                data = X.lower_ascii(data)
                start, end, row = X.words(data, offsets)
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                for r in range(b - a):
                    s, e = cuts[r], cuts[r + 1]
                    if s < e:
                        lo, hi = offsets[r], offsets[r + 1]
                        out[a + r] = majority(shingle_hashes(data[lo:hi], start[s:e] - lo, end[s:e] - lo, size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["_id", "_fp"])

    return documents.select(F.col(key).alias("_id"), text).mapInArrow(run, f"_id {kind}, _fp bigint")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask of kept bits for each nonzero vector v; m(i) runs through all nonzero vectors in turn."""
    vectors = (1 << (radius + 1)) - 1
    m = [i % vectors + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (m[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(nodes: DataFrame, radius: int = 2, fp: str = "_fp") -> DataFrame:
    """(a, b) with a < b: links that connect all distinct fingerprints within ``radius`` (1 or 2) bits."""
    if radius not in (1, 2):
        raise ValueError("links are found through one meeting bit: radius 1 or 2")
    masks = covering_masks(radius)
    tables = F.array(
        *[
            F.struct(
                F.lit(v).alias("v"),
                F.lit(signed(mask)).alias("mask"),
                F.array(F.lit(0).cast("bigint"), *[F.lit(signed(1 << i)) for i in range(BITS) if not mask >> i & 1]).alias("flips"),
            )
            for v, mask in enumerate(masks)
        ]
    )
    placed = nodes.select(fp, F.explode(tables).alias("t")).select(
        fp, F.col("t.v").alias("v"), F.col(fp).bitwiseAND(F.col("t.mask")).alias("kept"), F.col("t.flips").alias("flips")
    )
    # a bucket of one fingerprint holds no pair
    shared = placed.groupBy("v", "kept").agg(F.min(fp).alias("lo"), F.max(fp).alias("hi")).filter("lo <> hi").select("v", "kept")
    placed = placed.join(shared, ["v", "kept"], "left_semi")
    met = placed.select("v", fp, F.explode(F.transform("flips", lambda f: F.col(fp).bitwiseXOR(f))).alias("at"))
    least = met.groupBy("v", "at").agg(F.min(fp).alias("a"), F.max(fp).alias("z")).filter("a <> z").select("v", "at", "a")
    pairs = met.join(least, ["v", "at"]).filter(F.col("a") != F.col(fp)).select("a", F.col(fp).alias("b"))
    return pairs.distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes that have an edge.

    Large-star links every larger neighbour to the smallest of the neighbourhood, small-star
    every smaller one; both reduce with a minimum and a join, so no neighbourhood is gathered.
    The loop ends when a round changes nothing, however many rounds that takes (their number
    grows with the logarithm of the longest chain).
    """
    e = materialise(edges.select("a", "b"), f"{name}-0")
    before, turn = None, 0
    while True:
        turn += 1
        both = e.select(F.col("a").alias("u"), F.col("b").alias("w")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("w")))
        low = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = both.filter("w > u").join(low, "u").filter("w <> m").select(F.col("m").alias("a"), F.col("w").alias("b")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("w"))
        low = down.groupBy("u").agg(F.min("w").alias("m"))
        small = down.join(low, "u").filter("w <> m").select(F.least("m", "w").alias("a"), F.greatest("m", "w").alias("b"))
        small = small.unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
        e = materialise(small, f"{name}-{turn}")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_groups(documents: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, size: int = 3) -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    marked = materialise(fingerprints(documents, key, text, size), "simhash")
    nodes = marked.groupBy("_fp").agg(F.min("_id").alias("least"))
    nodes = materialise(nodes, "simhash-nodes")
    roots = components(links(nodes.select("_fp"), radius), "simhash-links")
    rooted = nodes.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", F.coalesce("root", "_fp").alias("root"), "least")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(smallest, "root").select("_fp", "component_id")
    return marked.join(labels, "_fp").select(
        F.col("_id").alias(key), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
