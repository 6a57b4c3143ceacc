"""Exact k-means on integer vectors; bounds are loosened by geometric drift tightening.

Every vector keeps an upper bound of the distance to its own centroid and a lower bound of
the distance to all others. When centroids move, a plain bound would be loosened by the
largest drift. Here the vectors of a cluster are known to lie in a ball around its former
centroid, and how much nearer a moved centroid can come to any point of that ball follows
from planar geometry: seen from the middle of the move, a point at angle t to its direction
comes nearer by at most drift * cos(t). The ball covers the angles phi - asin(r / D) to
phi + asin(r / D), with D its centre's distance and phi its centre's angle; so lower bounds
are loosened by drift * cos(phi - asin(r / D)), never by less than nothing, and by the whole
drift only if the ball reaches across the direction of the move. A vector whose bounds do
not overlap keeps its cluster unseen; the others first get the exact distance to their own
centroid, and what is ambiguous then is compared with all centroids in exact integers.

State lives in one table a round (vector, cluster, bounds), written to the shared folder by
narrow tasks: vectors are never shuffled, however many one cluster holds. What travels is
one row of sums a cluster and task, and what the driver holds is the k centroids.

Kept are vectors of ``dims`` components, none null, NaN or infinite; component x counts as
floor(64 * x). A vector with a component outside +-2**27 after that has no squared distance
that fits a long and is left out, too. Repeated rows and ids count once each; a null id is kept
but is a seed only after all others. Ties go to the smaller number. With fewer vectors than
clusters every vector is a seed; an empty table gives an empty result. Other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finwake.llm.store import materialise

DIMS, CLUSTERS, ROUNDS = 64, 16, 3
SCALE = 64
LARGEST = 1 << 27
EXACT_FLOAT = 1 << 20  # products of such components add up exactly in a double
STATE = "vec_id {id}, v array<int>, cluster int, upper double, lower double, distance bigint, scanned boolean"


def integer_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = DIMS) -> DataFrame:
    """(vec_id, v): the kept vectors with integer components."""
    x = F.col(column).cast("array<double>")
    whole = F.transform(x, lambda e: F.floor(e * SCALE))
    inside = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * SCALE) < LARGEST))
    kept = vectors.filter(F.coalesce((F.size(x) == dims) & inside, F.lit(False)))
    return kept.select(F.col(key).alias("vec_id"), whole.cast("array<int>").alias("v"))


def seeds(vectors: DataFrame, clusters: int = CLUSTERS, dims: int = DIMS) -> np.ndarray:
    """The vectors with the smallest sha256 of ``1:<vec_id>``."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.select(name.alias("name"), "v").orderBy(F.asc_nulls_last("name"), "v").limit(clusters).collect()
    return np.array([r.v for r in first], np.int64).reshape(len(first), dims)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all centroids."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT_FLOAT else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None]).astype(np.int64)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Of each cluster i: how much nearer any other centroid can have come to a point of the ball (old[i], radius[i])."""
    k = len(old)
    out = np.zeros(k)
    for i in range(k):
        for j in range(k):
            move = (new[j] - old[j]).astype(float)
            drift = float(np.sqrt(move @ move))
            if j == i or drift == 0 or radius[i] < 0:  # an empty cluster has no bounds to loosen
                continue
            to_ball = old[i] - (old[j] + new[j]) / 2
            far = float(np.sqrt(to_ball @ to_ball))
            nearer = drift
            if radius[i] * (1 + 1e-9) < far:
                phi = np.arccos(np.clip(to_ball @ move / (far * drift), -1, 1))
                least = phi - np.arcsin(radius[i] * (1 + 1e-9) / far) - 1e-7  # rounding errs to the safe side
                nearer = drift * np.cos(max(0.0, least))
            out[i] = max(out[i], nearer)
    return out * (1 + 1e-12)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, -1)


def assign(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None = None, radius: np.ndarray | None = None) -> DataFrame:
    """The state after one assignment; with ``before`` and ``radius`` its bounds spare what they can."""
    schema = STATE.format(id=state.schema["vec_id"].dataType.simpleString())
    known = before is not None
    if known:
        loose = loosening(before, centroids, radius)
        drift = np.sqrt(((centroids - before).astype(float) ** 2).sum(axis=1)) * (1 + 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, n = _matrix(batch), batch.num_rows
            if known:
                own = batch.column(2).to_numpy().astype(np.int32)
                upper = batch.column(3).to_numpy() + drift[own]
                lower = batch.column(4).to_numpy() - loose[own]
                slack = 1e-9 * (1 + upper)
                at = np.flatnonzero(upper + slack >= lower)
                gap = x[at] - centroids[own[at]]
                upper[at] = np.sqrt((gap * gap).sum(axis=1))
                at = at[upper[at] + slack[at] >= lower[at]]
            else:
                own, upper, lower, at = np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.arange(n)
            if len(at):
                d = squared_distances(x[at], centroids)
                own[at] = d.argmin(axis=1)  # the first of equals
                rows = np.arange(len(at))
                upper[at] = np.sqrt(d[rows, own[at]])
                d[rows, own[at]] = np.iinfo(np.int64).max
                lower[at] = np.sqrt(d.min(axis=1))
            gap = x - centroids[own]
            scanned = np.zeros(n, bool)
            scanned[at] = True
            columns = [batch.column(0), batch.column(1), pa.array(own), pa.array(upper), pa.array(lower), pa.array((gap * gap).sum(axis=1)), pa.array(scanned)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "cluster", "upper", "lower", "distance", "scanned"])

    return state.mapInArrow(run, schema)


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Floors of the means of all clusters (empty ones stay) and the radii of their balls (-1: empty)."""
    dims = centroids.shape[1]
    sums = [F.sum(F.col("v")[i].cast("bigint")).alias(f"s{i}") for i in range(dims)]
    out, radius = centroids.copy(), np.full(len(centroids), -1.0)
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("upper").alias("r"), *sums).collect():  # k rows
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(dims)]
        radius[row.cluster] = row.r
    return out, radius


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """The last state (a written table) and the final centroids."""
    state = materialise(integer_vectors(vectors, key, column, dims), "centroids-vectors")
    now = seeds(state, clusters, dims)
    if not len(now):
        return state.select("vec_id", "v", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("upper", "double"), ("lower", "double"), ("distance", "bigint"), ("scanned", "boolean"))]), now
    state = materialise(assign(state, now), "centroids-state")
    for _ in range(rounds):
        moved, radius = _moved(state, now)
        state = materialise(assign(state, moved, now, radius), "centroids-state")
        now = moved
    return state, now


def clusters_of(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """One row a kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and whether the last round scanned it."""
    state, centroids = cluster(vectors, key, column, clusters, rounds, dims)
    spark = state.sparkSession
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    top = (1 << 63) - 1
    whole = min(sum(sums.values()), top)
    facts = [(c, min(s, top), whole, names[c]) for c, s in sums.items()]
    schema = T.StructType.fromDDL("cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = state.join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster")  # k rows
    return out.select(F.col("vec_id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")


def digest(vectors: DataFrame) -> DataFrame:
    """The same for the test tables, without the scan marks."""
    return clusters_of(vectors).drop("scanned")


def _oracle() -> str:
    """The same by comparing every vector with every centroid in every round."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS cv FROM (
    SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h LIMIT {CLUSTERS}))"""
    ]
    for i in range(ROUNDS + 1):
        gaps = "list_sum(list_transform(list_zip(v, cv), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, CAST(best[2] AS INTEGER) AS c, best[1] AS d FROM (
    SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min([CAST({gaps} AS BIGINT), c]) AS best FROM kept, c{i} GROUP BY r))"""
        )
        if i < ROUNDS:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT c0_.c, coalesce(m.cv, c0_.cv) AS cv FROM c{i} c0_ LEFT JOIN (
    SELECT c, list(CAST(floor_mean AS BIGINT) ORDER BY k) AS cv FROM (
      SELECT c, k, CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS floor_mean FROM (
        SELECT c, k, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (
          SELECT c, unnest(v) AS e, generate_subscripts(v, 1) AS k FROM a{i}) GROUP BY c, k)) GROUP BY c) m ON m.c = c0_.c)"""
            )
    text = ",\n".join(parts)
    return f"""WITH {text}
SELECT vec_id, a.c AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(f.cv, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} f ON f.c = a.c"""


ORACLE_SQL = _oracle()
