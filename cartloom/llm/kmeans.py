"""Centroid clustering: k-means over integer vectors with Elkan's bounds.

Vectors are rows of a table and never move. A round is one job: each task brings the bounds of its
vectors up to the last move of the centroids, computes the distances that they can't rule out, and
passes on, for each centroid, the sum and number of its vectors. What a round knows of a vector (its
centroid, an upper bound, k lower bounds) is kept beside it for the next one. Its lineage is narrow, so a lost
executor costs the vectors that it held and no others.

Bounds are doubles that are always rounded away from the true distance, and a centroid is left out only
if its bound is strictly beyond the upper one; distances themselves are compared as exact squared
integers. So the bounds save work and never decide a tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import written

SCALE = 1024
#: Components must be less than this, so that squared distances of up to 64 of them fit a long.
LIMIT = 1 << 27
_STATE = "vec_id long, q binary, cluster int, upper double, lower binary"
#: Doubles of at most 2**62 are this near to the integer, and the root is correctly rounded.
_UP, _DOWN = 1 + 2.0**-50, 1 - 2.0**-50


@dataclass(frozen=True)
class Clustering:
    """Centroids as integers, and rows (vec_id, cluster, distance)."""

    centroids: np.ndarray
    rows: DataFrame


def quantised(vectors: DataFrame, dims: int, scale: int = SCALE) -> DataFrame:
    """vec_id and q, an array of floor(scale * x), of the vectors that have exactly dims components, all finite.

    Others (null vectors, null, infinite or NaN components) are left out. A component of 2**27 or more after scaling
    fails the job, as its distances have no room in a long.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    known = vectors.filter((F.size("embedding") == dims) & F.coalesce(F.forall("embedding", finite), F.lit(False)))
    scaled = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    checked = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < LIMIT, scaled(x)).otherwise(F.raise_error(F.lit("a component is too large to be clustered exactly")).cast("long")))
    return known.select(F.col("vec_id").cast("long").alias("vec_id"), checked.cast("array<int>").alias("q"))


def _above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * _UP


def _below(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * _DOWN


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Move each vector to its nearest centroid, the least number at ties; cluster and the bounds are changed in place.

    upper and lower must hold for centroids. Gives the number of exact distances.
    """
    k = len(centroids)
    apart = np.sqrt(np.array([squared(centroids, c) for c in centroids], np.float64)) * (_DOWN / 2)  # half the distance of centroids
    np.fill_diagonal(apart, np.inf)
    computed = 0
    near = np.flatnonzero(upper >= apart.min(1)[cluster]) if k > 1 else np.zeros(0, np.int64)
    # Elkan's tests, first with the upper bound at hand, then with the exact distance of those that fail it
    open_ = lambda rows: (lower[rows] <= upper[rows, None]) & (apart[cluster[rows]] <= upper[rows, None])
    near = near[open_(near).any(1)]
    if not len(near):
        return 0
    best = squared(x[near], centroids[cluster[near]])
    computed += len(near)
    upper[near] = _above(best)
    lower[near, cluster[near]] = _below(best)
    for c in range(k):
        own = cluster[near]
        at = np.flatnonzero((own != c) & (lower[near, c] <= upper[near]) & (apart[own, c] <= upper[near]))
        if not len(at):
            continue
        rows = near[at]
        d2 = squared(x[rows], centroids[c])
        computed += len(rows)
        lower[rows, c] = _below(d2)
        better = (d2 < best[at]) | ((d2 == best[at]) & (c < cluster[rows]))
        best[at[better]] = d2[better]
        cluster[rows[better]] = c
        upper[rows[better]] = _above(d2[better])
    return computed


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("q").to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)


def _started(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The first state: all of centroid 0, with bounds that rule nothing out."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            q = batch.column("q")
            raw = q.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(n, -1)
            bounds = [np.zeros(k).tobytes()] * n
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, np.inf)), pa.array(bounds, pa.binary())],
                ["vec_id", "q", "cluster", "upper", "lower"],
            )

    return vectors.mapInArrow(run, _STATE)


def _round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """state after the centroids moved by at most moved to where they are."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch, dims)
            cluster = batch.column("cluster").to_numpy().copy()
            lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), np.float64).reshape(n, k)
            upper = (batch.column("upper").to_numpy() + moved[cluster]) * _UP
            lower = np.maximum(0.0, (lower - moved) - lower * 2.0**-50)
            assign(x, centroids, cluster, upper, lower)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("q"), pa.array(cluster), pa.array(upper), pa.array([r.tobytes() for r in lower], pa.binary())], batch.schema.names
            )

    return state.mapInArrow(run, _STATE)


def _sums(state: DataFrame, k: int, dims: int) -> tuple[list[list[int]], list[int]]:
    """Exact sums and numbers of the vectors of each centroid. A task passes on at most k rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, cluster = _matrix(batch, dims), batch.column("cluster").to_numpy()
                for c in range(k):
                    sums[c] += x[cluster == c].sum(0)
                counts += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(counts)
        rows = [sums[c] for c in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(rows, pa.list_(pa.int64()))], ["cluster", "n", "s"])

    parts = state.select("q", "cluster").mapInArrow(run, "cluster int, n long, s array<long>").select("cluster", F.posexplode(F.concat(F.array("n"), "s")).alias("i", "v"))
    found = parts.groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # k * (dims + 1) numbers
    totals = {(r.cluster, r.i): int(r.v) for r in found}
    return [[totals.get((c, i + 1), 0) for i in range(dims)] for c in range(k)], [totals.get((c, 0), 0) for c in range(k)]


def _distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d2 = squared(_matrix(batch, dims), centroids[batch.column("cluster").to_numpy()])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d2)], ["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long")


def elkan(vectors: DataFrame, starts: list[list[int]], rounds: int) -> Clustering:
    """Cluster (vec_id, q array of int) from the given starts: rounds of assignment and update, then a last assignment.

    A vector goes to the centroid of the least squared distance, ties to the smaller number. A non-empty
    centroid becomes floor(sum / count) of its vectors in each component, all exact; an empty one stays. Repeated rows
    count as often as they are there. Without starts there are no rows.
    """
    spark = vectors.sparkSession
    if not starts:
        return Clustering(np.zeros((0, 0), np.int64), spark.createDataFrame([], "vec_id long, cluster int, distance long"))
    centroids = np.array(starts, np.int64)
    k, dims = centroids.shape
    state, held, moved = _started(vectors, centroids), None, np.zeros(k)
    for _ in range(rounds):
        state = _round(state, centroids, moved).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sums, counts = _sums(state, k, dims)
        except BaseException:
            state.unpersist()
            raise
        finally:
            if held is not None:
                held.unpersist()
        held = state
        new = np.array([[s // n for s in row] if n else old.tolist() for row, n, old in zip(sums, counts, centroids, strict=True)], np.int64)
        moved, centroids = _above(squared(new, centroids)), new
    rows = written(_distances(_round(state, centroids, moved), centroids), "clusters")
    if held is not None:
        held.unpersist()
    return Clustering(centroids, rows)


def lowest_hashes(vectors: DataFrame, k: int, prefix: str) -> list[list[int]]:
    """The k vectors with the smallest hexadecimal sha256 of prefix and vec_id, in that order; ties by components, rows without vec_id last."""
    digest: Column = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    return [list(r.q) for r in vectors.orderBy(digest.asc_nulls_last(), "q").select("q").limit(k).collect()]


def clusters(vectors: DataFrame, k: int = 8, dims: int = 64, rounds: int = 10, prefix: str = "3:", scale: int = SCALE) -> DataFrame:
    """A row for each kept vector of (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    See quantised for the vectors that are kept, and elkan for ties, empty centroids and repeated rows. Fewer
    than k vectors are all centroids. Other columns aren't read; a vec_id may be null; no vectors give no rows.
    """
    kept = quantised(vectors, dims, scale)
    found = elkan(kept, lowest_hashes(kept, k, prefix), rounds)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    names = vectors.sparkSession.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    each = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    # k rows: both sides are as small as the model
    about = each.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(each.agg(F.sum("s").alias("t"))))
    return found.rows.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", F.col("s").cast("long").alias("cluster_inertia"), F.col("t").cast("long").alias("inertia"), "centroid_sha256"
    )
