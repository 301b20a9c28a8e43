"""Clustering around centroids, exact, with bounds that follow the centroids' moves.

Each vector keeps the exact distance to its centroid and a lower bound on the distance to all others.
After the centroids move, a vector whose new distance lies below its lowered bound stays where it
is; any other is ambiguous and measured against all centroids. Vectors of cluster a lie in a sphere around
its old centroid, with the largest distance as radius r. For another centroid that moved from p
to q, at distance D, with m halfway, the distance from x to p shrinks by at most

    |xp| - |xq| = 2 (x - m)(q - p) / (|xp| + |xq|) <= D cos(angle between x - m and q - p),

as |xp| + |xq| >= 2 |xm|. In the plane of m, q and the sphere's middle, the least such angle in the
sphere is the middle's own less asin(r / |middle - m|). So the bound is lowered by D only for
spheres that hold m or lie around the line of the move, by less elsewhere, and by nothing behind m.

Components are integers, and distances, sums and centroids exact; bounds are floats with a margin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.session import staged

SCALE = 64
#: Components beyond this have squared distances that a long cannot hold.
LARGEST = 1 << 27
MARGIN = 1e-9  # relative slack of the bounds, far above the rounding of their floats

STATE = "vec_id long, vector binary, cluster int, distance long, bound double, sums binary, n long"
_STATE = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("bound", pa.float64()), ("sums", pa.binary()), ("n", pa.int64())])
_ROWS = 4096


@dataclass
class Clustering:
    """``assigned`` has vec_id, cluster and distance (squared); ``centroids`` are integers, a row each."""

    assigned: DataFrame
    centroids: np.ndarray
    inertias: np.ndarray
    scanned: list[int]


def usable(vectors: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of vectors with ``size`` components, all of them finite numbers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter((F.size(column) == size) & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("embedding"))


def integers(kept: DataFrame, size: int) -> DataFrame:
    """(vec_id, vector): each component as floor(SCALE * x), packed as 32-bit integers."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.floor(batch.column("embedding").flatten().to_numpy(zero_copy_only=False) * SCALE)
            if len(values) and np.abs(values).max() > LARGEST:
                raise ValueError(f"a component beyond {LARGEST // SCALE} has no exact squared distance in 64 bits")
            rows = values.astype("<i4").reshape(-1, size)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "vector"])

    return kept.mapInArrow(pack, "vec_id long, vector binary")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``; equal ids by their bytes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(digest, "vector").limit(k).collect()
    return np.array([np.frombuffer(r["vector"], "<i4") for r in rows], np.int64)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * vectors.shape[1] < 1 << 52:  # then floats are exact as well, and faster
        v, c = vectors.astype(float), centroids.astype(float)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, the most by which the distance from a vector of it to another centroid can have shrunk."""
    old, new = old.astype(float), new.astype(float)
    move = new - old
    drift = np.linalg.norm(move, axis=1)
    from_middle = old[:, None, :] - (old + new)[None, :, :] / 2  # cluster a's sphere seen from halfway of centroid j
    away = np.linalg.norm(from_middle, axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip((from_middle * move).sum(2) / (away * drift), -1, 1))
        spread = np.where(radius[:, None] < away, np.arcsin(np.clip(radius[:, None] / away, 0, 1)), np.pi)
        nearest = np.clip(angle - spread, 0, np.pi / 2)
        shrunk = np.where((drift > 0) & ~np.isnan(nearest), drift * np.cos(nearest), drift)
    np.fill_diagonal(shrunk, 0)
    return shrunk.max(axis=1, initial=0) * (1 + MARGIN) + MARGIN * drift.max(initial=0)


def _assign(rows: DataFrame, centroids: np.ndarray, lowered: np.ndarray | None) -> DataFrame:
    """The next state: a row per vector, and after them a row per task and cluster with sums.

    ``rows`` are vectors, or with ``lowered`` a state whose bounds go down by that much by cluster.
    """
    k, size = centroids.shape

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, inertia, radius = np.zeros((k, size), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        scanned = 0
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<i4").reshape(-1, size).astype(np.int64)
                if lowered is None:
                    cluster, bound = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
                    open_ = np.ones(len(vectors), bool)
                    distance = np.zeros(len(vectors), np.int64)
                else:
                    cluster = batch.column("cluster").to_numpy(zero_copy_only=False).copy()
                    bound = batch.column("bound").to_numpy(zero_copy_only=False) - lowered[cluster]
                    distance = ((vectors - centroids[cluster]) ** 2).sum(1)
                    open_ = ~(np.sqrt(distance.astype(float)) * (1 + MARGIN) < bound)
                if open_.any():
                    d = squared(vectors[open_], centroids)
                    best = d.argmin(1)  # the first of equal ones
                    cluster[open_], distance[open_] = best, d[np.arange(len(d)), best]
                    if k > 1:
                        d[np.arange(len(d)), best] = np.iinfo(np.int64).max
                        bound[open_] = np.sqrt(d.min(1).astype(float)) * (1 - MARGIN)
                    else:
                        bound[open_] = np.inf
                    scanned += int(open_.sum())
                for c in np.unique(cluster):
                    own = cluster == c
                    sums[c] += vectors[own].sum(0)
                    counts[c] += own.sum()
                    inertia[c] += distance[own].sum()
                    radius[c] = max(radius[c], distance[own].max())
                nothing = [None] * len(vectors)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(bound), pa.array(nothing, pa.binary()), pa.array(nothing, pa.int64())], schema=_STATE)
        held = np.flatnonzero(counts)
        if len(held):
            # The side rows: sums, inertia, squared radius and vectors scanned (in the first of a task).
            scans = np.zeros(len(held), np.int64)
            scans[0] = scanned
            packed = [np.concatenate([sums[c], [inertia[c], radius[c], s]]).astype("<i8").tobytes() for c, s in zip(held, scans)]
            nothing = [None] * len(held)
            yield pa.RecordBatch.from_arrays([pa.array(nothing, pa.int64()), pa.array(nothing, pa.binary()), pa.array(held, pa.int32()), pa.array(nothing, pa.int64()), pa.array(nothing, pa.float64()), pa.array(packed, pa.binary()), pa.array(counts[held])], schema=_STATE)

    return rows.mapInArrow(assign, STATE)


def _totals(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, ...]:
    """Sums, counts, inertia, squared radius and number scanned, by cluster, from the side rows of a state.

    Tasks add the rows they read before the shuffle; what reaches the driver is a row per cluster.
    """
    side = state.filter(F.col("sums").isNotNull()).select("cluster", "sums", "n")

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            for c, data, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                row = np.frombuffer(data, "<i8")
                if c in total:
                    most = max(total[c][size + 1], row[size + 1])
                    total[c] = total[c] + row
                    total[c][size + 1] = most
                else:
                    total[c] = row.copy()
                count[c] = count.get(c, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary()), pa.array(list(count.values()), pa.int64())], ["cluster", "sums", "n"])

    schema = "cluster int, sums binary, n long"
    added = side.mapInArrow(add, schema).repartition("cluster").mapInArrow(add, schema).collect()
    sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
    inertia, radius, scanned = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
    for r in added:
        row = np.frombuffer(r["sums"], "<i8")
        sums[r["cluster"]], counts[r["cluster"]] = row[:size], r["n"]
        inertia[r["cluster"]], radius[r["cluster"]], scanned[r["cluster"]] = row[size:]
    return sums, counts, inertia, radius, scanned


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, seed: int = 1) -> Clustering:
    """Cluster ``vectors`` (vec_id, embedding); other columns are left out, whatever their names.

    Vectors that are null, of another size or with a component that is null or not finite are left out
    (see ``usable``); a component beyond LARGEST / SCALE is an error. Centroids start as given by
    ``first_centroids``, fewer where there are fewer vectors. Each round assigns all vectors to the nearest centroid, the
    smaller number of equal ones, and moves each centroid that has vectors to the floor of their mean; at the end vectors are
    assigned once more. Repeated rows count as often as they occur; without vectors there are no rows.
    """
    kept = staged(integers(usable(vectors, size), size), "vectors")
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return Clustering(kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance"), centroids, np.zeros(0, np.int64), [])
    state = staged(_assign(kept, centroids, None), "state")
    scans = []
    for _ in range(rounds):
        sums, counts, _, radius, scanned = _totals(state, len(centroids), size)
        scans.append(int(scanned.sum()))
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        lowered = loosening(centroids, moved, np.sqrt(radius.astype(float)) * (1 + MARGIN))
        rows = state.filter(F.col("vector").isNotNull()).select("vec_id", "vector", "cluster", "bound")
        centroids = moved
        state = staged(_assign(rows, centroids, lowered), "state")
    _, _, inertia, _, scanned = _totals(state, len(centroids), size)
    assigned = state.filter(F.col("vector").isNotNull()).select("vec_id", "cluster", "distance")
    return Clustering(assigned, centroids, inertia, [*scans, int(scanned.sum())])


def by_cluster(values: list, kind: str, column: str = "cluster") -> Column:
    """The value of a row's cluster, from a list with one for each."""
    listed = F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    return F.get(listed, F.col(column))


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()
