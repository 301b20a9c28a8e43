"""Centroid clustering against plain rounds over Python integers, and its bounds against points."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from closebook.llm import centroids


def plain(rows, k, rounds, size):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    middles = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middles)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(middles)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                middles[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, assign())), key=str), middles


def blobs(n, size, spread, seed=3):
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(0, spread, (9, size))
    return [(i, (middles[i % 9] + rnd.normal(0, 1, size)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("k", "rounds", "size", "spread"), [(16, 3, 8, 3), (16, 3, 64, 0.05), (5, 12, 3, 6), (1, 2, 4, 1), (7, 4, 6, 3e5)])
def test_clusters(spark, k, rounds, size, spread):
    rows = blobs(400, size, spread)
    rows += [(500, None), (501, []), (502, [1.0] * (size - 1)), (503, [None, *[1.0] * (size - 1)]), (504, [math.nan] * size), (505, [math.inf, *[0.0] * (size - 1)])]
    rows += [rows[0], rows[0], (None, [0.5] * size), (506, [0.0] * size), (507, [0.0] * size)] + [(600 + i, [1.0] * size) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS vector", "'x' AS sums", "2 AS cluster").repartition(6)
    found = centroids.cluster(table, k, rounds, size)
    want, middles = plain(rows, k, rounds, size)
    assert sorted(map(tuple, found.assigned.collect()), key=str) == want
    assert found.centroids.tolist() == middles
    assert found.inertias.tolist() == [sum(d for _, c, d in want if c == j) for j in range(len(middles))]
    assert found.scanned[0] == len(want) and len(found.scanned) == rounds + 1
    assert [centroids.centroid_digest(c) for c in found.centroids] == [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middles]


def test_few_vectors_are_measured_again(spark):
    """Of vectors in groups far apart, only those near a border are ambiguous after the first round."""
    rows = blobs(1_800, 8, 40)
    found = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 12, 8, 8)
    assert found.scanned[0] == 1_800 and found.scanned[-1] < 900


def test_small_tables(spark):
    rows = [(1, [0.5, -0.5]), (2, None), (3, [4.0, 4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = centroids.cluster(table, 16, 3, 2)
    assert len(found.centroids) == 2 and sorted(r["distance"] for r in found.assigned.collect()) == [0, 0]
    none = centroids.cluster(table.limit(0), 16, 3, 2)
    assert none.assigned.collect() == [] and none.inertias.tolist() == []
    with pytest.raises(Exception, match="no exact squared distance"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), 2, 1, 2)


def test_bounds_hold_and_tighten():
    """No point of a sphere comes nearer to a moved centroid than its bound says; most bounds are below the full drift."""
    rnd = np.random.default_rng(7)
    tighter = total = 0
    for _ in range(60):
        k, size = int(rnd.integers(2, 7)), int(rnd.integers(2, 5))
        old = rnd.integers(-100, 100, (k, size))
        new = old + rnd.integers(-30, 30, (k, size))
        radius = rnd.uniform(0, 80, k)
        lowered = centroids.loosening(old, new, radius)
        for a in range(k):
            others = [j for j in range(k) if j != a]
            way = rnd.normal(0, 1, (500, size))
            points = old[a] + way / np.linalg.norm(way, axis=1)[:, None] * radius[a] * rnd.uniform(0, 1, 500)[:, None] ** 0.1
            shrunk = [np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1) for j in others]
            assert np.max(shrunk) <= lowered[a]
            full = max(np.linalg.norm(new[j] - old[j]) for j in others)
            assert lowered[a] <= full * (1 + 1e-8) + 1e-6
            tighter += lowered[a] < 0.99 * full
            total += 1
    assert tighter > total / 4
