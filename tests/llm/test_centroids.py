"""Centroid clustering against a plain version in Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from listwarden.llm import centroids
from listwarden.llm.queries import importable

SCHEMA = "vec_id long, embedding array<double>, point string, cluster int"


def plain(rows, k, rounds, width):
    points = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
              if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), p) for i, p in points if i is not None)
    at = [p for _, p in named[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        groups = {}
        for _, p in points:
            groups.setdefault(nearest(p)[1], []).append(p)
        at = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(at)]
    return at, sorted(((i, *nearest(p)[::-1]) for i, p in points), key=repr)


@pytest.fixture
def check(spark):
    importable(spark)

    def run(rows, k=8, rounds=10, width=64):
        frame = spark.createDataFrame([(i, v, "p", 1) for i, v in rows], SCHEMA)
        found = centroids.cluster(frame, k, rounds, dimensions=width, leading=min(16, width))
        at, want = plain(rows, k, rounds, width)
        got = centroids.report(found).collect()
        assert found.centroids == at
        assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == want
        assert all(r.inertia == sum(d for _, _, d in want) for r in got)
        assert all(r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster) for r in got)
        assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, at[r.cluster])).encode()).hexdigest() for r in got)
    return run


def test_clusters(check):
    r = np.random.default_rng(1)
    middles = r.normal(size=(5, 64)) * 3
    rows = [(i, (middles[i % 5] + r.normal(size=64)).tolist()) for i in range(120)]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(60)]  # a third is one vector
    rows += [(7, same), (8, None), (9, []), (10, same[:63]), (11, [None, *same[1:]]), (12, [math.nan, *same[1:]]),
             (13, [math.inf, *same[1:]]), (None, rows[3][1]), (14, [0.0] * 64), (15, [-1e6, *same[1:]])]
    check(rows)


def test_ties_and_few_vectors(check):
    grid = [(i, [float(i % 3), float(i // 3 % 3), -0.5]) for i in range(27)]
    check(grid, k=4, rounds=3, width=3)
    check(grid[:2], k=4, rounds=3, width=3)
    check([], width=3)


def test_beyond_64_bits(spark):
    importable(spark)
    frame = spark.createDataFrame([(1, [1e300, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        centroids.cluster(frame, dimensions=2)


def test_filter_loses_nothing_and_spares_work():
    r = np.random.default_rng(2)
    at = (r.normal(size=(32, 64)) * 3000).astype(np.int64)
    points = at[r.integers(0, 32, 4000)] + (r.normal(size=(4000, 64)) * 300).astype(np.int64)
    spread = np.cov(points.T)
    turn = centroids.Rotation(points.mean(axis=0), np.linalg.eigh(spread)[1].T[::-1])
    short = centroids._shortened(points, turn, 16).astype(np.float32).astype(float)
    number, best, compared = centroids.nearest(points, short, at, centroids._shortened(at, turn, 16))
    full = ((points[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
    assert (number == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert compared < 2 * len(points)  # of 32 * len(points)
