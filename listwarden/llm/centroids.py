"""Centroid clustering in whole numbers, filtered by leading coordinates of a rotation.

Vectors become whole numbers once (floor of SCALE times each component). Centroids are whole
numbers too: in every round each vector goes to the nearest centroid (squared Euclidean distance,
ties to the smaller number), and every centroid with vectors becomes the floor of their mean.

Few centroids are compared in full. The covariance of all vectors, summed up by Spark, gives a
rotation onto its principal axes. Each vector is stored with its LEADING first rotated coordinates
and the norm of the rest. For a vector and a centroid, the squared distance of the leading
coordinates plus the squared difference of the two norms is a lower bound of their squared
distance (the reverse triangle inequality in the remaining axes). A centroid whose bound, less a
margin for rounding, is above the best distance found so far is out; the survivors are compared
in whole numbers. So rotation and rounding decide what is compared, never what is nearest.

Every round is one pass over the stored vectors. A task returns one row of sums for each centroid,
and the driver sees one for each centroid and component, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwarden.llm.storage import stored

SCALE, DIMENSIONS, CENTROIDS, ROUNDS, LEADING, SEED = 1024, 64, 8, 10, 16, 3
#: Vectors worked on at a time.
SLICE_ROWS = 16_384
#: Up to this size, squares of differences of 64 components add up within 64 bits.
_NARROW = 1 << 27


class Rotation(NamedTuple):
    mean: np.ndarray
    axes: np.ndarray  # rows: principal axes, widest spread first


class Clustering(NamedTuple):
    vectors: DataFrame  # vec_id, cluster, distance
    centroids: list[list[int]]
    sizes: list[int]
    inertias: list[int]  # distance summed over each cluster


def whole_numbers(vectors: DataFrame, scale: int = SCALE, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and point: floor(scale * x) of each component, of vectors that can be clustered.

    Those are the ones of exactly `dimensions` components, none of them null or not finite. A
    component of 2^63 or more after scaling raises.
    """
    e = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = vectors.filter(e.isNotNull() & (F.size(e) == dimensions) & F.coalesce(F.forall(e, finite), F.lit(False)))
    scaled = lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("decimal(38,0)").cast("long")
    limit = float(1 << 63)
    fits = F.forall(e, lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < limit)
    checked = F.when(fits, F.transform(e, scaled)).otherwise(F.raise_error(F.lit("a scaled component is beyond 64 bits")).cast("array<long>"))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("point"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def rotation(points: DataFrame, dimensions: int) -> Rotation:
    """Principal axes of all points: one row of sums from each task, summed up by Spark."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares, n = np.zeros(dimensions), np.zeros((dimensions, dimensions)), 0
        for batch in batches:
            x = _matrix(batch.column(0), dimensions).astype(float)
            total += x.sum(axis=0)
            squares += x.T @ x
            n += len(x)
        if n:
            sums = np.concatenate([[n], total, squares.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["place", "value"])

    rows = points.select("point").mapInArrow(moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    found = {r.place: r.value for r in rows.collect()}  # 1 + dimensions + dimensions^2 rows
    if not found:
        return Rotation(np.zeros(dimensions), np.eye(dimensions))
    sums = np.array([found[i] for i in range(len(found))])
    mean = sums[1 : dimensions + 1] / sums[0]
    spread = sums[dimensions + 1 :].reshape(dimensions, dimensions) / sums[0] - np.outer(mean, mean)
    if not np.isfinite(spread).all():
        return Rotation(np.zeros(dimensions), np.eye(dimensions))  # any rotation is right, this one filters less
    return Rotation(mean, np.linalg.eigh(spread)[1].T[::-1])


def _shortened(x: np.ndarray, turn: Rotation, leading: int) -> np.ndarray:
    """Leading rotated coordinates, and the norm of the others, of each row."""
    turned = (x.astype(float) - turn.mean) @ turn.axes.T
    return np.column_stack([turned[:, :leading], np.linalg.norm(turned[:, leading:], axis=1)])


def described(points: DataFrame, turn: Rotation, dimensions: int, leading: int) -> DataFrame:
    """points with `short`: leading rotated coordinates and the norm of the rest, in single precision."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = _shortened(_matrix(batch.column("point"), dimensions), turn, leading)
            width = short.shape[1]
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * width)
            with np.errstate(over="ignore"):
                flat = pa.array(short.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, flat)], names=[*batch.schema.names, "short"])

    return points.mapInArrow(work, "vec_id long, point array<long>, short array<float>")


def nearest(points: np.ndarray, short: np.ndarray, centroids: np.ndarray, short_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each point, the squared distance, and how many were compared in full.

    Distances beyond 64 bits are compared as they are, and returned as the largest number.
    """
    n = len(points)
    best, number = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    if not n:
        return number, best, 0
    wide = np.abs(points).max(axis=1) > (_NARROW if np.abs(centroids).max() <= _NARROW else -1)
    for i in np.flatnonzero(wide):
        each = [sum((int(x) - int(c)) ** 2 for x, c in zip(points[i], row, strict=True)) for row in centroids]
        number[i] = each.index(min(each))
        best[i] = min(*each, np.iinfo(np.int64).max)
    # rounding moves a described point by no more than this
    size = np.linalg.norm(short, axis=1)[:, None] + np.linalg.norm(short_centroids, axis=1)[None, :]
    bound = np.stack([np.linalg.norm(short - c, axis=1) for c in short_centroids], axis=1)
    bound = np.maximum(bound - 1e-6 * size - 1e-6, 0.0) ** 2
    first = bound.argmin(axis=1)
    compared = int(wide.sum()) * len(centroids)
    for turn in (0, 1):
        for j in range(len(centroids)):
            todo = np.flatnonzero(~wide & (first == j if turn == 0 else (first != j) & (bound[:, j] <= best)))
            compared += len(todo)
            difference = points[todo] - centroids[j]
            distance = np.einsum("ij,ij->i", difference, difference)
            closer = (distance < best[todo]) | ((distance == best[todo]) & (j < number[todo]))
            best[todo[closer]], number[todo[closer]] = distance[closer], j
    return number, best, compared


def _assigned(rows: DataFrame, centroids: Sequence[Sequence[int]], turn: Rotation, leading: int, sums: bool) -> DataFrame:
    """Rows (vec_id, cluster, distance); with sums instead one row per task, cluster and component."""
    at = np.array(centroids, np.int64)
    short_at = _shortened(at, turn, leading)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = at.shape[1]
        total = [[0] * (width + 1) for _ in at]
        for batch in batches:
            for start in range(0, len(batch), SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                points = _matrix(part.column("point"), width)
                number, distance, _ = nearest(points, _matrix(part.column("short"), short_at.shape[1]).astype(float), at, short_at)
                if not sums:
                    if distance.max() == np.iinfo(np.int64).max:
                        raise OverflowError("a squared distance is beyond 64 bits")
                    yield pa.RecordBatch.from_arrays(
                        [part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])
                    continue
                exact = points if np.abs(points).max() <= _NARROW else points.astype(object)
                for j in np.unique(number):
                    mine = exact[number == j]
                    for i, value in enumerate([len(mine), *mine.sum(axis=0)]):
                        total[j][i] += int(value)
        if sums:
            cells = [(j, i, str(v)) for j, row in enumerate(total) if row[0] for i, v in enumerate(row)]
            j, i, v = zip(*cells, strict=True) if cells else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(j, pa.int32()), pa.array(i, pa.int32()), pa.array(v, pa.string())], names=["cluster", "place", "value"])

    schema = "cluster int, place int, value string" if sums else "vec_id long, cluster int, distance long"
    return rows.select("vec_id", "point", "short").mapInArrow(work, schema)


def first_centroids(points: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k points of smallest SHA-256 of `seed:vec_id`; rows of one id follow by their components."""
    named = points.filter("vec_id IS NOT NULL").select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "point")
    return [list(r.point) for r in named.orderBy("hash", "point").limit(k).collect()]  # k rows


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE,
            dimensions: int = DIMENSIONS, leading: int = LEADING, seed: int = SEED) -> Clustering:
    """Clusters of the rows of vectors (vec_id, embedding) that `whole_numbers` takes.

    Repeated rows count as often as they occur. Rows with a null vec_id are clustered, but no first
    centroid. With fewer than k vectors there are fewer centroids; without any, all results are
    empty. Empty centroids stay where they are. A final squared distance beyond 64 bits raises.
    Other columns are ignored.
    """
    points = whole_numbers(vectors.select("vec_id", "embedding"), scale, dimensions)
    centroids = first_centroids(points, k, seed)
    if not centroids:
        empty = points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter(F.lit(False))
        return Clustering(empty, [], [], [])
    turn = rotation(points, dimensions)
    rows = stored(described(points, turn, dimensions, leading))
    for _ in range(rounds):
        sums = _assigned(rows, centroids, turn, leading, sums=True).groupBy("cluster", "place").agg(
            F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        found = {(r.cluster, r.place): int(r.value) for r in sums.collect()}  # k * (dimensions + 1) rows
        moved = [
            [found[j, i + 1] // found[j, 0] for i in range(dimensions)] if (j, 0) in found else old
            for j, old in enumerate(centroids)]
        if moved == centroids:
            break  # nothing would move in the rounds to come
        centroids = moved
    assigned = stored(_assigned(rows, centroids, turn, leading, sums=False))
    totals = {r.cluster: (r.n, int(r.total)) for r in assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    sizes = [totals.get(j, (0, 0))[0] for j in range(len(centroids))]
    return Clustering(assigned, centroids, sizes, [totals.get(j, (0, 0))[1] for j in range(len(centroids))])


def report(found: Clustering) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = found.vectors
    if not found.centroids:
        zero = F.lit(0).cast("long")
        return rows.select("*", zero.alias("cluster_inertia"), zero.alias("inertia"), F.lit("").alias("centroid_sha256"))
    by_cluster = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    return rows.select(
        "*", by_cluster(found.inertias).cast("long").alias("cluster_inertia"),
        F.lit(sum(found.inertias)).cast("long").alias("inertia"), by_cluster(digests).alias("centroid_sha256"))
