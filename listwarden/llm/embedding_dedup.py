"""Near duplicates among embeddings: a pivot-permutation index, then exact verification.

Pivots are a bounded sample of the vectors. Every vector is described by its NEAREST nearest
pivots. Near vectors see the pivots in nearly the same order, so they share most of those. The
inverted lists are kept per pair of pivots: two vectors meet in a list if they share at least two.
All vectors of one list are compared by cosine in double precision, in blocks inside tasks; a pair
that meets in several lists is counted in the first of them only (smallest two shared pivots).

Equal vectors of one label are one entry with a count from the start. A list is dealt into blocks
of about BLOCK vectors, so a dense group is spread over many tasks and no row is made for a pair;
each task returns one row per linked vector: how many links, and one vector it is connected with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwarden.llm.links import components
from listwarden.llm.storage import stored

THRESHOLD = 0.98
#: Sampled pivots of each vector length, nearest pivots kept, vectors of a block.
PIVOTS, NEAREST, BLOCK = 128, 7, 512
#: Vector lengths that get pivots, each by a job of its own; vectors of further ones are compared in full.
INDEXED = 64


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link: label and vector without nulls, all components finite, not all zero."""
    e = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.forall(e, finite) & F.exists(e, lambda x: x != 0))


def pivots(vectors: DataFrame, most: int = PIVOTS) -> dict[int, np.ndarray]:
    """Per vector length, unit vectors of `most` pivots; of the INDEXED most frequent lengths.

    Vectors of other lengths have no pivots; all of one label and length share one list.

    They are picked from the 4 * `most` rows of smallest hash, each the one farthest from those
    before, so that a dense group does not fill them: its order of nearest pivots would be random.
    """
    hashed = vectors.select("embedding", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("hash"))
    sizes = hashed.groupBy("dim").agg(F.countDistinct("hash").alias("n")).orderBy(F.desc("n"), "dim").limit(INDEXED).collect()
    out = {}
    for row in sizes:
        sample = hashed.filter(F.col("dim") == row.dim).dropDuplicates(["hash"]).orderBy("hash").limit(4 * most).collect()
        out[row.dim] = _apart(_unit(np.array([r.embedding for r in sample], np.float64)), most)
    return out


def _apart(points: np.ndarray, most: int) -> np.ndarray:
    chosen = [0]
    nearest = points @ points[0]
    while len(chosen) < min(most, len(points)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    return points[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(points: np.ndarray) -> np.ndarray:
    points = points / np.abs(points).max(axis=1, keepdims=True)  # no overflow of squares
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def describe(vectors: DataFrame, points: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, label, n, embedding and near: the ordered nearest pivots of the vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(points)  # PIVOTS vectors of each length

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near: list[list[int]] = [[]] * len(batch)
            dims = np.array(batch.column("embedding").value_lengths())
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own = shared.value.get(int(dim))
                if own is not None:
                    order = np.argsort(-(_unit(_matrix(batch.column("embedding").take(pa.array(at)))) @ own.T), axis=1, kind="stable")
                    for i, row in zip(at, order[:, :NEAREST], strict=True):
                        near[i] = row.tolist()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("vec_id", "label", "n", "embedding")], pa.array(near, pa.list_(pa.int32()))],
                names=["vec_id", "label", "n", "embedding", "near"])

    element = vectors.schema["embedding"].dataType.simpleString()
    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "n", "embedding").mapInArrow(
        work, f"vec_id long, label {label}, n long, embedding {element}, near array<int>")


def _link_blocks(rows: pa.Table) -> pa.Table:
    p, q, low, high = (rows.column(c)[0].as_py() for c in ("p", "q", "low", "high"))
    ids, copies, block = (rows.column(c).to_numpy() for c in ("vec_id", "n", "block"))
    points = _unit(_matrix(rows.column("embedding").combine_chunks()))
    linked = points @ points.T >= THRESHOLD
    np.fill_diagonal(linked, False)
    if low < high:
        linked &= block[:, None] != block[None, :]
    if p < q:  # else the list of all vectors of a length without pivots
        near = _matrix(rows.column("near").combine_chunks()).astype(np.int64)
        sees = np.zeros((len(rows), q + 1), np.float32)
        who, what = np.nonzero(near < q)
        sees[who, near[who, what]] = 1
        linked &= (sees @ sees.T) == 1  # of the pivots below q they share p alone: their first list
    links = (linked * copies[None, :]).sum(axis=1)
    label = ids.copy()
    while True:
        low_label = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low_label == label).all():
            break
        label = low_label
    found = links > 0
    return pa.table({"a": pa.array(ids[found]), "b": pa.array(label[found]), "links": pa.array(links[found].astype(np.int64))})


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors of equal label and length link if their cosine is THRESHOLD or more. Rows with a null
    label or id, or a vector that is null, empty, zero or not finite throughout, have no links and
    are components of their own. Rows of equal vectors link with each other. vec_id identifies a
    vector. Other columns are ignored; an empty table gives an empty one.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    good = usable(base).withColumn("hash", F.xxhash64("embedding"))
    classes = stored(good.groupBy("label", "hash", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    described = stored(describe(classes.withColumnRenamed("rep", "vec_id"), pivots(classes)))
    pairs = F.expr(
        "if(size(near) = 0, array(named_struct('p', -1, 'q', -1)),"
        " flatten(transform(near, p -> transform(filter(near, q -> q > p), q -> named_struct('p', p, 'q', q)))))")
    lists = described.withColumn("key", F.explode(pairs)).select("label", F.size("embedding").alias("dim"), "key.p", "key.q", "vec_id")
    sizes = lists.groupBy("label", "dim", "p", "q").agg(F.count("*").alias("size")).filter("size > 1")
    placed = lists.join(sizes, ["label", "dim", "p", "q"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = placed.join(described.select("vec_id", "n", "embedding", "near"), "vec_id").select(
        "label", "dim", "p", "q", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "vec_id", "n", "embedding", "near")
    found = stored(dealt.groupBy("label", "dim", "p", "q", "low", "high").applyInArrow(_link_blocks, "a long, b long, links long"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = components(found).select(F.col("id").alias("rep"), "label")
    known = classes.join(links, "rep", "left").join(named.withColumnRenamed("label", "component"), "rep", "left")
    known = known.select(
        F.col("rep"), "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component_id"))
    members = good.join(classes.select("label", "hash", "embedding", "rep"), ["label", "hash", "embedding"]).select("vec_id", "rep")
    rows = base.select("vec_id").join(members, "vec_id", "left").join(known, "rep", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select(
        "vec_id", F.coalesce(F.col("n") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
