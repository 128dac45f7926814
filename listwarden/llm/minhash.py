"""Near-duplicate detection: BagMinHash signatures of word shingles, bands, verification.

A text is the multiset of its shingles of five consecutive words; texts of one to four words are
one shingle, texts without words link with nothing. Two texts are near duplicates if the weighted
Jaccard similarity (sum of minima by sum of maxima of the multiplicities) is 0.8 or more.

BagMinHash: every shingle owns a Poisson process of points (time, component, height). Heights are
discretised at the whole numbers, split into the intervals [0,1), [1,2), [2,4), [4,8), ... each the
root of a binary tree of halves: hash bits send a point down to one leaf. A point counts for a text
if its leaf lies below the multiplicity; a component of the signature is the first time of a point
that counts. Two texts agree in a component with the probability of their weighted Jaccard
similarity. Points are made in order of time, and a process stops once it is later than the
latest component of its text, so about one point per shingle is made besides those needed.

BANDS bands of ROWS components: texts of similarity 0.8 share a band with probability
1 - (1 - 0.8^5)^25 > 0.9999.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwarden.llm.links import components
from listwarden.llm.skew import lookup
from listwarden.llm.storage import stored
from listwarden.llm.words import mix, ngrams, signed, slices, split_words

SHINGLE, BANDS, ROWS = 5, 25, 5
#: Documents of a block of a bucket.
BLOCK = 64
_U = np.uint64
#: Odd multipliers that tell hash streams apart.
_STEP, _STRIP, _PLACE, _HEIGHT = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03), _U(0x8CB92BA72F3D8DD7), _U(0xAEF17502108EF2D9)


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text, hash, multiplicity), sorted by text and hash."""
    w = split_words(texts)
    n_words = np.diff(w.first)
    grams = ngrams(w.hashes, SHINGLE)
    n_grams = np.maximum(n_words - SHINGLE + 1, 0)
    owner = np.repeat(np.arange(len(n_words)), n_grams)
    starts = np.repeat(w.first[:-1], n_grams) + np.arange(len(owner)) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams)
    hashes = grams[starts] if len(owner) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        whole = [ngrams(w.hashes[w.first[i] : w.first[i + 1]], int(n_words[i]), seed=int(n_words[i]))[0] for i in short]
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, np.array(whole, np.uint64)])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner)))


def signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int, m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures: one row of m first times per text; infinite without shingles."""
    strips = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64), 0) + 1
    element = np.repeat(np.arange(len(owner)), strips)
    strip = np.arange(len(element)) - np.repeat(np.cumsum(strips) - strips, strips)
    low = np.where(strip > 0, 1 << np.maximum(strip - 1, 0), 0)
    width = np.maximum(low, 1)
    doc, below = owner[element], weights[element] - low  # heights of the interval that count
    seed = mix(hashes[element] + strip.astype(_U) * _STRIP)
    time = np.zeros(len(element))
    first = np.full(texts * m, np.inf)
    latest = np.full(texts, np.inf)
    while len(doc):
        seed = seed + _STEP
        bits = mix(seed)
        time = time - np.log1p(-(bits >> _U(11)).astype(float) * 2.0**-53) / (m * width)
        on = time < latest[doc]
        doc, below, width, seed, time, bits = doc[on], below[on], width[on], seed[on], time[on], bits[on]
        counts = np.ones(len(doc), bool)
        wide = np.flatnonzero(width > 1)
        if len(wide):
            counts[wide] = (mix(bits[wide] * _HEIGHT) & (width[wide] - 1).astype(_U)).astype(np.int64) < below[wide]
        place = doc * m + (mix(bits * _PLACE) % _U(m)).astype(np.int64)
        np.minimum.at(first, place[counts], time[counts])
        live = np.unique(doc)
        latest[live] = first.reshape(texts, m)[live].max(axis=1)
    return first.reshape(texts, m)


def _sums(owner: np.ndarray, values: np.ndarray, texts: int) -> np.ndarray:
    out = np.zeros(texts, values.dtype)
    if len(owner):
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[at]] = np.add.reduceat(values, at)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            owner, hashes, weights = bags(part.column("text"))
            n = len(part)
            size = _sums(owner, weights.astype(np.int64), n)
            own = mix(hashes + weights.astype(_U) * _HEIGHT)
            times = signatures(owner, hashes, weights, n).reshape(n, BANDS, ROWS)
            bands = np.zeros((n, BANDS), np.uint64)
            for i in range(ROWS):
                bands = mix(bands + times[:, :, i].copy().view(np.uint64) * _STEP)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(signed(_sums(owner, own, n))),
                    pa.array(signed(_sums(owner, mix(own ^ _PLACE), n))), pa.array(size),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(signed(bands.ravel()))),
                ],
                names=["doc_id", "bag_a", "bag_b", "size", "bands"],
            )


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of the smaller multiplicities of two sorted bags (hashes, multiplicities)."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int(np.minimum(a[1][x], b[1][y]).sum())


def _per_text(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    owner, hashes, weights = bags(texts)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(hashes[i:j], weights[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text_b"):
            close = []
            for x, y in zip(_per_text(part.column("text_a")), _per_text(part.column("text_b")), strict=True):
                shared = overlap(x, y)
                close.append(5 * shared >= 4 * int(x[1].sum() + y[1].sum() - shared) and shared > 0)
            keep = pa.array(close, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts have a weighted Jaccard similarity of 0.8 or more."""
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, copy_of, class_id, kept.

    copy_of is the smallest doc_id with the same multiset of shingles, class_id the smallest one
    that links of near duplicates reach, kept whether the row is that document. Null or empty
    texts, and rows with a null doc_id, are classes of their own. Rows of one doc_id count as one
    document. Columns other than doc_id and text are ignored; an empty table gives an empty one.

    Documents with equal multisets are one class from the start, so copies are never compared.
    In a bucket of a band every document is compared with the smallest one of the bucket only;
    after that, buckets that these links have not joined into one component are compared in full, in
    blocks inside tasks, so no link between different texts is lost and no row is made for a pair.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = docs.mapInArrow(
        _describe, "doc_id long, bag_a long, bag_b long, size long, bands array<long>")
    signed_docs = stored(described)
    filled = signed_docs.filter("size > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("bag_a", "bag_b").agg(F.min("doc_id").alias("copy_of"))
    members = stored(lookup(filled, classes, ["bag_a", "bag_b"]).select("doc_id", "copy_of", "size", "bands"))
    buckets = members.filter("doc_id = copy_of").select(
        "doc_id", "size", F.posexplode("bands").alias("band", "value"))
    leaders = buckets.groupBy("band", "value").agg(F.min(F.struct("doc_id", "size")).alias("leader"), F.count("*").alias("n")).filter("n > 1")
    leaders = stored(leaders)
    similar = "5 * least(size, leader.size) >= 4 * greatest(size, leader.size)"  # else below 0.8
    stars = stored(
        lookup(buckets, leaders, ["band", "value"]).filter(f"doc_id <> leader.doc_id AND {similar}")
        .select(F.col("doc_id").alias("a"), F.col("leader.doc_id").alias("b")).distinct())
    texts = stored(_texts_of(stars.select(F.explode(F.array("a", "b")).alias("doc_id")), docs))
    links = stored(_verified(stars, texts))
    labels = components(links)

    # buckets that the stars left in several components
    crowded = lookup(buckets, leaders.select("band", "value", "n"), ["band", "value"]).join(labels, F.col("doc_id") == F.col("id"), "left")
    crowded = crowded.select("band", "value", "n", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    mixed = crowded.groupBy("band", "value").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    apart = stored(crowded.join(mixed.select("band", "value"), ["band", "value"]))
    if not apart.isEmpty():
        more = stored(_linked_in_blocks(apart, members, docs))
        if not more.isEmpty():
            labels = components(links.union(more))
    named = members.select("doc_id", "copy_of").join(labels, F.col("copy_of") == F.col("id"), "left").select(
        "doc_id", "copy_of", F.coalesce("label", "copy_of").alias("class_id"))
    alone = signed_docs.filter("size = 0 OR doc_id IS NULL").select(
        "doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"))
    return named.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").join(ids.distinct().hint("merge"), "doc_id", "left_semi")


def _linked_in_blocks(apart: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components that share a bucket: rows (a, b), a forest for each pair of blocks.

    A bucket is dealt into blocks of about BLOCK documents; a task compares two blocks, so no row is
    made for a pair and no task holds a bucket. A pair is compared in the first band it shares only.
    """
    ids = apart.select("doc_id")
    wide = apart.join(members.filter("doc_id = copy_of").select("doc_id", "bands"), "doc_id").join(_texts_of(ids, docs), "doc_id")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    dealt = wide.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(
        "band", "value", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "doc_id", "label", "bands", "text")
    return dealt.groupBy("band", "value", "low", "high").applyInArrow(_link_blocks, "a long, b long")


def _link_blocks(rows: pa.Table) -> pa.Table:
    band, low, high = (rows.column(c)[0].as_py() for c in ("band", "low", "high"))
    ids, labels, block = (rows.column(c).to_numpy() for c in ("doc_id", "label", "block"))
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rows), BANDS)[:, :band]
    owner, hashes, weights = bags(rows.column("text").combine_chunks())
    shared = _shared(owner, hashes, weights, len(rows))
    size = _sums(owner, weights.astype(np.int64), len(rows))
    near = 5 * shared >= 4 * (size[:, None] + size[None, :] - shared)
    near &= np.tri(len(rows), k=-1, dtype=bool)
    if low < high:
        near &= block[:, None] != block[None, :]
    parent = {int(x): int(x) for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        if (bands[i] == bands[j]).any():
            continue
        x, y = root(int(labels[i])), root(int(labels[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(ids[i]), int(ids[j])))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _shared(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int) -> np.ndarray:
    """Sums of smaller multiplicities for all pairs of a few texts."""
    copies = np.repeat(np.arange(len(owner)), weights)
    turn = np.arange(len(copies)) - np.repeat(np.cumsum(weights) - weights, weights)
    _, key, seen = np.unique(mix(hashes[copies] + turn.astype(_U) * _STEP), return_inverse=True, return_counts=True)
    common = seen[key] > 1  # what only one text has is shared with none
    _, key = np.unique(key[common], return_inverse=True)
    who = owner[copies][common]
    out = np.zeros((texts, texts), np.int64)
    for start in range(0, int(key.max()) + 1 if len(key) else 0, 20_000):
        part = (key >= start) & (key < start + 20_000)
        table = np.zeros((texts, 20_000), np.float32)
        table[who[part], key[part] - start] = 1
        out += np.rint(table @ table.T).astype(np.int64)
    return out


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each class, with the columns of docs."""
    gone = stored(near_duplicates(docs).filter("NOT kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
