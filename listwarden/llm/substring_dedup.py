"""Removal of repeated passages: a compacted De Bruijn graph of word k-mers.

Every window of EDGE words is an edge of the graph, from its first EDGE - 1 words to its last. An
edge is repeated if it starts in two documents. Instead of single edges, paths travel: consecutive
edges of a document that share a minimizer (their smallest hash of MARK words) are one path, named
by the hash of all its words. Equal passages are cut into the same paths wherever they occur, so:

1. Paths meet at their minimizer (a Spark shuffle, sorted by document). Where all paths of a
   minimizer are one and the same, it does not branch: the whole path is known from its source, the
   smallest document and position, and every later occurrence whose words have the same digest
   is a copy from start to end.
2. Where different paths share a minimizer, the graph may branch there. Only these paths are taken
   apart into edges, joined by edge in the same way.
3. A copy has the coordinates of its source. Copies that follow each other in both documents are one
   long span; the words of both its ends, looked up by their coordinates, must have the same SHA-256.
   If two do not, hashes of different words were equal, and all is done again with another seed.
4. Copied spans are removed.

Copies within one batch of rows are settled before the shuffle, so a passage that a third of all
documents hold sends one row per batch. Texts travel compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwarden.llm.storage import stored
from listwarden.llm.words import Words, mix, ngrams, signed, slices, spans, split_words

EDGE, MARK = 13, 7
_U = np.uint64
ROW = "key long, path long, doc_id long, at int, edges int, kind int, source long, source_at int"
#: Seeds tried; a second one is needed about once in 2^64 pairs of different spans.
SEEDS = 4
#: Words of a span that is verified at once.
ASKED = 256
#: What a row is. FIRST may have copies, COPY is one, APART is to be taken apart.
FIRST, COPY, APART = 0, 1, 2


def _paths(w: Words, documents: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Paths of every text: minimizer, digest of the words, document, first word, edges."""
    n_words = np.diff(w.first)
    n_edges = np.maximum(n_words - EDGE + 1, 0)
    owner = np.repeat(np.arange(len(n_words)), n_edges)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(n_edges) - n_edges, n_edges) + w.first[:-1][owner]
    marks = ngrams(w.hashes, MARK, seed)
    least, place = marks[start], start.copy()
    for i in range(1, EDGE - MARK + 1):
        other = marks[start + i]
        smaller = other < least
        least[smaller] = other[smaller]
        place[smaller] = start[smaller] + i
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
    at = np.flatnonzero(new)
    edges = np.diff(np.append(at, len(owner)))
    begin, end = start[at], start[at] + edges + EDGE - 1
    digest = spans(w.hashes, begin, end - begin, seed + 1)
    owner = owner[at]
    return {"key": signed(least[at]), "path": signed(digest), "doc_id": documents[owner], "at": begin - w.first[owner], "edges": edges}


def _settle(p: dict[str, np.ndarray]) -> None:
    """Adds FIRST or COPY, whether the same path starts in a smaller document of these rows, and where."""
    order = np.lexsort((p["at"], p["doc_id"], p["path"], p["key"]))
    key, path, doc = p["key"][order], p["path"][order], p["doc_id"][order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (path[1:] != path[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    copy = doc > doc[head]
    p["kind"], p["source"], p["source_at"] = (np.zeros(len(order), t) for t in (np.int32, np.int64, np.int32))
    p["kind"][order] = np.where(copy, COPY, FIRST)
    p["source"][order] = np.where(copy, doc[head], 0)
    p["source_at"][order] = np.where(copy, p["at"][order][head], 0)


def _batch(p: dict[str, np.ndarray]) -> pa.RecordBatch:
    # a copy needs no meeting: any key will do, one that spreads
    p = p | {"key": np.where(p["kind"] == COPY, signed(mix(p["path"].view(_U) ^ p["doc_id"].view(_U))), p["key"])}
    narrow = {"at", "edges", "source_at"}
    return pa.RecordBatch.from_arrays([pa.array(p[c].astype(np.int32) if c in narrow else p[c]) for c in _COLUMNS], names=_COLUMNS)


_COLUMNS = [field.split()[0] for field in ROW.split(", ")]


def _path_finder(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 3_000_000):
                p = _paths(split_words(part.column("text")), part.column("doc_id").to_numpy(), seed)
                _settle(p)
                yield _batch(p)

    return find


def _resolver(take_apart: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stream over rows sorted by key, document and place: copies, and paths to be taken apart.

    Keeps the first row of the current key only. Without take_apart, rows of one key are all equal.
    """
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, told = None, True  # the first row of the key, and whether it was handed on
        for batch in batches:
            if not len(batch):
                continue
            names = batch.schema.names
            p = {c: batch.column(c).to_numpy() for c in names}
            if first is not None:
                p = {c: np.concatenate([[first[c]], p[c]]).astype(p[c].dtype) for c in names}
            key, n = p["key"], len(p["key"])
            new = np.ones(n, bool)
            new[1:] = key[1:] != key[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            kind = np.where(p["doc_id"] > p["doc_id"][head], COPY, FIRST)
            if take_apart:
                kind = np.where(p["path"] != p["path"][head], APART, kind)
                kind[np.unique(head[kind == APART])] = APART
            here = (kind == COPY) & (p["kind"] != COPY)  # else settled before
            p["source"] = np.where(here, p["doc_id"][head], p["source"])
            p["source_at"] = np.where(here, p["at"][head], p["source_at"])
            kind = np.where(p["kind"] == COPY, COPY, kind)
            out = kind != FIRST
            last_head = int(head[-1])
            if first is not None:
                out[0] = kind[0] == APART and not told
            told = bool(kind[last_head] == APART) or (told and last_head == 0 and first is not None)
            first = {c: p[c][last_head] for c in names}
            p = {c: x[out] for c, x in p.items()}
            p["kind"] = kind[out].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(p[c]) for c in names], names=names)

    return resolve


def _resolved(rows: DataFrame, take_apart: bool) -> DataFrame:
    near = rows.repartition("key").sortWithinPartitions("key", "kind", "doc_id", "at") if not take_apart else (
        rows.repartition("key").sortWithinPartitions("key", "doc_id", "at"))
    return near.mapInArrow(_resolver(take_apart), ROW)


def _opened(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Rows of packed texts, with the words of as many as have this many bytes (or of one text)."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        packed, at = batch.column("packed"), 0
        while at < len(batch):
            texts, size, stop = [], 0, at
            while stop < len(batch) and size < most:
                texts.append(unpack.decompress(packed[stop].as_py()).decode())
                size, stop = size + len(texts[-1]), stop + 1
            yield batch.slice(at, stop - at), split_words(pa.array(texts, pa.string()))
            at = stop


def _taker_apart(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges of the paths of each document, as paths of one edge; key is the edge and the minimizer."""
    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in _opened(batches):
            edges = ngrams(w.hashes, EDGE, seed)
            spans_ = batch.column("spans")
            row = np.repeat(np.arange(len(batch)), np.array(spans_.value_lengths()))
            flat = spans_.flatten()
            at, n, key = (flat.field(c).to_numpy() for c in ("at", "edges", "key"))
            each = np.repeat(np.arange(len(at)), n)
            place = at[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            edge = edges[w.first[:-1][row[each]] + place]
            p = {
                "key": signed(mix(edge ^ mix(key[each].view(_U)))), "path": np.zeros(len(each), np.int64),
                "doc_id": batch.column("doc_id").to_numpy()[row[each]], "at": place, "edges": np.ones(len(each), np.int32),
            }
            _settle(p)
            yield _batch(p)

    return take_apart


def _long_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: copies that follow each other in it and in their source, as one span of words.

    Spans are cut at fixed places of the source, so that a source with very many different copies is
    asked for no more than about two spans for each of its words.
    """
    for batch in batches:
        copies = batch.column("copies")
        row = np.repeat(np.arange(len(batch)), np.array(copies.value_lengths()))
        flat = copies.flatten()
        at, edges, source, source_at = (flat.field(c).to_numpy().astype(np.int64) for c in ("at", "edges", "source", "source_at"))
        order = np.lexsort((at, source_at - at, source, row))
        row, at, edges, source, source_at = (x[order] for x in (row, at, edges, source, source_at))
        end = at + edges + EDGE - 1
        same = np.zeros(len(row), bool)
        same[1:] = (row[1:] == row[:-1]) & (source[1:] == source[:-1]) & (source_at[1:] - at[1:] == source_at[:-1] - at[:-1])
        # the furthest end so far of a document and source; offsets keep others below
        group = np.cumsum(~same)
        furthest = np.maximum.accumulate(end + group * (1 << 32)) - group * (1 << 32) if len(end) else end
        new = ~same
        new[1:] |= at[1:] > furthest[:-1]
        heads = np.flatnonzero(new)
        last = np.append(heads[1:], len(row)) - 1
        # cut at multiples of ASKED in the source
        low, high = source_at[heads], source_at[heads] + furthest[last] - at[heads]
        pieces = (high - 1) // ASKED - low // ASKED + 1
        span = np.repeat(np.arange(len(heads)), pieces)
        block = low[span] // ASKED + np.arange(len(span)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, end = np.maximum(low[span], block * ASKED), np.minimum(high[span], (block + 1) * ASKED)
        head = heads[span]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row[head])), *[pa.array(x.astype(np.int32)) for x in (begin - source_at[head] + at[head], end - begin)],
             pa.array(source[head]), pa.array(begin.astype(np.int32))],
            names=["doc_id", "at", "words", "source", "source_at"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for batch in batches:
        packed = [pack.compress(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "packed"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that stay, and the digests of all spans asked for: of the document's copies, and of copies made of it."""
    for batch, w in _opened(batches):
        data, starts, ends = w.data.tobytes(), w.starts.tolist(), w.ends.tolist()
        totals, kept_texts, digests = [], [], []
        for i, asked in enumerate(batch.column("asked").to_pylist()):
            low, high = int(w.first[i]), int(w.first[i + 1])
            change = np.zeros(high - low + 1, np.int64)
            found = []
            for s in asked or ():
                begin, end = min(s["at"], high - low), min(s["at"] + s["words"], high - low)
                if s["copy"]:
                    change[begin] += 1
                    change[end] -= 1
                place = range(low + begin, low + end)
                sha = hashlib.sha256(b" ".join([data[starts[k] : ends[k]] for k in place])).digest()
                found.append({"source": s["source"], "source_at": s["source_at"], "words": s["words"], "sha": sha})
            stays = (np.flatnonzero(np.cumsum(change[:-1]) == 0) + low).tolist()
            totals.append((high - low, high - low - len(stays)))
            kept_texts.append(b" ".join([data[starts[k] : ends[k]] for k in stays]).decode())
            digests.append(found)
        n, gone = zip(*totals, strict=True) if totals else ((), ())
        kind = pa.list_(pa.struct([("source", pa.int64()), ("source_at", pa.int32()), ("words", pa.int32()), ("sha", pa.binary())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept_texts, pa.string()), pa.array(digests, kind)],
            names=["doc_id", "n_words", "n_removed", "text", "digests"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, text): text has the words that stay, joined by one blank.

    A word goes if a window of EDGE words that covers it also starts in a document with a smaller
    doc_id; windows are judged on the input. Null texts have no words. doc_id identifies a
    document: rows that repeat it must have the same text (else an error), and do not remove each other. Rows with a null
    doc_id stay whole. Other columns are ignored; an empty table gives an empty one.
    """
    for seed in range(SEEDS):
        removed = stored(_removed(docs, seed))
        digests = removed.select(F.inline("digests")).groupBy("source", "source_at", "words").agg(
            F.min("sha").alias("low"), F.max("sha").alias("high"))
        if digests.filter("low <> high").isEmpty():
            return removed.drop("digests")
    raise RuntimeError("one doc_id stands for different texts, or spans of equal hashes differ with every seed")


def _removed(docs: DataFrame, seed: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.filter("doc_id IS NOT NULL")
    settled = stored(_resolved(known.mapInArrow(_path_finder(seed), ROW), True))
    packed = docs.mapInArrow(_pack, "doc_id long, packed binary")
    apart = settled.filter(F.col("kind") == APART)
    wanted = apart.groupBy("doc_id").agg(F.collect_set(F.struct("at", "edges", "key")).alias("spans"))  # within a document
    edges = packed.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).join(wanted.hint("merge"), "doc_id").mapInArrow(_taker_apart(seed), ROW)
    copies = settled.filter(F.col("kind") == COPY).unionByName(_resolved(edges, False))
    together = copies.groupBy("doc_id").agg(F.collect_set(F.struct("at", "edges", "source", "source_at")).alias("copies"))
    spans_ = stored(together.mapInArrow(_long_spans, "doc_id long, at int, words int, source long, source_at int"))
    # a source is asked once for a span, however many copies it has
    asked = spans_.withColumn("copy", F.lit(True)).unionByName(spans_.select(
        F.col("source").alias("doc_id"), F.col("source_at").alias("at"), "words", "source", "source_at").distinct().withColumn("copy", F.lit(False)))
    by_document = asked.groupBy("doc_id").agg(F.collect_set(F.struct("at", "words", "source", "source_at", "copy")).alias("asked"))
    return packed.join(by_document.hint("merge"), "doc_id", "left").mapInArrow(
        _remove, "doc_id long, n_words long, n_removed long, text string,"
        " digests array<struct<source: long, source_at: int, words: int, sha: binary>>")
