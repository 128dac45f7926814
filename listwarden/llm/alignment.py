"""Alignment of the tokens of two tokenizers, and how common each aligned pair of ids is.

A document is split by a byte-level BPE vocabulary (side A) and a sentence-piece vocabulary (side
B); both cover the bytes of one blank and the text. Byte offsets where a token of A and one of B
both end cut the document into groups; all tokens of A and B of one group are linked. The count of
a pair of ids is the number of documents that hold it linked.

Counting is an external merge of spilled runs:

1. Tasks align documents in batches. Each distinct piece of text between single blanks is encoded
   and aligned once, as far as a bounded store reaches: neither tokenizer joins bytes across such a
   blank. The records (pair, document, links) of a batch are dealt by a radix of the A id, sorted by
   A id, B id and document, and spilled as one zstd run for each radix, in blocks, to a stored table.
2. Spark brings the pairs of the runs of a cell (a radix, or a part of its runs) to one task. A heap
   merges the k runs block by block and counts the documents of each pair. Counts of the parts are
   added up by Spark. Runs are dealt to as many cells as their records need, so an A id that a third
   of all records hold is spread over many tasks; a batch counts a pair once for each document and
   sends one number, however many documents hold it.
3. Counts in the order of A ids tell the maximum of each A id when its last pair has passed. They
   meet the runs of every cell again, in the same order, and the records turn into contributions:
   per run and document the sum of counts, and the links that are best for their A id.
4. Contributions are added up per batch and written out with its documents.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwarden.llm.bpe import SPACE, Bpe
from listwarden.llm.storage import stored
from listwarden.llm.words import slices

#: Parts that records are dealt to by A id; records of a cell, which whole runs fill.
RADIX, CELL_RECORDS = 64, 4_000_000
#: Text of a batch, pairs of a block of a run, pieces kept per worker, and pieces aligned at once.
BATCH_BYTES, BLOCK, KEPT_PIECES, ALIGNED = 4_000_000, 16_384, 300_000, 25_000
#: Bytes of kept pieces, about: their groups as text and their pairs.
KEPT_BYTES = 100_000_000
#: Links of a group from which its distinct ids are multiplied instead of its tokens.
WIDE = 1_000
_MOST_IDS, _MOST_DOCUMENTS, _MOST_TASKS = 1 << 16, 1 << 18, 20_000
#: White space by any reading of the tokenizers; no cut is made next to it.
_WHITE = SPACE + "\\x1c-\\x1f\\ufeff\\u180e\\u200b"
_CUT = re.compile(rf"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
_UNSURE = re.compile(rf"^[{_WHITE}]|[{_WHITE}] | [{_WHITE}]|[{_WHITE}]$")
_RUNS = "batch string, kind int, radix int, records long, pairs array<binary>, docs array<binary>"
#: Kinds of rows: what describes a batch or a radix comes before what belongs to it.
_HEAD, _RUN = 0, 1


# arrays as bytes

def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, each in the narrowest type, as one zstd frame."""
    parts, head = [], [struct.pack("<B", len(arrays))]
    for x in arrays:
        kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
        head.append(struct.pack("<BQ", kind.itemsize, len(x)))
        parts.append(x.astype(kind).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(head + parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = raw[0], 1 + 9 * raw[0], []
    for i in range(n):
        width, length = struct.unpack_from("<BQ", raw, 1 + 9 * i)
        out.append(np.frombuffer(raw, f"<u{width}", length, at).astype(np.int64))
        at += width * length
    return out


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _heads(x: np.ndarray) -> np.ndarray:
    """Where a sorted array begins a new value."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


# pieces

class Store:
    """Aligned pieces by slot: sizes (tokens of A and B, groups, links; -1 if bytes differ), groups as text, linked pairs."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)
        self.n_pairs = np.zeros(0, np.int64)
        self.pairs, self.links = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.batches = np.zeros(0, np.int64)  # that a piece occurred in
        self.bytes = 0

    def add(self, names: list[str], groups: list[str], sizes: np.ndarray, n_pairs: np.ndarray, pairs: np.ndarray, links: np.ndarray) -> None:
        self.names += names
        self.groups += groups
        self.sizes = np.concatenate([self.sizes, sizes])
        self.n_pairs = np.concatenate([self.n_pairs, n_pairs])
        self.pairs, self.links = np.concatenate([self.pairs, pairs]), np.concatenate([self.links, links])
        self.batches = np.concatenate([self.batches, np.zeros(len(names), np.int64)])
        self.bytes += sum(map(len, names)) + sum(map(len, groups)) + 8 * len(pairs)

    def of(self, slots: np.ndarray) -> np.ndarray:
        """Places in pairs and links of the pairs of slots."""
        n = self.n_pairs[slots]
        return np.repeat(_starts(self.n_pairs)[slots] - _starts(n), n) + np.arange(n.sum())

    def kept(self, most: int) -> Store:
        """The pieces that came most often and are no long ones."""
        short = np.array([len(g) <= 256 for g in self.groups])
        some = np.flatnonzero((self.batches > 1) & short)
        some = np.sort(some[np.argsort(-self.batches[some], kind="stable")[:most]])
        out = Store()
        at = self.of(some)
        out.add([self.names[i] for i in some], [self.groups[i] for i in some], self.sizes[some], self.n_pairs[some], self.pairs[at], self.links[at])
        out.batches = self.batches[some]
        return out


class Aligner:
    """Both vocabularies and the pieces seen by a worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        strings = Bpe(path_a).strings
        bytes_a = [strings.get(i, b"") for i in range(max(strings) + 1)]
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        if max(len(bytes_a), len(bytes_b)) > _MOST_IDS or any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("only vocabularies of up to 65,536 ids, and pieces with blanks at their front, can be aligned")
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (bytes_a, bytes_b))
        self.table_a, self.table_b = (pa.array(x, pa.large_binary()) for x in (bytes_a, bytes_b))
        self.numbers = np.array([str(i) for i in range(max(len(bytes_a), len(bytes_b)))], object)
        self.known: dict[str, int] = {}
        self.store = Store()

    def _encoded_a(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, each with a blank before it, and how many each has."""
        ids, counts = [], []
        encode = self.a.encode_batch_fast
        for odd in (False, True):  # where no white space is at an end, pieces are encoded together and cut again
            some = [(i, p) for i, p in enumerate(pieces) if bool(not p or _UNSURE.search(p)) == odd]
            step = 1 if odd else 1_000
            groups = [some[i : i + step] for i in range(0, len(some), step)]
            for group, found in zip(groups, encode(["".join(f" {p}" for _, p in g) for g in groups], add_special_tokens=False), strict=True):
                flat = np.array(found.ids, np.int64)
                ends = np.cumsum(self.size_a[flat])
                cut = np.searchsorted(ends, np.cumsum([1 + len(p.encode()) for _, p in group]), side="right")
                ids += np.split(flat, cut[:-1])
                counts += [i for i, _ in group]
        place = np.argsort(np.array(counts, np.int64))
        ids = [ids[i] for i in place]
        return np.concatenate(ids), np.array(list(map(len, ids)), np.int64)

    def _aligned(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Groups as text, sizes, and the linked pairs of pieces, for all of them at once."""
        a, n_a = self._encoded_a(pieces)
        lists = self.b.encode(pieces, num_threads=1)
        b, n_b = np.fromiter(chain.from_iterable(lists), np.int64), np.array(list(map(len, lists)), np.int64)
        texts = [b" " + p.encode() for p in pieces]
        target = np.array(list(map(len, texts)), np.int64)
        good = self._same(self.table_a, a, n_a, self.size_a, texts, target) & self._same(self.table_b, b, n_b, self.size_b, texts, target)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b, target = np.where(good, n_a, 0), np.where(good, n_b, 0), np.where(good, target, 0)
        ends_a, ends_b, ends = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), np.cumsum(target)
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        in_a, in_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)  # group of each token
        m_a, m_b = np.bincount(in_a, minlength=len(common)), np.bincount(in_b, minlength=len(common))
        piece = np.searchsorted(ends, common)  # of each group
        groups, links = np.bincount(piece, minlength=len(pieces)), np.zeros(len(pieces), np.int64)
        np.add.at(links, piece, m_a * m_b)
        sizes = np.where(good[:, None], np.column_stack([n_a, n_b, groups, links]), -1)

        # ids of A, then those of B, group by group, with what stands behind each
        order, behind = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        place_a = np.arange(len(a)) + _starts(m_b)[in_a]
        place_b = np.arange(len(b)) + np.cumsum(m_a)[in_b]
        order[place_a], order[place_b] = a, b
        behind[place_a[np.cumsum(m_a) - 1]] = 1
        behind[place_b[np.cumsum(m_b) - 1]] = 2 + (ends[piece] == common)
        parts = np.empty(2 * len(order), object)
        parts[0::2], parts[1::2] = self.numbers[order], np.array([",", "|", ";", "\n"], object)[behind]
        shown = iter("".join(parts.tolist()).split("\n"))
        texts_of = [next(shown) if ok else "" for ok in good.tolist()]

        wide = m_a * m_b > WIDE
        todo = np.flatnonzero(~wide[in_a])
        times = m_b[in_a[todo]]
        left = np.repeat(todo, times)
        right = np.repeat(_starts(m_b)[in_a[todo]] - _starts(times), times) + np.arange(times.sum())
        owner, pairs = piece[in_a[left]], (a[left] << 16 | b[right]).astype(np.uint32)
        n_links = np.ones(len(pairs), np.uint32)
        for g in np.flatnonzero(wide):
            x, k = np.unique(a[in_a == g], return_counts=True)
            y, m = np.unique(b[in_b == g], return_counts=True)
            pairs = np.concatenate([pairs, (x[:, None] << 16 | y[None, :]).ravel().astype(np.uint32)])
            n_links = np.concatenate([n_links, np.outer(k, m).ravel().astype(np.uint32)])
            owner = np.concatenate([owner, np.full(len(x) * len(y), piece[g])])
        if wide.any():
            by = np.argsort(owner, kind="stable")
            owner, pairs, n_links = owner[by], pairs[by], n_links[by]
        return texts_of, sizes, np.bincount(owner, minlength=len(pieces)), pairs, n_links

    @staticmethod
    def _same(table: pa.Array, ids: np.ndarray, counts: np.ndarray, size: np.ndarray, texts: list[bytes], target: np.ndarray) -> np.ndarray:
        """Of which pieces the bytes of the tokens are the text."""
        whole = table.take(pa.array(ids)).to_pylist()
        if b"".join(whole) == b"".join(texts):
            lengths = np.zeros(len(texts), np.int64)
            np.add.at(lengths, np.repeat(np.arange(len(texts)), counts), size[ids])
            if (lengths == target).all():
                return np.ones(len(texts), bool)
        at = _starts(counts)
        return np.array([b"".join(whole[i : i + n]) == t for i, n, t in zip(at.tolist(), counts.tolist(), texts, strict=True)], bool)

    def slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slots in the store of the pieces of all texts, and how many pieces each text has."""
        if len(self.store.names) > KEPT_PIECES or self.store.bytes > KEPT_BYTES:
            self.store = self.store.kept(KEPT_PIECES // 2)
            self.known = {p: i for i, p in enumerate(self.store.names)}
        pieces = [_CUT.split(t) if _UNSURE.search(t) else t.split(" ") for t in texts]
        known = self.known
        fresh = list({p for some in pieces for p in some if p not in known})
        for start in range(0, len(fresh), ALIGNED):
            part = fresh[start : start + ALIGNED]
            known.update(zip(part, range(len(self.store.names), len(self.store.names) + len(part)), strict=True))
            self.store.add(part, *self._aligned(part))
        found = np.fromiter((known[p] for some in pieces for p in some), np.int64)
        self.store.batches[np.unique(found)] += 1
        return found, np.array(list(map(len, pieces)), np.int64)


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


# spilled runs

def _sorted_records(aligner: Aligner, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Sizes and digest of the groups per text, and the records: radix, pair and text in one number, with links."""
    found, n = aligner.slots(texts)
    store, owner = aligner.store, np.repeat(np.arange(len(texts)), n)
    sizes = np.zeros((len(texts), 4), np.int64)
    np.add.at(sizes, owner, store.sizes[found])
    bad = np.zeros(len(texts), bool)
    bad[owner[store.sizes[found, 0] < 0]] = True
    bad |= np.array([not t for t in texts], bool)
    sizes[bad] = 0
    ends, digests, shown = np.cumsum(n), [], store.groups
    slots = found.tolist()
    for i, end in enumerate(ends.tolist()):
        groups = "" if bad[i] else ";".join([shown[s] for s in slots[end - int(n[i]) : end]])
        digests.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    once, times = np.unique((owner << 32 | found)[~bad[owner]], return_counts=True)
    text, slot = once >> 32, once & 0xFFFFFFFF
    at, each = store.of(slot), store.n_pairs[slot]
    pair = store.pairs[at].astype(np.int64)
    records = (pair >> 16) % RADIX << 50 | pair << 18 | np.repeat(text, each)
    links = store.links[at] * np.repeat(times, each)
    order = np.argsort(records, kind="stable")
    records, links = records[order], links[order]
    heads = _heads(records)
    return sizes, digests, records[heads], np.add.reduceat(links, heads) if len(heads) else links


def _spill(path_a: str, path_b: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["batch", "kind", "radix", "records", "pairs", "docs"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())]
        for whole in batches:
            for wide in slices(whole, "text", BATCH_BYTES):
                for start in range(0, len(wide), _MOST_DOCUMENTS):
                    part = wide.slice(start, _MOST_DOCUMENTS)
                    sizes, digests, records, links = _sorted_records(
                        _aligner(path_a, path_b), [t or "" for t in part.column("text").to_pylist()])
                    documents = pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), *[pa.array(sizes[:, i]) for i in range(4)], pa.array(digests, pa.string())],
                        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                        writer.write_batch(documents)
                    name = uuid.uuid4().hex
                    rows = [(name, _HEAD, -1, len(part), [], [sink.getvalue().to_pybytes()])]
                    cut = np.searchsorted(records, np.arange(RADIX + 1, dtype=np.int64) << 50)
                    for radix, low, high in zip(range(RADIX), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                        if low < high:
                            rows.append((name, _RUN, radix, high - low, *_blocks(records[low:high], links[low:high])))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return work


def _blocks(records: np.ndarray, links: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """A run: per block its pairs with their numbers of documents, and these documents with their links."""
    pair, text = records >> 18 & 0xFFFFFFFF, records & (_MOST_DOCUMENTS - 1)
    heads = _heads(pair)
    ends = np.append(heads, len(pair))
    first, second = [], []
    for at in range(0, len(heads), BLOCK):
        some = heads[at : at + BLOCK]
        low, high = int(some[0]), int(ends[min(at + BLOCK, len(heads))])
        first.append(packed(np.diff(pair[some], prepend=0), np.diff(np.append(some, high))))
        # within a pair, documents by distance from the one before
        step = np.diff(text[low:high], prepend=0)
        step[some - low] = text[some]
        second.append(packed(step, links[low:high]))
    return first, second


def _block(pairs: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, numbers of documents, documents and links of a block."""
    (steps, counts), (text, links) = unpacked(pairs), unpacked(docs)
    total = np.cumsum(text)
    before = total[_starts(counts)] - text[_starts(counts)]
    return np.cumsum(steps), counts, total - np.repeat(before, counts), links


# counting

def merged_counts(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge of runs: pairs in order with their numbers of documents.

    The heap holds the last pair of the block at hand of each run. Up to the smallest of them no
    block still to come has a smaller pair, so what lies there is summed up and handed on.
    """
    feeds = [iter(run) for run in runs]
    open_: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def advance(i: int) -> None:
        block = next(feeds[i], None)
        if block is not None:
            steps, counts = unpacked(block)
            pairs = np.cumsum(steps)
            open_[i] = pairs, counts
            heapq.heappush(heap, (int(pairs[-1]), i))

    for i in range(len(runs)):
        advance(i)
    while heap:
        last = heap[0][0]
        ended, parts = [], []
        while heap and heap[0][0] == last:
            ended.append(heapq.heappop(heap)[1])
        for i, (pairs, counts) in list(open_.items()):
            cut = int(np.searchsorted(pairs, last, side="right"))
            if cut:
                parts.append((pairs[:cut], counts[:cut]))
                open_[i] = pairs[cut:], counts[cut:]
        for i in ended:
            del open_[i]
            advance(i)
        keys, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        heads = _heads(keys)
        yield keys[heads], np.add.reduceat(values, heads)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[dict]]]:
    """Rows sorted by radix and part, cell by cell."""
    from itertools import groupby

    rows = (row for batch in batches for i in range(len(batch)) for row in batch.slice(i, 1).to_pylist())
    yield from groupby(rows, key=lambda r: (r["radix"], r["part"]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (radix, _), rows in _cells(batches):
        for pairs, counts in merged_counts([r["pairs"] for r in rows]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pairs), radix, np.int32)), pa.array(pairs), pa.array(counts)], names=["radix", "pair", "n"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts sorted by radix and pair, as blocks: an A id is judged when its last pair has passed."""
    kept = np.zeros((0, 3), np.int64)
    for batch in chain(batches, [None]):
        if batch is not None:
            if not len(batch):
                continue
            more = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("radix", "pair", "n")])
            kept = np.concatenate([kept, more])
        if not len(kept):
            continue
        side = kept[:, 0] << 16 | kept[:, 1] >> 16
        done = len(kept) if batch is None else int(_heads(side)[-1])
        ready, kept = kept[:done], kept[done:]
        if not done:
            continue
        heads = _heads(ready[:, 0] << 32 | ready[:, 1])
        n, ready = np.add.reduceat(ready[:, 2], heads), ready[heads]
        side = ready[:, 0] << 16 | ready[:, 1] >> 16
        firsts = _heads(side)
        most = np.repeat(np.maximum.reduceat(n, firsts), np.diff(np.append(firsts, len(side))))
        ends = np.append(_heads(ready[:, 0]), len(ready))
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            block = packed(np.diff(ready[low:high, 1], prepend=0), n[low:high], (n == most)[low:high])
            yield pa.RecordBatch.from_arrays(
                [pa.array([ready[low, 0]], pa.int32()), pa.array([ready[low, 1]], pa.int64()), pa.array([[block]], pa.list_(pa.binary()))],
                names=["radix", "first", "pairs"])


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per cell the counts first, then the runs: what each run adds to its documents."""
    for _, rows in _cells(batches):
        blocks, table = [], None
        for row in rows:
            if row["kind"] == _HEAD:
                blocks.append(unpacked(row["pairs"][0]))
                continue
            if table is None:
                table = np.concatenate([np.cumsum(x[0]) for x in blocks]), np.concatenate([x[1] for x in blocks]), np.concatenate([x[2] for x in blocks])
            size = 0
            sums, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for pairs, counts, text, links in (_block(p, d) for p, d in zip(row["pairs"], row["docs"], strict=True)):
                if (more := int(text.max()) + 1 - size) > 0:
                    sums, best, size = np.pad(sums, (0, more)), np.pad(best, (0, more)), size + more
                at = np.searchsorted(table[0], pairs)
                np.add.at(sums, text, links * np.repeat(table[1][at], counts))
                np.add.at(best, text, links * np.repeat(table[2][at], counts))
            some = np.flatnonzero(sums)
            frame = packed(some, sums[some], best[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["batch"]]), pa.array([_RUN], pa.int32()), pa.array([frame], pa.binary())], names=["batch", "kind", "frame"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by batch and kind: its documents first, then what was added to them."""
    documents, sums, best = None, None, None

    def told() -> pa.RecordBatch:
        columns = [documents.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(best), pa.array(sums), documents.column("groups_sha256")],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    for batch in batches:
        for kind, frame in zip(batch.column("kind").to_pylist(), batch.column("frame"), strict=True):
            if kind == _HEAD:
                if documents is not None:
                    yield told()
                documents = pa.ipc.open_stream(frame.as_py()).read_next_batch()
                sums, best = np.zeros(len(documents), np.int64), np.zeros(len(documents), np.int64)
            else:
                some, more, more_best = unpacked(frame.as_py())
                sums[some] += more
                best[some] += more_best
    if documents is not None:
        yield told()


def align(docs: DataFrame, path_a: str, path_b: str, cell_records: int = CELL_RECORDS) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of docs, row by row.

    path_a is a byte-level vocabulary file of the tokenizers library, path_b a sentence-piece model.
    n_links counts linked pairs of tokens; count_sum adds up the counts of their ids, n_best counts
    those whose count is the highest one of their A id. groups_sha256 is the digest of
    `a1,a2|b1;a3|b2,b3`, ids in order. Null and empty texts, and texts that one side does not give
    back byte for byte, have no tokens: zeros and an empty digest. Every row counts as a document,
    repeated rows and rows with a null doc_id, too. Other columns are ignored; an empty table gives
    an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = stored(docs.select("doc_id", "text").mapInArrow(_spill(path_a, path_b), _RUNS))
    records = runs.filter(F.col("kind") == _RUN)
    sizes = {r.radix: r.n for r in records.groupBy("radix").agg(F.sum("records").alias("n")).collect()}  # at most RADIX rows
    parts = [max(1, -(-sizes.get(i, 0) // cell_records)) for i in range(RADIX)]
    tasks = min(sum(parts), _MOST_TASKS)

    def parts_of(radix: Column) -> Column:
        return F.element_at(F.array(*[F.lit(p) for p in parts]), radix + 1)

    part = F.pmod(F.xxhash64("batch"), parts_of(F.col("radix"))).cast("int").alias("part")
    counted = records.select("radix", part, "pairs").repartition(tasks, "radix", "part").sortWithinPartitions("radix", "part").mapInArrow(
        _count, "radix int, pair long, n long")
    judged = counted.repartition(RADIX, "radix").sortWithinPartitions("radix", "pair").mapInArrow(
        _judge, "radix int, first long, pairs array<binary>")
    none = F.array().cast("array<binary>")
    heads = judged.select(
        "radix", F.explode(F.sequence(F.lit(0), parts_of(F.col("radix")) - 1)).alias("part"), F.lit(_HEAD).alias("kind"), "first",
        F.lit("").alias("batch"), "pairs", none.alias("docs"))
    met = heads.union(records.select("radix", part, "kind", F.lit(0).cast("long").alias("first"), "batch", "pairs", "docs"))
    added = met.repartition(tasks, "radix", "part").sortWithinPartitions("radix", "part", "kind", "first").mapInArrow(
        _contribute, "batch string, kind int, frame binary")
    documents = runs.filter(F.col("kind") == _HEAD).select("batch", "kind", F.col("docs")[0].alias("frame"))
    whole = documents.union(added).repartition("batch").sortWithinPartitions("batch", "kind")
    return whole.mapInArrow(
        _finish, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
