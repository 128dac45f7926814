"""Words, word hashes and n-gram hashes of many texts at once, as numpy arrays.

A word is a maximal run of bytes other than [\\x20\\x09-\\x0D]; these are ASCII, so no UTF-8
sequence is cut. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at a time: bounds the memory for 64-bit intermediates.
SLICE_BYTES = 250_000
#: Places in a word whose terms are kept in a table.
_NEAR = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(9, 14)]] = True


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of text i
    hashes: np.ndarray  # of each word


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _terms(places: np.ndarray, values: np.ndarray) -> np.ndarray:
    return mix((places.astype(np.uint64) << np.uint64(8) | values.astype(np.uint64)) + _STEP)


_TABLE = _terms(np.repeat(np.arange(_NEAR), 256), np.tile(np.arange(256), _NEAR))


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per word the sum of pseudo-random terms, one for each byte and its place in the word.

    There is no relation between terms, so no arrangement of bytes cancels out, as it can where
    terms are powers modulo 2^64.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + SLICE_BYTES, side="right")))
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = mix(_sums(data[low : ends[stop - 1]], s, e) + (e - s).astype(np.uint64) * _STEP)
        at = stop
    return out


def _sums(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if len(starts) == 1 and len(part) > SLICE_BYTES:  # one very long word, in parts
        whole = np.zeros(1, np.uint64)
        for at in range(0, len(part), SLICE_BYTES):
            some = part[at : at + SLICE_BYTES]
            whole += _terms(np.arange(at, at + len(some)), some).sum(dtype=np.uint64)
        return whole
    sizes = ends - starts
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value = part[place + np.repeat(starts, sizes)]
    terms = _TABLE[np.minimum(place, _NEAR - 1) << 8 | value]
    far = np.flatnonzero(place >= _NEAR)
    for i in range(0, len(far), SLICE_BYTES):
        some = far[i : i + SLICE_BYTES]
        terms[some] = _terms(place[some], value[some])
    return np.add.reduceat(terms, np.cumsum(sizes) - sizes)


def split_words(texts: pa.Array) -> Words:
    """The words of every text, whole texts, in order."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    low = offsets[0]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[low : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - low
    inside = ~_SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins[filled] = inside[filled]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    finishes[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, first, _hash_words(data, starts, ends))


def ngrams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each n consecutive words, by first word; the caller drops those across texts."""
    count = max(0, len(hashes) - n + 1)
    out = np.full(count, seed, np.uint64)
    for i, factor in enumerate(_factors(n)):
        out += hashes[i : i + count] * factor
    return mix(out)


def _factors(n: int) -> np.ndarray:
    """Unrelated odd numbers, one for each place."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def spans(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Hash of spans of several words each; spans are short, so words are gone through by place."""
    out = sizes.astype(np.uint64) * _STEP + np.uint64(seed)
    for i, factor in enumerate(_factors(int(sizes.max()) if len(sizes) else 0)):
        has = np.flatnonzero(sizes > i)
        out[has] += mix(hashes[starts[has] + i] + np.uint64(seed)) * factor
    return mix(out)


def slices(batch: pa.RecordBatch, column: str | int, most: int = 2 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part have at most this many bytes, or are one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
