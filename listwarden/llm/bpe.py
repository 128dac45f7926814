"""Byte-level BPE: encoding by a priority queue of merges, decoding by vocabulary strings.

A pre-token is a doubly linked list of symbols. The queue holds the rank and place of every pair
that may merge; the lowest rank is merged first, leftmost first, and an entry whose pair has
changed meanwhile is stale and skipped. Each distinct run of text between blanks, and each
distinct pre-token, is encoded once per worker, as far as the bounded stores reach.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from listwarden.llm.words import slices

KEPT_CHUNKS, KEPT_LENGTH = 250_000, 64
#: Unicode white space, and the pattern that splits text before the merges.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        vocab, names = content["model"]["vocab"], _byte_names()
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.strings = {i: bytes(names[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.strings |= {i: token.encode() for token, i in self.special.items()}
        # by id; the last entry stands for unknown ids
        self.table = pa.array([self.strings.get(i, b"") for i in range(max(self.strings) + 2)], pa.large_binary())
        self.bytes_ = [vocab[name] for name, _ in sorted(names.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(content["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.split = regex.compile(SPLIT)
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids, merges, n = [self.bytes_[b] for b in word], self.merges, len(word)
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], i) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or (m := merges.get((ids[i], ids[j]))) is None or m[0] != rank:
                continue  # stale: one of the two symbols has merged with another
            ids[i], ids[j] = m[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((ids[i], ids[k])):
                    heapq.heappush(queue, (m[0], i))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], ids[i]))):
                heapq.heappush(queue, (m[0], h))
        return [x for x in ids if x >= 0]

    def _chunk(self, text: str) -> tuple[int, ...]:
        words = self.split.findall(text)
        found = self._word(words[0]) if len(words) == 1 else tuple(chain.from_iterable(map(self._word, words)))
        if len(text) <= KEPT_LENGTH:
            if len(self.known) >= KEPT_CHUNKS:
                self.known.clear()
            self.known[text] = found
        return found

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token: chunks that differ in punctuation share theirs."""
        found = self.words.get(word)
        if found is None:
            found = tuple(self.merge(word.encode()))
            if len(word) <= KEPT_LENGTH:
                if len(self.words) >= KEPT_CHUNKS:
                    self.words.clear()
                self.words[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, chunk = self.known.get, self._chunk
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                out.extend(chain.from_iterable([known(c) or chunk(c) for c in self.chunks.findall(part)]))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are not UTF-8 become replacement characters, unknown ids nothing."""
        return b"".join([self.strings.get(i, b"") for i in ids]).decode("utf-8", "replace")

    def decode_all(self, ids: pa.ListArray) -> list[str | None]:
        """As decode, for the lists of a batch: the vocabulary strings of all ids end to end, cut by list."""
        n = len(self.table) - 1
        numbers = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        joined = self.table.take(pa.array(np.where((numbers < 0) | (numbers > n), n, numbers)))
        _, places, content = joined.buffers()
        places = np.frombuffer(places, np.int64)[joined.offset :] if len(joined) else np.zeros(1, np.int64)
        ends = places[np.cumsum([0, *ids.value_lengths().fill_null(0).to_numpy()])]
        view = memoryview(content or b"")
        return [str(view[a:b], "utf-8", "replace") if known else None
                for a, b, known in zip(ends[:-1], ends[1:], ids.is_valid().to_pylist(), strict=True)]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids) of docs, row by row. Null text counts as empty and has no ids.

    Columns other than doc_id and text are ignored; repeated rows stay, an empty table stays empty.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (with a column ids and any others) with the decoded text; null ids give null."""
    kept = [c for c in encoded.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            text = bpe.decode_all(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(text, pa.string())], names=[*kept, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*[f"`{c}`" for c in kept]).schema)
    return encoded.select(*[f"`{c}`" for c in kept]).mapInArrow(work, f"{schema}, text string")
