"""Token counts under a unigram model, with one dynamic program for shared prefixes.

The most probable segmentation of a pre-token (a word with a leading mark) is found by forward
scores: the score of a prefix is the best score of a shorter prefix plus that of one piece. A score
depends on the prefix alone, so the distinct pre-tokens of a batch are put into a trie and each
prefix is scored once. Sorted pre-tokens visit the trie depth first: the scores of the current path
are a stack, cut back to the prefix shared with the next pre-token; counts are kept at terminals.

Pieces come from a public vocabulary; their log probabilities follow Zipf's law by rank, as the
file holds ranks and not frequencies. Characters outside the vocabulary are one token per byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from listwarden.llm.words import slices

MARK = "▁"
#: Log probability of a byte outside the vocabulary, below that of any piece.
BYTE_SCORE = -25.0
KEPT_WORDS, KEPT_LENGTH = 500_000, 64


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, float]:
    """Log probability of each piece: 1 / (rank + 1), normalised."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    whole = math.log(sum(1 / (r + 1) for r in range(len(usable))))
    return {model.id_to_piece(i): -math.log(r + 1) - whole for r, i in enumerate(usable)}


def trie_counts(words: Iterable[str], scores: dict[str, float]) -> dict[str, int]:
    """Tokens of the best segmentation of each word; ties go to fewer tokens."""
    longest = max(map(len, scores), default=1)
    best, tokens, path = [0.0], [0], ""
    out = {}
    get = scores.get
    for word in sorted(words):
        shared = 0
        for x, y in zip(path, word, strict=False):
            if x != y:
                break
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for i in range(shared + 1, len(word) + 1):
            size = len(word[i - 1].encode("utf-8", "replace"))
            top, n = best[i - 1] + BYTE_SCORE * size, tokens[i - 1] + size
            for j in range(max(0, i - longest), i):
                score = get(word[j:i])
                if score is not None:
                    total = best[j] + score
                    if total > top or (total == top and tokens[j] + 1 < n):
                        top, n = total, tokens[j] + 1
            best.append(top)
            tokens.append(n)
        path = word
        out[word] = tokens[len(word)]
    return out


_KNOWN: dict[str, dict[str, int]] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_words, n_tokens) of docs, over whole texts. Null text counts as empty: 0 and 0.

    Columns other than doc_id and text are ignored; repeated rows stay, an empty table stays empty.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, known = pieces(path), _KNOWN.setdefault(path, {})
        for batch in batches:
            for part in slices(batch, "text"):
                split = [(t or "").split() for t in part.column("text").to_pylist()]
                if len(known) > KEPT_WORDS:
                    known.clear()
                fresh = {w for words in split for w in words if w not in known}
                known.update((w[1:], n) for w, n in trie_counts((MARK + w for w in fresh), scores).items())
                counts = [sum([known[w] for w in words]) for words in split]
                for w in fresh:
                    if len(w) > KEPT_LENGTH:
                        del known[w]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, split), pa.int64()), pa.array(counts, pa.int64())],
                    names=["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_words long, n_tokens long")
