"""Alignment of two tokenizers against a plain version that encodes whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from listwarden.llm import alignment, packing
from listwarden.llm.queries import importable

A, B = packing.default_tokenizer("byte_bpe_50k.json"), packing.default_tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    from listwarden.llm.bpe import Bpe
    strings = Bpe(A).strings
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def tokens(text):
        x = a.encode(" " + text, add_special_tokens=False).ids
        y = b.encode(text)
        return [(i, strings[i]) for i in x], [(i, piece(i)) for i in y]
    return tokens


def plain(texts, tokens):
    linked, rows = [], []
    for text in texts:
        a, b = tokens(text) if text else ([], [])
        target = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != target or b"".join(x for _, x in b) != target:
            linked.append(Counter())
            rows.append([0, 0, 0, ""])
            continue
        ends = []
        for side in (a, b):
            at, some = 0, []
            for _, x in side:
                at += len(x)
                some.append(at)
            ends.append(some)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = [([i for (i, _), e in zip(a, ends[0], strict=True) if low < e <= high], [i for (i, _), e in zip(b, ends[1], strict=True) if low < e <= high])
                  for low, high in zip([0, *common[:-1]], common, strict=True)]
        linked.append(Counter((x, y) for g, h in groups for x in g for y in h))
        shown = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        rows.append([len(a), len(b), len(groups), hashlib.sha256(shown.encode()).hexdigest()])
    count = Counter(p for c in linked for p in c)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    return [(i, r[0], r[1], r[2], sum(c.values()), sum(k for p, k in c.items() if count[p] == most[p[0]]), sum(k * count[p] for p, k in c.items()), r[3])
            for i, (r, c) in enumerate(zip(rows, linked, strict=True))]


def texts():
    r = random.Random(5)
    words = ["the", "alignment", "tokens,", "don't", "über", "naïve", "漢字", "🙂🙃", "x=1;", "foo\nbar", "http://a.example.com/?q=1", "%%%%%%%%%%%", "--------------------", "1234567890"]
    out = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    out += [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \nb", "\ta", "a\t", "a  b", " x y", "<|endoftext|> <s> </s> <unk>", "a▁b", "▁", "x\x00y", "\x1c a \x1f b",
            "a​ b", "﻿ a", "é é ﬁ ½", "　漢 字　", "\x85   z"]
    out += ["q" * 3000 + " end", "漢" * 500, " ".join(["same"] * 400), out[0], out[0], "the " * 5000 + "end", "=" * 5003, "กำ" * 900]
    alphabet = "ab Z9.,'\n\t  é漢🙂▁<>|"
    return out + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 40))) for _ in range(400)]


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, monkeypatch, libraries, small):
    importable(spark)
    some = texts()
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(some)], "doc_id long, text string, batch int, pairs string, n_a int").repartition(3)
    got = sorted(map(tuple, alignment.align(frame, A, B, cell_records=30 if small else 4_000_000).collect()))
    want = plain(some, libraries)
    assert [x for x, y in zip(got, want, strict=True) if x != y] == []
    assert sum(x[1] == 0 for x in want) < len(want) / 2


def test_batches_blocks_and_forgotten_pieces(monkeypatch, libraries):
    """The parts that run in tasks, with bounds small enough to be met."""
    import pyarrow as pa

    monkeypatch.setattr(alignment, "BATCH_BYTES", 3_000)
    monkeypatch.setattr(alignment, "BLOCK", 2)
    monkeypatch.setattr(alignment, "KEPT_PIECES", 40)
    monkeypatch.setattr(alignment, "ALIGNED", 11)
    monkeypatch.setattr(alignment, "WIDE", 2)
    some = texts()
    alignment._aligner.cache_clear()
    rows = [r for b in alignment._spill(A, B)(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(len(some))), "text": some})])) for r in b.to_pylist()]
    alignment._aligner.cache_clear()
    runs = [r for r in rows if r["kind"] == alignment._RUN]
    assert max(len(r["pairs"]) for r in runs) > 2 and len(rows) - len(runs) > 5
    counted = []
    for radix in range(alignment.RADIX):
        for part in (0, 1):
            own = [r["pairs"] for i, r in enumerate(runs) if r["radix"] == radix and i % 2 == part]
            counted += [(radix, int(p), int(n)) for pairs, counts in alignment.merged_counts(own) for p, n in zip(pairs, counts, strict=True)]
    counted.sort()
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array([c[i] for c in x]) for i in range(3)], names=["radix", "pair", "n"])
    heads = [r for b in alignment._judge(iter([batch(counted[i : i + 50]) for i in range(0, len(counted), 50)])) for r in b.to_pylist()]
    cells = sorted([{**r, "part": 0, "kind": 0, "batch": "", "docs": []} for r in heads] + [{**r, "part": 0, "first": 0} for r in runs], key=lambda r: (r["radix"], r["kind"], r["first"]))
    columns = ["radix", "part", "kind", "first", "batch", "pairs", "docs"]
    added = [r for b in alignment._contribute(iter([pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in cells])])) for r in b.to_pylist()]
    whole = sorted([{"batch": r["batch"], "kind": 0, "frame": r["docs"][0]} for r in rows if r["kind"] == 0] + added, key=lambda r: (r["batch"], r["kind"]))
    got = [tuple(r.values()) for b in alignment._finish(iter([pa.RecordBatch.from_pylist(whole)])) for r in b.to_pylist()]
    assert sorted(got) == plain(some, libraries)


def test_long_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_BYTES", 50_000)
    aligner = alignment.Aligner(A, B)
    for i in range(9):
        aligner.slots([f"short words {i} " + "漢字" * 900, "short words"])
    assert aligner.store.bytes < 100_000 and "words" in aligner.known


def test_packed_arrays():
    some = [np.array([], np.int64), np.arange(300), np.array([0, 1 << 40])]
    assert [x.tolist() for x in alignment.unpacked(alignment.packed(*some))] == [x.tolist() for x in some]


def test_empty_table(spark):
    importable(spark)
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(frame, A, B).count() == 0
