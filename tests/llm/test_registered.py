"""The registered queries with their digest columns, and the pipeline stage by stage, against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_alignment import libraries, plain  # noqa: F401
from test_centroids import plain as plain_clusters
from test_operators import repeats, shingles, similarity

import corpus_pipeline
from listwarden.llm import language_id, packing, pii
from listwarden.llm.queries import QUERIES, importable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")


@pytest.fixture
def rows(spark, sf_dir):
    return lambda name: QUERIES[name](spark, sf_dir).toPandas()


def near_classes(ids, texts):
    bags = [shingles(t) for t in texts]
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if bags[x] and bags[y] and similarity(bags[x], bags[y]) >= 0.8:
                a, b = find(ids[x]), find(ids[y])
                label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op2_and_op3_and_op4(rows, docs):
    found = rows("op2_pii").set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        same = found.text[i] == text
        assert same == (found.n_found[i] == 0) and found.n_found[i] == len([k for k in found.kinds[i].split(",") if k])
    assert (found.n_found > 0).any() and set(rows("op3_license_scan").doc_id) == set(docs.doc_id) == set(rows("op4_token_counts").doc_id)


def test_op5(rows, docs):
    got = rows("op5_substring_dedup").set_index("doc_id")
    for i, (n, gone, text) in zip(docs.doc_id, repeats(list(docs.text)), strict=True):
        assert (got.n_words[i], got.n_removed[i], got.kept_sha256[i]) == (n, gone, sha(text))


def test_op6(rows, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer("byte_bpe_50k.json"))
    got = rows("op6_bpe").set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert (got.n_tokens[i], got.ids_sha256[i], got.decoded_sha256[i]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def check_packed(found, ids, texts):
    from tokenizers import Tokenizer

    library, pieces = Tokenizer.from_file(packing.default_tokenizer("word_bpe_49k.json")), []
    for i, text in zip(ids, texts, strict=True):
        codes = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces += [(i, n, at, len(codes[at : at + 2048]), zlib.crc32(codes[at : at + 2048].tobytes())) for n, at in enumerate(range(0, len(codes), 2048))]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(found[columns].itertuples(index=False, name=None)) == sorted(pieces)
    for _, sequence in found.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == (sequence.length.cumsum() - sequence.length).tolist() and sequence.length.sum() <= 2048
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 2048) + 1


def test_op7(rows, docs):
    check_packed(rows("op7_packing"), docs.doc_id, docs.text)


def test_op8(rows, docs):
    got = rows("op8_language_id").set_index("doc_id")
    outside = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs.doc_id}
    assert all(got.held_out[i] == outside[i] for i in docs.doc_id) and got.score.between(0, 1).all()
    known = docs[docs.lang.notna() & docs.doc_id.map(outside) & (docs.text.str.len() > 100)]
    assert (got.lang_pred[known.doc_id].values == known.lang.values).mean() > 0.95


def test_op9(rows, sf_dir):
    table = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    unit = np.stack(table.embedding).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (table.label.values[:, None] == table.label.values[None, :]) & ~np.eye(len(table), dtype=bool)
    got = rows("op9_embedding_dedup").set_index("vec_id")
    found = got.n_links[table.vec_id].values
    assert (found <= linked.sum(axis=1)).all() and found.sum() >= 0.9 * linked.sum()
    assert (got.kept == (got.index == got.component_id)).all()


def test_op10(rows, docs):
    got = rows("op10_minhash").set_index("doc_id")
    assert got.class_id.to_dict() == near_classes(list(docs.doc_id), list(docs.text))


def test_op11(rows, sf_dir):
    table = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    _, want = plain_clusters([(i, v.tolist()) for i, v in zip(table.vec_id, table.embedding, strict=True)], 8, 10, 64)
    assert sorted(rows("op11_centroids")[["vec_id", "cluster", "distance"]].itertuples(index=False, name=None)) == sorted(want)


def test_op13(rows, docs, libraries):  # noqa: F811
    got = rows("op13_alignment").set_index("doc_id")
    for i, want in zip(docs.doc_id, plain(list(docs.text), libraries), strict=True):
        assert tuple(got.loc[i]) == want[1:]


def test_pipeline(spark, sf_dir, docs, tmp_path):
    """Each stage on all that the one before it kept, and the run as a whole."""
    importable(spark)
    more = [(None, "en"), ("", "en"), ("12 34", "de"), (docs.text.iloc[0], "en"), (docs.text.iloc[0] + "  ", None), (docs.text.iloc[1] + " a few words more", "fr"), ("xq zv kj wq " * 9, None)]
    extra = [(10_000 + i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(more)]
    table = [*docs[["doc_id", "text", "lang", "source", "n_chars"]].itertuples(index=False, name=None), *extra]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        after = now.toPandas()
        if name != "best-fit packing":
            assert now.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        texts = {i: r.text or "" for i, r in before.items()}
        if name == "language ID":
            learned = language_id.learn(spark.read.parquet(f"{tmp_path}/documents.parquet").filter(~language_id.held_out(F.col("doc_id"))))
            told = language_id.predict(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), learned).collect()
            want = {r.doc_id for r in told if r.lang_pred != "und" and r.score * language_id.FULL_MARGIN >= language_id.NARROW_MARGIN}
            assert want.isdisjoint({10_000, 10_001, 10_002, 10_006}) and len(want) > 0.9 * len(docs)
        elif name == "exact dedup":
            groups = {}
            for i, t in texts.items():
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append(i)
            want = {min(g, key=lambda i: (-len(texts[i]), i)) for g in groups.values()}
            assert len(want) < len(texts)
        elif name == "MinHash near-dedup":
            want = set(near_classes(list(texts), list(texts.values())).values())
            assert len(want) < len(texts)
        elif name == "PII":
            want, found = set(texts), {r.doc_id: r for r in pii.with_pseudonyms(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "public test key").collect()}
            assert all(found[i].text == t for i, t in zip(after.doc_id, after.text, strict=True)) and any(r.found for r in found.values())
        else:
            check_packed(after, list(texts), list(texts.values()))
            kept = after[["doc_id", "piece", "length", "ids_crc32"]]
            continue
        assert Counter(after.doc_id) == Counter(want)
    whole = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    order = lambda x: sorted(x[["doc_id", "piece", "length", "ids_crc32"]].itertuples(index=False, name=None))
    assert order(whole) == order(kept)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
