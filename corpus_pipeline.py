"""From raw documents to packed training sequences, one stage after the other.

Each stage works on all that the stage before it kept, written as Parquet in between.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwarden.llm import exact_dedup, language_id, minhash, packing, pii
from listwarden.llm.queries import PII_KEY, importable
from listwarden.llm.storage import shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is not told clearly (operator 8)."""
    importable(spark)
    learned = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_known(docs, learned)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts (operator 1)."""
    return exact_dedup.drop_copies(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (operator 10)."""
    importable(spark)
    return minhash.drop_near_duplicates(docs)


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms of the same format (operator 2); n_chars follows the text."""
    out = pii.with_pseudonyms(docs.withColumnRenamed("found", "_found") if "found" in docs.columns else docs, PII_KEY).drop("found")
    if "_found" in out.columns:
        out = out.withColumnRenamed("_found", "found")
    return out.select(*docs.columns)


#: Less than in packing alone: idle workers hold that memory while other stages run.
KEPT_WORDS, PART_BYTES = 60_000, 500_000


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences (operator 7)."""
    importable(spark)
    tokenizer = packing.default_tokenizer("word_bpe_49k.json")
    return packing.pack(packing.token_pieces(docs, tokenizer, kept_words=KEPT_WORDS, part_bytes=PART_BYTES))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", distinct_texts),
    ("MinHash near-dedup", distinct_contents),
    ("PII", pseudonymised),
    ("best-fit packing", packed),
]

#: SQL cannot express compression, signatures or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
