"""One query per operator over the test tables, and SQL twins where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwarden.llm import (
    alignment,
    bpe,
    centroids,
    embedding_dedup,
    exact_dedup,
    language_id,
    license_scan,
    minhash,
    packing,
    pii,
    substring_dedup,
    token_counts,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: For the registered queries only, so that their results can be repeated.
PII_KEY = "public test key"
_ROOT = str(Path(__file__).resolve().parents[2])


#: Rows that go to Python at once in the registered queries and the pipeline: texts may be long.
BATCH_ROWS = 2_000
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def importable(spark: SparkSession) -> None:
    """Let Python workers of a session without a deployed package find it next to this file.

    Where the session leaves the size of batches at Spark's default, they are made smaller.
    """
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, known) if x)


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup.mark_copies(docs).select("doc_id", "dedup.*")


ORACLES["op1_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
"""


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_pseudonyms(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY).select(
        "doc_id", "text", F.size("found").cast("long").alias("n_found"), F.array_join("found", ",").alias("kinds")
    )


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    outside = language_id.held_out(F.col("doc_id"))
    dictionaries = language_id.learn(docs.filter(~outside))
    return language_id.predict(docs.select("doc_id", outside.alias("held_out"), "text"), dictionaries, keep_text=False)


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(documents(spark, sf_dir), packing.default_tokenizer("word_bpe_49k.json"))
    return packing.pack(pieces)


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(documents(spark, sf_dir))
    best = F.try_element_at("licenses", F.lit(1))
    return found.select(
        "doc_id", best.license.alias("license"), best.dice.alias("dice"), best.first_word.alias("first_word"),
        F.array_join("licenses.license", ",").alias("all_licenses"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), packing.default_tokenizer("piece_bpe_32k.model"))


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = packing.default_tokenizer("byte_bpe_50k.json")
    decoded = bpe.decode(bpe.encode(documents(spark, sf_dir), path), path)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _centroid_rounds() -> str:
    """The rounds of clustering, written out one after the other."""
    nearest = """
  SELECT vec_id, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
    SELECT p.vec_id, c.j, sum((p.x - c.x) * (p.x - c.x)) AS d
    FROM components p JOIN c{0} c USING (place) GROUP BY 1, 2) GROUP BY 1"""
    moved = """
  SELECT c.j, c.place, coalesce(m.x, c.x) AS x FROM c{0} c LEFT JOIN (
    SELECT a.j, p.place, (sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*) AS x
    FROM a{0} a JOIN components p USING (vec_id) GROUP BY 1, 2) m ON m.j = c.j AND m.place = c.place"""
    parts = []
    for i in range(centroids.ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.format(i)})")
        if i < centroids.ROUNDS:
            parts.append(f"c{i + 1} AS MATERIALIZED ({moved.format(i)})")
    return ",\n".join(parts)


ORACLES["op11_centroids"] = f"""
WITH components AS MATERIALIZED (
  SELECT vec_id, unnest(range(64)) AS place, CAST(floor(1024 * unnest(embedding)::DOUBLE) AS HUGEINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c0 AS MATERIALIZED (
  SELECT j, place, x FROM components JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id)) - 1 AS j
    FROM (SELECT DISTINCT vec_id FROM components)) USING (vec_id) WHERE j < {centroids.CENTROIDS}),
{_centroid_rounds()},
digests AS (
  SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS sha FROM c{centroids.ROUNDS} GROUP BY 1)
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN digests USING (j)
"""


@query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no times: a page was captured so many seconds into 2024 as its id says, within ten years."""
    seconds = F.lit(1_704_067_200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(315_360_000))
    captures = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.col("page_id").alias("capture_id"), "url", F.timestamp_seconds(seconds).alias("captured"), F.col("html").alias("payload"))
    return warc.archived(captures).select(
        F.col("capture_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op12_warc"] = f"""
WITH t AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (
  SELECT *, CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} THEN
    nullif(min(page_id) OVER (PARTITION BY payload_digest), page_id) END AS refers_to FROM t)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM g
"""


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(
        documents(spark, sf_dir), packing.default_tokenizer("byte_bpe_50k.json"), packing.default_tokenizer("piece_bpe_32k.model"))
