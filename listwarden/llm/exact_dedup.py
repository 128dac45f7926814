"""Exact deduplication by sorting content.

Texts are equal if they are identical without the characters [\\x20\\x09-\\x0D]. Spark samples
splitters, range-partitions the rows and sorts each partition, so that equal texts are neighbours;
the sort and the comparison of neighbours look at the whole normalised text. Splitters are a short
prefix and a hash of the normalised text, so what the sampler sends to the driver is small however
long texts are, and a prefix that many texts share does not fill one partition.

Groups of copies that hold more than `1 / HOT_SHARE` of all rows (there can be only HOT_SHARE of
those) are summed up before any shuffle instead, and the sums are broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group is hot above this share of the rows, and above HOT_ROWS rows.
HOT_SHARE, HOT_ROWS = 10_000, 1_000
PREFIX = 24
#: The characters that normalisation deletes.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def mark_copies(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All rows and columns of docs, and a struct `dedup` of keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original stays, then the smallest
    doc_id (null last). Null text counts as empty; empty texts equal each other. Rows that repeat
    in every column, doc_id included, are a group like any other: one row stays. Columns other than
    doc_id and text may have any name, but one named `dedup` is replaced; an empty table gives an
    empty table.
    """
    names = [c for c in docs.columns if c != "dedup"]
    return _marked(docs, hot_rows).select(*[F.col(f"doc.`{c}`") for c in names], "dedup")


def _marked(docs: DataFrame, hot_rows: int) -> DataFrame:
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    rows = rows.withColumn("hash", F.xxhash64(normalised(F.col("doc.text"))))
    counts = rows.groupBy("hash").count()
    total = counts.select(F.sum("count")).scalar()
    # at most HOT_SHARE keys: each holds more than 1 / HOT_SHARE of the rows
    hot = [
        r.hash for r in counts.filter((F.col("count") > hot_rows) & (F.col("count") > total / HOT_SHARE)).select("hash").collect()
    ]
    cold = rows.filter(~F.col("hash").isin(hot)) if hot else rows
    marked = _sorted_copies(cold)
    if hot:
        marked = marked.unionByName(_summed_copies(rows.filter(F.col("hash").isin(hot))))
    return marked


def _digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _sorted_copies(rows: DataFrame) -> DataFrame:
    norm = normalised(F.col("doc.text"))
    near = (
        rows.withColumn("prefix", F.left(norm, F.lit(PREFIX)))
        .repartitionByRange("prefix", "hash")
        .withColumn("norm", norm)
    )
    group = Window.partitionBy("prefix", "hash", "norm")
    order = group.orderBy(F.char_length(F.coalesce("doc.text", F.lit(""))).desc(), F.col("doc.doc_id").asc_nulls_last())
    return near.select(
        "doc",
        F.struct(
            F.first("doc.doc_id").over(order).alias("keep_id"),
            F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("group_size"),
            (F.row_number().over(order) == 1).alias("kept"),
            _digest(F.col("norm")).alias("text_sha256"),
        ).alias("dedup"),
    )


def _summed_copies(rows: DataFrame) -> DataFrame:
    """The same for hot groups: whole texts are grouped with partial sums before the shuffle."""
    keyed = rows.select(
        "doc", normalised(F.col("doc.text")).alias("norm"),
        F.struct(
            (-F.char_length(F.coalesce("doc.text", F.lit("")))).alias("shorter"),
            F.col("doc.doc_id").isNull().alias("no_id"),
            F.col("doc.doc_id").alias("doc_id"),
        ).alias("rank"),
        F.monotonically_increasing_id().alias("row"),
    )
    best = keyed.groupBy("norm").agg(
        F.min(F.struct("rank", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")
    ).select(_digest(F.col("norm")).alias("text_sha256"), "best", "group_size")
    return keyed.withColumn("text_sha256", _digest(F.col("norm"))).join(F.broadcast(best), "text_sha256").select(
        "doc",
        F.struct(
            F.col("best.rank.doc_id").alias("keep_id"), "group_size",
            (F.struct("rank", "row") == F.col("best")).alias("kept"), "text_sha256",
        ).alias("dedup"),
    )


def drop_copies(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    return _marked(docs, hot_rows).filter("dedup.kept").select("doc.*")
