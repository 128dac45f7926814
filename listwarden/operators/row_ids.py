"""Contiguous row ids for tables that come without a key."""

from __future__ import annotations

from itertools import accumulate

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwarden.operators.storage import stored

#: Files whose first ids may be broadcast; tables of more are copied.
MAX_FILES = 100_000
_PARTITION_BITS = 33  # layout of monotonically_increasing_id
#: Plan nodes that neither repeat nor reorder the rows of a file.
_ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias", "View"}


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add 0-based contiguous ids in the order of the input.

    Rows of Parquet files know their place: the id is the position in the file plus the rows of
    all files before it, by path. Nothing is copied, reading again gives the same ids, and a plan
    that uses few columns reads few. Other sources have no such place, and filtered files have
    gaps: these are written once, since an id must not change when a task is retried.
    """
    placed = _by_file_position(df, name)
    return _by_written_order(df, name) if placed is None else placed


def _by_file_position(df: DataFrame, name: str) -> DataFrame | None:
    if not _reads_files_row_by_row(df):
        return None
    try:
        place = df.metadataColumn("_metadata")
        marked = df.withColumns({"__file": place["file_path"], "__place": place["row_index"]})
        sizes = marked.groupBy("__file").agg(
            F.count(F.lit(1)).alias("n"), (F.max("__place") + 1).alias("span"))
    except AnalysisException:  # no Parquet, so no positions
        return None
    files = sorted(tuple(row) for row in sizes.limit(MAX_FILES + 1).collect())
    if len(files) > MAX_FILES or any(n != span for _, n, span in files):
        return None
    firsts = [0, *accumulate(n for _, n, _ in files)]
    starts = df.sparkSession.createDataFrame(
        [(path, first) for (path, _, _), first in zip(files, firsts)], "__path string, __first long")
    return (
        marked.join(F.broadcast(starts), F.col("__file") == F.col("__path"))  # <= MAX_FILES rows
        .withColumn(name, F.col("__first") + F.col("__place"))
        .drop("__file", "__place", "__path", "__first")
    )


def _reads_files_row_by_row(df: DataFrame) -> bool:
    """Whether every row of df is a row of one file scan, none of them twice."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return False
    node: JavaObject = plan.queryExecution().analyzed()
    while node.nodeName() in _ROW_BY_ROW and node.children().size() == 1:
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def _by_written_order(df: DataFrame, name: str) -> DataFrame:
    marked = stored(df.withColumn("__mid", F.monotonically_increasing_id()))
    partition = F.shiftright("__mid", _PARTITION_BITS)
    # One small row per task of the scan, which the driver tracks anyway.
    sizes = sorted(
        (row["p"], row["n"])
        for row in marked.groupBy(partition.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    )
    firsts = [0, *accumulate(size for _, size in sizes)]
    starts = df.sparkSession.createDataFrame(
        [(number, first) for (number, _), first in zip(sizes, firsts)],
        "__partition long, __start long")
    within = F.col("__mid").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    return (
        marked.join(F.broadcast(starts), partition == F.col("__partition"))
        .withColumn(name, F.col("__start") + within)
        .drop("__mid", "__partition", "__start")
    )
