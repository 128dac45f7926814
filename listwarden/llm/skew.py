"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above this share of the rows, and above HOT_ROWS rows.
HOT_SHARE, HOT_ROWS = 10_000, 1_000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of rows with a table of one row per key, by columns of the same names.

    Rows of hot keys stay where they are: the table's rows for these are broadcast, at most HOT_SHARE,
    as each key holds more than 1 / HOT_SHARE of the rows. Others meet by a shuffle. Both inputs
    are read more than once, so they should be stored tables, or cheap to make from such.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    total = rows.select(F.count(F.lit(1))).scalar()
    hot = counts.filter(F.col("_n") > total / HOT_SHARE).select(*keys)
    found = hot.toArrow()  # at most HOT_SHARE rows
    if not found.num_rows:
        return rows.join(table, keys)
    # from Arrow, as a list of rows would start a second Python daemon and workers in each executor
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema))
    near = rows.join(F.broadcast(table.join(hot, keys, "left_semi")), keys)
    return near.unionByName(rows.join(hot, keys, "left_anti").join(table, keys))
