"""Lookups in bounded reference tables (ZIP state, area-code region)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a reference table that may be broadcast.
MAX_KEYS = 200_000


def with_zip_state(df: DataFrame, zip_code: Column, zip_dim: DataFrame, name: str) -> DataFrame:
    """Add the state a ZIP belongs to (null if unknown)."""
    return _lookup(df, zip_code, zip_dim, "zip", F.upper("state_code"), name)


def with_area_region(
    df: DataFrame, area_code: Column, area_code_dim: DataFrame, name: str
) -> DataFrame:
    """Add the region text of an area code (null if unknown)."""
    return _lookup(df, area_code, area_code_dim, "area_code", F.upper("region_desc"), name)


def _lookup(
    df: DataFrame, key: Column, dim: DataFrame, dim_key: str, value: Column, name: str
) -> DataFrame:
    """One row per key, so that the join never multiplies listings. Every key is kept.

    Raises if there are more than MAX_KEYS keys, which bounds the broadcast.
    """
    table = (
        dim.filter(F.col(dim_key).isNotNull())
        .groupBy(F.col(dim_key).alias("__dim_key"))
        .agg(F.min(value).alias(name))
    )
    if table.limit(MAX_KEYS + 1).count() > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} keys in the reference table of {dim_key}")
    return df.join(F.broadcast(table), key == F.col("__dim_key"), "left").drop("__dim_key")
