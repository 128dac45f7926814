"""Upkeep of the residential-indicator table that an external lookup fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwarden.config import RiskConfig
from listwarden.functions.text import clean_cell
from listwarden.operators.frequency import key_bytes
from listwarden.operators.groups import address_keys
from listwarden.operators.prepare import ROW_ID, Listings
from listwarden.plans.scoring import References, prepared_listings


def lookup_worklist(
    df: DataFrame, cfg: RiskConfig, known: DataFrame | None = None, id_col: str | None = None
) -> DataFrame | None:
    """High-risk addresses still to look up: ``address, city, state, zip``.

    Each address comes once, with the place of its first row. None without an address
    column. Addresses are reduced before they meet the known ones, so a hot address is
    one row by then.
    """
    listings = Listings.of(df, id_col)
    if not listings.has("address"):
        return None
    first = F.min(F.struct(ROW_ID, "city", "state", "zip"))
    rows = prepared_listings(listings, cfg, References(), ())
    worklist = (
        rows.filter(F.col("high_risk") & (F.col("address") != ""))
        .groupBy("address")
        .agg(first.alias("first"))
        .select("address", "first.city", "first.state", "first.zip")
    )
    if known is not None:
        worklist = worklist.join(known.select("address"), "address", "left_anti")
    return worklist


def merge_lookups(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """Known answers plus new ones; a failed lookup (null) is stored as ''.

    A known answer is never replaced.
    """
    new = (
        fetched.groupBy("address")
        .agg(F.max(F.coalesce("rdi", F.lit(""))).alias("rdi"))
        .join(known.select("address"), "address", "left_anti")
    )
    return known.select("address", "rdi").unionByName(new)


def store_lookups(lookups: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Save answers as a table laid out by address, and return it.

    The table grows with all listings ever seen, a batch does not. Batches are brought to its
    buckets, so that it is read in place: ``lookups_for_batch`` and the residential rule do not
    shuffle it. ``buckets`` should give files of 100 to 200 MB, and be a multiple of the cores
    that a batch may use. Saved again after a merge, under another name.
    """
    spark: SparkSession = lookups.sparkSession
    rows = lookups.select("address", "rdi", key_bytes(clean_cell(F.col("address"))).alias("key"))
    writer = rows.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def lookups_for_batch(
    lookups: DataFrame, df: DataFrame, cfg: RiskConfig, id_col: str | None = None
) -> DataFrame:
    """The answers for high-risk addresses of one batch: ``address, rdi``."""
    addresses = lookup_worklist(df, cfg, None, id_col)
    if addresses is None:
        return lookups.select("address", "rdi").limit(0)
    if "key" not in lookups.columns:
        wanted = addresses.select("address")
        return lookups.select("address", "rdi").join(wanted, "address", "left_semi")
    wanted = address_keys(addresses).distinct()
    return lookups.join(wanted, "key", "left_semi").select("address", "rdi")
