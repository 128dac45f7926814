"""Group keys of a listing: what it may share with other listings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwarden.config import RiskConfig
from listwarden.functions import text
from listwarden.operators.frequency import Kind, key_bytes, row_digest
from listwarden.operators.prepare import Listings
from listwarden.operators.rules import MIN_SHARED

GROUP_NEEDS = ("address", "phone", "domain", "email", "owner", "batch", "copy", "near_name", "rdi")
#: Fields from which keys are made, but for that of whole rows, and which rules over groups read.
GROUP_FIELDS = frozenset((
    "address", "phone", "website", "email", "owner_name", "date_added", "reseller_id",
    "reseller_name", "business_name", "industry"))


def name_fingerprints(name: Column) -> dict[str, Column]:
    """Keys of which any shared one makes two names near-duplicates, strongest first."""
    words = F.sort_array(F.array_distinct(F.split(name, r"\s+")))
    size = F.length(name)
    trigrams = F.sort_array(F.array_distinct(F.transform(
        F.sequence(F.lit(1), size - 2), lambda at: F.call_function("substring", name, at, F.lit(3))
    )))
    return {
        "words": F.array_join(words, " "),
        "trigrams": F.when(size < 3, name).otherwise(F.array_join(F.slice(trigrams, 1, 8), "|")),
        "prefix": F.when(name != "", F.concat_ws(
            ":", F.floor(size / 3).cast("string"), F.substring(name, 1, 5)
        )).otherwise(""),
    }


def batch_columns(listings: Listings) -> dict[str, Column]:
    """Submission day, and the reseller: its id, or its name if no row at all has an id."""
    reseller = F.col("reseller_id")
    if listings.has("reseller_id") and listings.has("reseller_name"):
        # Asked of the whole input (one column of it, as far as the first id), not of rows
        # already selected, and once, so that no later plan reads the input for it again.
        cell = text.clean_cell(F.col(f"in_{listings.fields['reseller_id']}"))
        if listings.source.filter(cell != "").isEmpty():
            reseller = F.col("reseller_name")
    elif listings.has("reseller_name"):
        reseller = F.col("reseller_name")
    return {
        "batch_date": F.substring("date_added", 1, 10),
        "batch_reseller": F.when(reseller == "", F.lit("UNKNOWN")).otherwise(reseller),
    }


def group_kinds(
    cfg: RiskConfig,
    listings: Listings,
    needs: Iterable[str],
    compare_cols: Sequence[str] | None = None,
) -> list[Kind]:
    needs = set(needs)
    reseller, day = F.col("batch_reseller"), F.col("batch_date")
    batch = F.concat(F.length(reseller).cast("string"), F.lit(":"), reseller, day)
    valid_day = (day != "") & (day != "nan")
    kinds = {
        "address": Kind("address", key_bytes(F.lower("address")), cfg.shared_address_threshold),
        "phone": Kind("phone", key_bytes(F.col("digits")), cfg.shared_phone_threshold),
        "domain": Kind("domain", key_bytes(F.col("site_domain")), MIN_SHARED),
        "email": Kind("email", key_bytes(F.col("email_lower")), MIN_SHARED),
        "owner": Kind("owner", key_bytes(F.col("owner_norm")), MIN_SHARED),
        "batch": Kind("batch", F.when(valid_day, key_bytes(batch)),
                      cfg.batch_submission_threshold),
        "copy": Kind("copy", row_digest(listings.input_columns(compare_cols))),
        "rdi": Kind("rdi", F.when(F.col("high_risk"), key_bytes(F.col("address"))), threshold=1),
    }
    chosen = [kind for name, kind in kinds.items() if name in needs]
    if "near_name" in needs:
        for name, key in name_fingerprints(F.col("name_key")).items():
            key = F.when(F.col("name_key") != "", key)
            chosen.append(Kind(f"near_{name}", key_bytes(key), first_name=True))
    return chosen


def copy_keys(listings: Listings, compare_cols: Sequence[str] | None = None) -> DataFrame:
    """``row_id, key`` of whole rows whose texts are in a table of their own.

    The digest of the other columns stands for them where the text comes in, so that a row which
    is brought to its text is a few numbers wide.
    """
    compared = listings.headers if compare_cols is None else compare_cols
    column = listings.texts.column
    others = row_digest(listings.input_columns([name for name in compared if name != column]))
    if column not in compared:
        return listings.table.select("row_id", others.alias("key"))
    reference = f"in_{listings.headers.index(column)}"
    rows = listings.table.select("row_id", reference, F.hex(others).alias("others"))
    key = row_digest([F.col("others"), F.col(reference)])
    return listings.with_texts(rows).select("row_id", key.alias("key"))


def residential_keys(rdi: DataFrame) -> DataFrame:
    """Addresses a residential-indicator table calls residential, as group keys.

    A table stored by ``store_lookups`` has the keys, and is laid out by them.
    """
    return address_keys(rdi.filter(F.col("rdi") == "Residential"))


def address_keys(table: DataFrame) -> DataFrame:
    """``key`` of each address."""
    if "key" in table.columns:
        return table.select("key")
    return table.select(key_bytes(text.clean_cell(F.col("address"))).alias("key"))
