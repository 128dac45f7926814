"""How often values occur, and what the members of a frequent group need to know.

All keys of a row go to one long narrow table ``(row_id, kind, key)``, written once, so the
listings are read and their keys (digests of whole rows among them) computed a single time.
The table is counted once (with map-side partial aggregation, so hot keys collapse before the
shuffle) and joined back once, whatever the number of keys. Only the per-row evidence meets
the wide listings again, so those are shuffled a single time instead of once per rule.

Rows of very frequent keys are spread over salts before the join back. How many salts a
key gets depends on its count only, so results are exact and complete.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwarden.operators.storage import stored

#: Rows of one key that a join task should get at most.
SALT_ROWS = 250_000
#: A key with at most this share of all key rows is never salted, so fewer keys than this can be.
HOT_SHARE = 100_000


@dataclass(frozen=True)
class Kind:
    """One sort of shared value: its evidence prefix, key and smallest group of interest."""

    name: str
    key: Column
    threshold: int = 2
    #: Also look up the name key of the group's first row.
    first_name: bool = False


def key_bytes(value: Column) -> Column:
    """Text as a group key; the empty string is no key."""
    return F.when(value != "", value.cast("binary"))


def value_frequency(df: DataFrame, key: Column, row_id: Column | None = None) -> DataFrame:
    """``(key, n[, first_id])`` of all non-empty values.

    The empty value is dropped by its count: a filter on the key would be pushed down to the scan,
    and every costly expression in it evaluated there again, several times over.
    """
    aggregates = [F.count_if(F.col("key") != "").alias("n")]
    selected = [key.alias("key")]
    if row_id is not None:
        selected.append(row_id.alias("row_id"))
        aggregates.append(F.min("row_id").alias("first_id"))
    return df.select(*selected).groupBy("key").agg(*aggregates).filter(F.col("n") > 0)


def row_digest(columns: Sequence[Column]) -> Column:
    """Identity of a whole row: SHA-256 over its length-prefixed raw values.

    32 bytes stand for the row in the shuffle. Different rows never serialize alike
    (null differs from empty), so equal digests mean equal rows.
    """
    # One flat concatenation of sizes in bytes: texts are neither copied twice nor counted through.
    parts = []
    for column in columns:
        text = column.cast("string")
        size = F.coalesce(F.octet_length(text).cast("string"), F.lit("-"))
        parts += [size, F.lit(":"), F.coalesce(text, F.lit(""))]
    return F.unhex(F.sha2(F.concat(*parts), 256)) if parts else F.lit(None).cast("binary")


def group_evidence(
    keyed: DataFrame,
    kinds: Sequence[Kind],
    *,
    known: Mapping[str, DataFrame] | None = None,
    apart: Mapping[str, DataFrame] | None = None,
    first_name: Column | None = None,
    row_id: str = "row_id",
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """One row per listing that belongs to a group of interest.

    Columns are ``<kind>_n`` (group size) and ``<kind>_first`` (smallest id), null where
    the row is in no such group, and ``name_match``: the first of the ``first_name``
    kinds that applies, as a struct of kind number, n, first_id and first_name.

    ``known`` restricts kinds to the keys of a given table with a ``key`` column. ``apart`` has the
    keys (``row_id, key``) of kinds that are not computed from the keyed table.
    """
    number = {kind.name: index for index, kind in enumerate(kinds)}
    named = [number[kind.name] for kind in kinds if kind.first_name]
    apart = {name: table for name, table in (apart or {}).items() if name in number}
    rows = [_key_rows(keyed, here, number, first_name, row_id)
            for here in [[kind for kind in kinds if kind.name not in apart]] if here]
    rows += [
        table.select("row_id", F.lit(number[name]).alias("kind"), "key",
                     F.lit(None).cast("string").alias("name")).filter(F.col("key").isNotNull())
        for name, table in apart.items()]
    keys = stored(reduce(DataFrame.unionByName, rows))
    groups = _groups(keys, kinds, number)
    for name, table in (known or {}).items():
        if name in number:
            groups = _restrict(groups, number[name], table)
    groups = stored(groups)
    hot = _hot_keys(groups, salt_rows)
    members = _join_back(keys, groups, hot, salt_rows)
    evidence = []
    for kind in kinds:
        mine = F.col("kind") == number[kind.name]
        if kind.first_name:
            continue
        evidence.append(F.max(F.when(mine, F.col("n"))).alias(f"{kind.name}_n"))
        evidence.append(F.max(F.when(mine, F.col("first_id"))).alias(f"{kind.name}_first"))
    if named:
        match = F.struct("kind", "n", "first_id", "first_name")
        evidence.append(F.min(F.when(F.col("kind").isin(named), match)).alias("name_match"))
    return members.groupBy("row_id").agg(*evidence)


def _key_rows(
    keyed: DataFrame, kinds: Sequence[Kind], number: Mapping[str, int],
    first_name: Column | None, row_id: str,
) -> DataFrame:
    """``row_id, kind, key, name``; kinds that ask for a first name carry that of the row."""
    # Keys are computed in a projection of their own: compiled, where expressions inside
    # the generator would be interpreted.
    wide = keyed.select(
        F.col(row_id).alias("row_id"),
        (F.lit(None).cast("string") if first_name is None else first_name).alias("name"),
        *[kind.key.alias(f"key_{number[kind.name]}") for kind in kinds],
    )
    rows = F.array(*[
        F.struct(F.lit(number[kind.name]).alias("kind"),
                 F.col(f"key_{number[kind.name]}").alias("key"),
                 (F.col("name") if kind.first_name else F.lit(None).cast("string")).alias("name"))
        for kind in kinds
    ])
    return wide.select("row_id", F.inline(rows)).filter(F.col("key").isNotNull())


def _groups(keys: DataFrame, kinds: Sequence[Kind], number: Mapping[str, int]) -> DataFrame:
    """``kind, key, n, first_id, first_name`` of the groups of interest."""
    by_kind = F.col("kind")
    threshold = F.lit(None).cast("int")
    for kind in kinds:
        threshold = F.when(by_kind == number[kind.name], kind.threshold).otherwise(threshold)
    size = F.count(F.lit(1)).alias("n")
    named = [number[kind.name] for kind in kinds if kind.first_name]
    plain = keys.filter(~by_kind.isin(named)).groupBy("kind", "key").agg(
        size, F.min("row_id").alias("first_id")
    ).withColumn("first_name", F.lit(None).cast("string"))
    groups = plain
    if named:
        # The name comes along with the smallest id, so groups need not look it up.
        first = F.min(F.struct("row_id", "name")).alias("first")
        carried = keys.filter(by_kind.isin(named)).groupBy("kind", "key").agg(size, first).select(
            "kind", "key", "n", F.col("first.row_id").alias("first_id"),
            F.col("first.name").alias("first_name"))
        groups = plain.unionByName(carried) if len(named) < len(kinds) else carried
    return groups.filter(F.col("n") >= threshold)


def _restrict(groups: DataFrame, number: int, table: DataFrame) -> DataFrame:
    """Groups of one kind only if the table has their key; a table laid out by key stays in place."""
    known = groups.filter(F.col("kind") == number).join(table.select("key"), "key", "left_semi")
    return groups.filter(F.col("kind") != number).unionByName(known)


def _salts(salt_rows: int) -> Column:
    return F.ceil(F.col("n") / salt_rows).cast("int")


def _hot_keys(groups: DataFrame, salt_rows: int) -> DataFrame:
    """Every key with more rows than one task should get.

    Each also holds more than 1 / HOT_SHARE of the rows of all groups, so there are fewer than
    HOT_SHARE of them by arithmetic, and they are broadcast.
    """
    total = groups.select(F.sum("n")).scalar()
    return (
        groups.filter((F.col("n") > salt_rows) & (F.col("n") > total / HOT_SHARE))
        .select("kind", "key", _salts(salt_rows).alias("salts"))
    )


def _join_back(keys: DataFrame, groups: DataFrame, hot: DataFrame, salt_rows: int) -> DataFrame:
    """Give each row the group of its key, spreading the rows of hot keys over salts."""
    salt = F.coalesce(F.pmod(F.xxhash64("row_id"), F.col("salts")).cast("int"), F.lit(0))
    keys = keys.drop("name")
    salted_keys = keys.join(F.broadcast(hot), ["kind", "key"], "left").select(
        "row_id", "kind", "key", salt.alias("salt")
    )
    salted_groups = groups.select(
        "*", F.explode(F.sequence(F.lit(0), _salts(salt_rows) - 1)).alias("salt")
    )
    return salted_keys.join(salted_groups, ["kind", "key", "salt"])
